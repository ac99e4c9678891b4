"""URL filter by a path-template tree, with DataFrame functions only.

Hosts and paths are taken from urls, and rules (host and path prefix) judge what they fit; those verdicts are the labels.
There is a tree for each host, for each domain above it and for all hosts. In a tree, segments that look variable (numbers,
dates, long hexadecimal, mixed letters and digits) become classes, and segments below one parent that take many values
become a wildcard. Sibling branches with the same rest of the path merge where their labelled block rates don't differ by
more than chance; branches without labels go with their labelled siblings, as nothing tells them apart. A template's purity
is its block rate, smoothed towards that of the page's template in the domain above, and so on up to the tree of all hosts
and the rate of all labelled pages. So labels of one host tell about like paths of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, spread_join, stash

#: Rules of the registered query; host and path prefix, and the verdict.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Segments from the front at which branches may merge; deeper ones are classes, wildcards or themselves.
LEVELS = 6
#: Classes of variable segments, the first that fits.
CLASSES = [
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "<date>"),
    (r"^[0-9]+$", "<num>"),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "<uuid>"),
    (r"^[0-9a-fA-F]{12,}$", "<hex>"),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{6,}$", "<id>"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. A rule list is a parameter of bounded length."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _segment(s: Column) -> Column:
    out = s
    for pattern, name in reversed(CLASSES):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def scopes(host: Column) -> Column:
    """The domains of a host, from all hosts (an empty name) over its last part to itself."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    own = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(parts, n - i + 1, i)))
    return F.when(host == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), own))


def _matched(rows: DataFrame, table: DataFrame, names: list[str], by: Column, how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``table``, a written one with one row for each value of ``names``; hot values are dealt."""
    key = F.xxhash64(*names)
    right = table.select(key.alias("__k"), *[F.col(c).alias(f"__r_{c}") for c in table.columns])
    out = spread_join(rows.withColumn("__k", key), stash(right), "__k", by, how)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    out = out.where(same) if how == "inner" else out
    return out.select(*rows.columns, *[F.when(same, F.col(f"__r_{c}")).alias(c) for c in table.columns if c not in names])


def templates(shapes: DataFrame, many: int = 20, share: float = 0.3, likely: float = 1.96) -> DataFrame:
    """``scope, shape, t, b, l`` of ``shapes(scope, shape, n, b, l)``: each shape's template in that tree, and its labels and blocked ones.

    A shape is an array of segments. A parent's children become a wildcard if there are ``many`` kinds and more than
    ``share`` of its pages have one of their own. Levels merge from the deepest up; each is one aggregation of templates.
    """
    at = shapes.select("scope", "shape", "n", F.posexplode("shape").alias("i", "seg"))
    at = stash(at.withColumn("parent", F.concat_ws("/", F.slice("shape", F.lit(1), F.col("i")))))
    kinds = at.groupBy("scope", "parent", "seg").agg(F.sum("n").alias("n")).groupBy("scope", "parent").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    wild = kinds.where((F.col("kinds") >= many) & (F.col("kinds") > F.col("n") * share)).select("scope", "parent", F.lit(True).alias("wild"))
    seg = F.struct("i", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg")).alias("s"))
    named = _matched(at, wild, ["scope", "parent"], F.xxhash64("shape")).groupBy("scope", "shape").agg(F.array_sort(F.collect_list(seg)).alias("t"))
    named = named.select("scope", "shape", F.transform("t", lambda x: x["s"]).alias("t0"))
    empty = shapes.where(F.size("shape") == 0).select("scope", "shape", F.col("shape").alias("t0"))
    out = stash(named.union(empty).join(shapes, ["scope", "shape"]).select("scope", "shape", "t0", "b", "l"))
    branches = stash(out.groupBy("scope", "t0").agg(F.sum("b").alias("b"), F.sum("l").alias("l")).withColumn("t", F.col("t0")))
    for level in range(LEVELS, 0, -1):
        seg = F.get("t", F.lit(level - 1))
        literal = seg.isNotNull() & ~seg.rlike(r"^(\*|<.*>)$")
        masked = F.when(literal, F.transform("t", lambda x, i: F.when(i == level - 1, F.lit("*")).otherwise(x)))
        own = branches.groupBy("scope", "t").agg(F.sum("b").alias("b"), F.sum("l").alias("l")).withColumn("m", masked).where("m is not null")
        own = stash(own)
        pooled = own.groupBy("scope", "m").agg((F.sum("b") / F.nullif(F.sum("l"), F.lit(0))).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1 and p is not null")
        near = F.abs(F.col("b") / F.col("l") - F.col("p")) <= likely * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("l")) + 1e-9
        alike = _matched(own, pooled, ["scope", "m"], F.xxhash64("t"), "inner").where((F.col("l") == 0) | near).select("scope", "t", "m")
        branches = stash(_matched(branches, alike, ["scope", "t"], F.xxhash64("t0")).withColumn("t", F.coalesce("m", "t")).drop("m"))
    rates = branches.groupBy("scope", "t").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    final = _matched(branches.select("scope", "t0", "t"), rates, ["scope", "t"], F.xxhash64("t0"))
    return _matched(out.select("scope", "shape", "t0"), final, ["scope", "t0"], F.xxhash64("shape")).drop("t0")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", least: float = 0.8, weight: float = 10.0, support: int = 5) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``: one row per row of ``pages``.

    ``rule`` is the longest rule that fits (else null) and its verdict wins. Else a page whose template has ``support``
    labelled pages in its host or a domain above (other than all hosts) and a smoothed block rate (``purity``) of ``least``
    or more is blocked, and all else is allowed. A null url and one without ``://`` have an empty host and path. Repeated
    rows are judged each, a null id is carried, other columns aren't read (nor html). An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id"), host.alias("__host"), path.alias("__path"))
    rule, verdict = fitting_rule(F.col("__host"), F.col("__path"), rules)
    shape = F.transform(F.filter(F.split("__path", "/"), lambda s: s != ""), _segment)
    rows = stash(rows.select("__id", F.col("__host").alias("host"), "__path", rule.alias("__rule"), verdict.alias("__verdict"), shape.alias("shape")))
    shapes = stash(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__verdict") == "block").alias("b"), F.count("__verdict").alias("l")))
    prior = shapes.agg(F.sum("b") / F.nullif(F.sum("l"), F.lit(0))).first()[0] or 0.0
    within = shapes.withColumn("scope", F.explode(scopes(F.col("host"))))
    trees = templates(stash(within.groupBy("scope", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "b", "l")])))
    chain = _matched(within.select("host", "shape", "scope"), trees, ["scope", "shape"], F.xxhash64("host"))
    # A host's chain has as many members as its name has parts, and one.
    each = chain.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct(F.length("scope").alias("at"), "scope", "t", "b", "l"))).alias("c"))
    purity = F.aggregate("c", F.lit(float(prior)), lambda p, x: (x["b"] + weight * p) / (x["l"] + weight))
    known = F.coalesce(F.array_max(F.transform(F.filter("c", lambda x: x["scope"] != ""), lambda x: x["l"])), F.lit(0)) >= support
    judged = each.select("host", "shape", F.concat(F.lit("/"), F.concat_ws("/", F.element_at("c", -1)["t"])).alias("template"), purity.alias("purity"), known.alias("known"))
    out = _matched(rows, judged, ["host", "shape"], F.coalesce("__id", F.xxhash64("__path")))
    method = F.when(F.col("known") & (F.col("purity") >= least), "block").otherwise("allow")
    return out.select(
        F.col("__id").alias("page_id"), "host", F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", method).alias("verdict"), F.concat("host", "template").alias("template"), F.round("purity", 9).alias("purity"),
    )
