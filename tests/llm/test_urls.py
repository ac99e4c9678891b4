"""The template tree of the URL filter against a plain one."""

import random
import re
from collections import defaultdict

from tessella.llm import license_scan, url_filter


def segment(s):
    for pattern, name in url_filter.CLASSES:
        if re.search(pattern, s, re.A):
            return name
    return s


def plain_tree(shapes, many=20, share=0.3, likely=1.96):
    """``{shape: (template, blocked, labelled)}`` of one tree's ``{shape: (n, blocked, labelled)}``."""
    kinds = defaultdict(lambda: defaultdict(int))
    for shape, (n, _, _) in shapes.items():
        for i, s in enumerate(shape):
            kinds[shape[:i]][s] += n
    wild = {p for p, k in kinds.items() if len(k) >= many and len(k) > sum(k.values()) * share}
    first = {shape: tuple("*" if shape[:i] in wild else s for i, s in enumerate(shape)) for shape in shapes}
    now = {t: t for t in first.values()}
    sums = defaultdict(lambda: [0, 0])
    for shape, t in first.items():
        sums[t][0] += shapes[shape][1]
        sums[t][1] += shapes[shape][2]

    def counted():
        out = defaultdict(lambda: [0, 0])
        for t, m in now.items():
            out[m][0] += sums[t][0]
            out[m][1] += sums[t][1]
        return out

    for level in range(url_filter.LEVELS, 0, -1):
        groups = defaultdict(list)
        for t, (b, n) in counted().items():
            if len(t) >= level and not re.search(r"^(\*|<.*>)$", t[level - 1]):
                groups[t[: level - 1] + ("*",) + t[level:]].append((t, b, n))
        moves = {}
        for m, own in groups.items():
            n = sum(x[2] for x in own)
            if len(own) > 1 and n:
                p = sum(x[1] for x in own) / n
                moves |= {t: m for t, b, k in own if not k or abs(b / k - p) <= likely * (p * (1 - p) / k) ** 0.5 + 1e-9}
        now = {t: moves.get(m, m) for t, m in now.items()}
    final = counted()
    return {shape: (now[first[shape]], *final[now[first[shape]]]) for shape in shapes}


def plain_judge(pages, rules, least=0.8, weight=10.0, support=5):
    rows = []
    for u in pages:
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(r), r, v) for r, v in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rows.append((host, tuple(segment(s) for s in path.split("/") if s), max(fits)[2] if fits else None))
    trees = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    domains = lambda host: ["", *[".".join(host.split(".")[-i:]) for i in range(1, host.count(".") + 2)]]
    for host, shape, verdict in rows:
        for scope in domains(host):
            c = trees[scope][shape]
            c[0] += 1
            c[1] += verdict == "block"
            c[2] += verdict is not None
    trees = {scope: plain_tree(t) for scope, t in trees.items()}
    labelled = [v for *_, v in rows if v]
    prior = sum(v == "block" for v in labelled) / len(labelled) if labelled else 0.0
    out = []
    for host, shape, verdict in rows:
        p, most = prior, 0
        for scope in domains(host):
            _, b, n = trees[scope][shape]
            p = (b + weight * p) / (n + weight)
            most = max(most, n if scope else 0)
        out.append((verdict or ("block" if most >= support and p >= least else "allow"), round(p, 6)))
    return out


def test_tree_equals_plain_and_judges_pages_without_a_rule(spark):
    rng = random.Random(5)
    hosts = ["a.example.net", "b.example.net", "c.other.net", "www.example.com", "x.org", "y.x.org", "localhost"]
    urls = []
    for _ in range(600):
        host = rng.choice(hosts)
        first = rng.choice(["en", "de", "es", "fr", "tag", "user"])
        tail = rng.choice([str(rng.randrange(900)), f"page{rng.randrange(50)}x", rng.choice("abcdefghijklmnopqrstuvwxyz") * 2, "2024-01-02", "a/b/c/d/e/f/g/" + str(rng.randrange(9)), ""])
        urls.append(f"https://{host}/{first}/{tail}" if first != "tag" else f"http://{host}/tag/{rng.randrange(10**6):x}zq?x")
    pages = spark.createDataFrame(list(enumerate(urls + urls[:50])), "page_id long, url string")
    rows = sorted(url_filter.judge(pages, url_filter.RULES).collect(), key=lambda r: r.page_id)
    want = plain_judge(urls + urls[:50], url_filter.RULES)
    assert [(r.verdict, round(r.purity, 6)) for r in rows] == want
    judged = [r for r in rows if r.rule is None]
    # Spanish and French pages of net are blocked by rules, so its German and English ones, which nothing tells apart, are as well; org has no labels.
    assert {r.verdict for r in judged if r.host.endswith("net") and "/de/" in r.path and r.template.endswith("<num>")} == {"block"}
    assert {r.verdict for r in judged if r.host.endswith("org")} == {"allow"}


def test_branches_that_labels_tell_apart_stay_apart(spark):
    urls = [f"http://h.net/{a}/{i}" for a in ("es", "fr") for i in range(40)] + [f"http://h.com/{a}/{i}" for a in ("es", "fr") for i in range(40)] + ["http://h.org/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert rows[160].verdict == "allow" and 0.4 < rows[160].purity < 0.6
    assert rows[0].purity > 0.95 and rows[80].purity < 0.05


def test_license_rows_repeat(spark):
    texts = ["x", "under the MIT license", "under the MIT license", None, None, "", "licensed under the Apache License Version 2 0 and more", "one two"]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_base, r.base_labels) for r in license_scan.scan(docs).collect())
    plain = []
    for i, t in enumerate(texts * 3):
        words = re.findall("[0-9a-z]+", (t or "").lower())
        at = {p: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p in license_scan.PHRASES}
        plain.append((i % 3, len(words), sum(map(len, at.values())), ",".join(sorted({license_scan.PHRASES[p] for p, k in at.items() if k}))))
    assert got == sorted(plain)
