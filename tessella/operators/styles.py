"""Regions and what may stand in them: templates that fit, proposals that are taken, roles that palette codes seem to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .color import lab
from .geometry import orient_place
from .raster import PLACE

REGION = ["image_id", "region"]
#: Cells of all templates together that may be broadcast.
MOST_CELLS = 1_000_000


def template_variants(templates: DataFrame) -> DataFrame:
    """``template, k, h, w, ty, tx, code``: templates ``(template, y, x, code)`` under eight orientations, numbered in the order that they are tried.

    That is a quarter turn after another, each followed by its mirror. A template is a full rectangle from (0, 0).
    """
    side = templates.groupBy("template").agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    each = templates.join(side, "template").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    way = F.floor(F.col("k") / 2) + 4 * (F.col("k") % 2)
    y, x = orient_place(F.col("y"), F.col("x"), F.col("__h"), F.col("__w"), way)
    odd = F.floor(F.col("k") / 2) % 2 == 1
    h, w = F.when(odd, F.col("__w")).otherwise(F.col("__h")), F.when(odd, F.col("__h")).otherwise(F.col("__w"))
    return each.select("template", "k", h.alias("h"), w.alias("w"), y.alias("ty"), x.alias("tx"), "code")


def _held(df: DataFrame) -> DataFrame:
    """``df``, checkpointed and to be broadcast unless it is large."""
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= MOST_CELLS else df


def rank_templates(cells: DataFrame, templates: DataFrame, least: float = 0.05, gap: float = 0.25) -> DataFrame:
    """``image_id, region, template, k, score``: the template and orientation that fits each region best, if it reaches ``least``.

    ``cells`` has ``image_id, region, y, x, code``; ``templates`` has ``template, y, x, code``. A template is repeated over the
    region's box from its upper left corner. The score is the share of the region's cells that it agrees with, less ``gap``
    times the difference of the shares of codes above 0 (of the template over the box, of the region over its cells),
    rounded to nine places. Ties go to the smaller template, then to the earlier orientation. Regions of one row or column
    have none.

    A region's cells are counted by place modulo the template's size and by code before templates are met, so that a region
    brings at most as many rows as templates have sizes, places and codes.
    """
    box = cells.groupBy(*REGION).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("rh"), (F.max("x") - F.min("x") + 1).alias("rw"), F.count(F.lit(1)).alias("area"), F.count_if(F.col("code") > 0).alias("shaded"))
    box = box.where("rh >= 2 and rw >= 2").checkpoint()
    variants = _held(template_variants(templates))
    sizes = F.broadcast(variants.select("h", "w").distinct()) if variants.count() <= MOST_CELLS else variants.select("h", "w").distinct()
    near = cells.join(box.select(*REGION, "y0", "x0"), REGION).join(sizes)
    counts = near.groupBy(*REGION, "h", "w", ((F.col("y") - F.col("y0")) % F.col("h")).alias("ty"), ((F.col("x") - F.col("x0")) % F.col("w")).alias("tx"), "code").agg(F.count(F.lit(1)).alias("n"))
    agree = counts.join(variants, ["h", "w", "ty", "tx", "code"]).groupBy(*REGION, "template", "k").agg(F.sum("n").alias("agree"))
    # The share of the repeated template above 0, for each size of a box.
    times = lambda n, s, t: F.greatest(F.ceil((F.col(n) - F.col(t)) / F.col(s)), F.lit(0))
    sides = box.select("rh", "rw").distinct()
    full = sides.join(variants).groupBy("rh", "rw", "template", "k").agg(F.sum(F.when(F.col("code") > 0, times("rh", "h", "ty") * times("rw", "w", "tx")).otherwise(0)).alias("above"))
    both = box.join(full, ["rh", "rw"]).join(agree, [*REGION, "template", "k"], "left")
    differs = F.abs(F.col("above") / (F.col("rh") * F.col("rw")) - F.col("shaded") / F.col("area"))
    score = F.round(F.coalesce("agree", F.lit(0)) / F.col("area") - gap * differs, 9)
    best = F.max(F.struct(score.alias("score"), (-F.col("template")).alias("t"), (-F.col("k")).alias("k")))
    found = both.groupBy(*REGION).agg(best.alias("b"))
    return found.select(*REGION, (-F.col("b.t")).alias("template"), (-F.col("b.k")).alias("k"), F.col("b.score").alias("score")).where(F.col("score") >= least)


def propose(cells: DataFrame, ranked: DataFrame, templates: DataFrame) -> DataFrame:
    """``image_id, y, x, proposal``: of each cell whose region has a template, the code that the template puts there."""
    start = cells.groupBy(*REGION).agg(F.min("y").alias("y0"), F.min("x").alias("x0"))
    variants = _held(template_variants(templates))
    at = cells.join(ranked.join(start, REGION), REGION).join(variants.select("template", "k", "h", "w", "ty", "tx", F.col("code").alias("proposal")), ["template", "k"])
    here = ((F.col("y") - F.col("y0")) % F.col("h") == F.col("ty")) & ((F.col("x") - F.col("x0")) % F.col("w") == F.col("tx"))
    return at.where(here).select(*PLACE, "proposal")


def class_probabilities(cells: DataFrame, scores: str, pred: str, classes: int) -> DataFrame:
    """``cells`` with ``probs``, rounded to nine places: an image's scores as they are where all of them are shares of 1, else their softmax.

    A cell without scores has its predicted class for certain; those don't count for the choice.
    """
    s = F.transform(scores, lambda x: x.cast("double"))
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    share = F.forall(s, lambda x: x >= -1e-5) & (F.abs(total - 1) <= 0.05 + 1e-5)
    kind = cells.groupBy("image_id").agg(F.bool_and(share).alias("__shares"))
    top = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - F.col("__top")))
    soft = F.transform("__e", lambda x: x / F.col("__sum"))
    own = cells.join(kind, "image_id").withColumn("__top", top).withColumn("__e", e).withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
    certain = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == F.col(pred), 1.0).otherwise(0.0))
    probs = F.when(F.col(scores).isNull(), certain).when(F.col("__shares"), s).otherwise(soft)
    return own.withColumn("probs", F.transform(probs, lambda x: F.round(x, 9))).drop("__shares", "__top", "__e", "__sum")


def proposal_edits(cells: DataFrame, pred: str, proposal: str, classes: int, confidence: float = 0.55, influence: float = 0.5, chosen: bool = False, support: float = 0.45) -> DataFrame:
    """``image_id, y, x, region, edited, changed, by``: cells with ``probs`` that take their proposal.

    A proposal of another class is taken in a reliable region where the model is uncertain (its best share is below
    ``confidence``) and the proposal has ``support``; or, if a style was ``chosen``, where influence is 0.75 or more and the
    proposal's share is 0.05 above the predicted one's. A chosen style adds 0.2 to the influence and 0.05 to the confidence,
    up to 1 and 0.95, and from an influence of 0.6 on three quarters of the support are enough. ``by`` says which rule held.
    """
    if chosen:
        influence, confidence = min(1.0, influence + 0.2), min(0.95, confidence + 0.05)
    p, q = F.col(proposal), F.col(pred)
    own, model = F.get("probs", p.cast("int")), F.get("probs", q.cast("int"))
    enough = support * 0.75 if chosen and influence >= 0.6 else support
    live = F.col("region").isNotNull() & F.col("reliable") & (p != q) & p.between(0, classes - 1)
    supported = (F.array_max("probs") < confidence) & (own >= enough)
    assertive = (own >= F.round(model + 0.05, 9)) if chosen and influence >= 0.75 else F.lit(False)
    by = F.when(live & supported, "supported").when(live & assertive, "assertive")
    return cells.withColumn("by", by).select(*PLACE, "region", F.when(F.col("by").isNotNull(), p).otherwise(q).alias("edited"), F.col("by").isNotNull().alias("changed"), "by")


def region_edits(edits: DataFrame, regions: DataFrame) -> DataFrame:
    """``image_id, region, changed, supported, assertive, outcome`` of ``regions(image_id, region, reliable, reason)``: counts, and why none were made."""
    sums = edits.where("region is not null").groupBy(*REGION).agg(F.count_if("changed").alias("changed"), F.count_if(F.col("by") == "supported").alias("supported"), F.count_if(F.col("by") == "assertive").alias("assertive"))
    n = F.coalesce("changed", F.lit(0))
    out = F.when(~F.col("reliable"), F.col("reason")).when(n > 0, "edited").otherwise("no_confident_edits")
    return regions.join(sums, REGION, "left").select(*REGION, n.alias("changed"), F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("assertive", F.lit(0)).alias("assertive"), out.alias("outcome"))


def region_contacts(labelled: DataFrame) -> DataFrame:
    """Per region: ``area, contact, sides``: the share of its cells that have a cell of another region, or the outside, among their eight neighbours; and its cells' sides at the image's edge.

    ``labelled`` has ``image_id, y, x, code, region``; a cell's neighbours are read from windows over rows and columns.
    """
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    at = _beside(labelled)
    # The diagonal neighbours are those beside the cells above and below.
    for name, step in (("u", F.lag), ("d", F.lead)):
        for side, turn, by in (("l", F.lag, -1), ("r", F.lead, 1)):
            at = at.withColumn(f"__{side}", F.when(turn("x").over(row) == F.col("x") + by, turn("region").over(row)))
            at = at.withColumn(name + side, F.when(F.col(name).isNotNull(), step(f"__{side}").over(col)))
    inner = F.lit(True)
    for n in ("l", "r", "u", "d", "ul", "ur", "dl", "dr"):
        inner = inner & F.coalesce(F.col(n) == F.col("region"), F.lit(False))
    size = labelled.groupBy("image_id").agg(F.max("y").alias("__y"), F.max("x").alias("__x"))
    sides = sum(((F.col(c) == e).cast("int") for c, e in (("y", F.lit(0)), ("x", F.lit(0)), ("y", F.col("__y")), ("x", F.col("__x")))), F.lit(0))
    sums = at.join(size, "image_id").groupBy("image_id", "region", "code").agg(F.count(F.lit(1)).alias("area"), F.count_if(~inner).alias("__edge"), F.sum(sides).alias("sides"))
    return sums.select("image_id", "region", "code", "area", F.round(F.col("__edge") / F.col("area"), 6).alias("contact"), "sides")


def _beside(labelled: DataFrame) -> DataFrame:
    """``labelled`` with ``l, r, u, d``: the regions of the cells to the left, to the right, above and below; null outside."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    out = labelled
    for name, step, w, axis, by in (("l", F.lag, row, "x", -1), ("r", F.lead, row, "x", 1), ("u", F.lag, col, "y", -1), ("d", F.lead, col, "y", 1)):
        out = out.withColumn(name, F.when(step(axis).over(w) == F.col(axis) + by, step("region").over(w)))
    return out


def region_adjacency(labelled: DataFrame) -> DataFrame:
    """``image_id, region, neighbour, length, share``: sides of cells that two regions share, and their part of all the region's sides towards others."""
    near = F.array_compact(F.array(*[F.when(F.col(n) != F.col("region"), F.col(n)) for n in ("l", "r", "u", "d")]))
    pairs = _beside(labelled).select("image_id", "region", F.explode(near).alias("neighbour")).groupBy("image_id", "region", "neighbour").agg(F.count(F.lit(1)).alias("length"))
    return pairs.withColumn("share", F.round(F.col("length") / F.sum("length").over(W.partitionBy("image_id", "region")), 6))


def provisional_roles(contacts: DataFrame, palette: DataFrame, small: int = 64, contact: float = 0.8, outlines: int = 5) -> DataFrame:
    """``image_id, role, place, code, region, confidence, area, contact, border``: roles that codes and regions seem to have.

    Of ``region_contacts``, and ``palette(code, r, g, b)``. The code of most cells (ties: the smallest) is the background, of
    confidence 0.5 plus its coverage up to 0.95. ``border`` is the sides at the image's edge over the cells. The first
    ``outlines`` regions, by code and region, of at most ``small`` cells or a contact above ``contact`` are outlines, 0.4. The
    three darkest codes by Lab (ties by code), if there are three, are a shade family, 0.35. Confidences are rounded to six.
    """
    codes = contacts.groupBy("image_id", "code").agg(F.sum("area").alias("area"), F.sum("sides").alias("sides"))
    whole = W.partitionBy("image_id")
    codes = codes.withColumn("all", F.sum("area").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("area"), "code")))
    border = F.round(F.col("sides") / F.col("area"), 6).alias("border")
    none = lambda kind: F.lit(None).cast(kind)
    sure = F.round(F.least(F.lit(0.95), 0.5 + F.col("area") / F.col("all")), 6)
    region = dict(contacts.dtypes)["region"]
    ground = codes.where("place = 1").select("image_id", F.lit("background").alias("role"), "place", "code", none(region).alias("region"), sure.alias("confidence"), "area", none("double").alias("contact"), border)
    thin = contacts.where((F.col("area") <= small) | (F.col("contact") > contact)).withColumn("place", F.row_number().over(whole.orderBy("code", "region"))).where(F.col("place") <= outlines)
    thin = thin.select("image_id", F.lit("outline").alias("role"), "place", "code", "region", F.lit(0.4).alias("confidence"), "area", "contact", border)
    dark = codes.join(F.broadcast(palette.select("code", F.round(lab(F.col("r"), F.col("g"), F.col("b"))["l"], 6).alias("l"))), "code")
    dark = dark.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("place", F.row_number().over(whole.orderBy("l", "code"))).where("n >= 3 and place <= 3")
    dark = dark.select("image_id", F.lit("shade").alias("role"), "place", "code", none(region).alias("region"), F.lit(0.35).alias("confidence"), "area", none("double").alias("contact"), border)
    return ground.union(thin).union(dark)


def palette_rows(df: DataFrame, colors: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``code, r, g, b`` of a fixed palette."""
    return df.sparkSession.createDataFrame([(c, *rgb) for c, rgb in sorted(colors.items())], "code int, r int, g int, b int")


def region_number(y: Column, x: Column, width: int) -> Column:
    """A region's number: the place of its first cell in rows of ``width``."""
    return y * width + x
