"""Statistics of a dataset at several grains, as rows of name and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.quantiles import count_rows, mean_value, percentile, ranked_values


def _long(df: DataFrame, values: list[tuple[str, str | Column, Column]]) -> DataFrame:
    """``section, name, value`` of each row of ``df``; a name is text or a column."""
    name = lambda n: n if isinstance(n, Column) else F.lit(n)
    return df.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), name(n).alias("name"), F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 6).alias("value")) for s, n, c in values])))


def dataset_stats(images: DataFrame, components: DataFrame, crops: DataFrame, classes: list[int], tiny: int = 64) -> DataFrame:
    """``section, name, value`` of a dataset.

    ``images`` has ``status, split, width, height, candidates, code_*``; ``components`` has ``area``; ``crops`` has ``split,
    strategy, tiny, code_*``. Images are counted by status and by split, with sizes, candidates and classes over all, in one
    pass by grouping sets; so are crops by split and strategy. Component sizes have exact percentiles. A dataset without
    images, components or crops has zeros.
    """
    total = [F.sum(f"code_{c}").alias(f"code_{c}") for c in classes]
    a = images.groupingSets([["status"], ["split"], []], "status", "split").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("candidates").alias("candidates"), *total, *[f(c).alias(f"{c}_{m}") for c in ("width", "height") for m, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )
    n = F.col("n")
    out = _long(a.where("g = 1"), [("images by status", F.coalesce("status", F.lit("none")), n)])
    out = out.union(_long(a.where("g = 2"), [("images by split", F.coalesce("split", F.lit("none")), n)]))
    sizes = [("images", f"{c}_{m}", F.col(f"{c}_{m}")) for c in ("width", "height") for m in ("min", "max", "mean")]
    out = out.union(_long(a.where("g = 3"), [("images", "count", n), ("images", "candidates", F.col("candidates")), *sizes, *[("classes", f"code_{c}", F.col(f"code_{c}")) for c in classes]]))
    area = ranked_values(components, "area").agg(count_rows().alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), mean_value().alias("mean"), percentile(0.5).alias("p50"), percentile(0.9).alias("p90"), F.sum(F.when(F.col("value") <= tiny, F.col("n"))).alias("tiny"))
    out = out.union(_long(area, [("components", m, F.col(c)) for m, c in (("count", "n"), ("min", "low"), ("max", "high"), ("mean", "mean"), ("median", "p50"), ("p90", "p90"), ("tiny", "tiny"))]))
    b = crops.groupingSets([["split"], ["strategy"], []], "split", "strategy").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("tiny").alias("tiny"), *total)
    out = out.union(_long(b.where("g = 1"), [("crops by split", F.coalesce("split", F.lit("none")), n)])).union(_long(b.where("g = 2"), [("crops by strategy", F.coalesce("strategy", F.lit("none")), n)]))
    out = out.union(_long(b.where("g = 3"), [("crops", "count", n), ("crops", "tiny", F.col("tiny")), *[("crops", f"code_{c}", F.col(f"code_{c}")) for c in classes]]))
    # Grouping sets have no row at all where there is no input.
    by_class = [f"code_{c}" for c in classes]
    names = [("images", ["count", "candidates", *[x[1] for x in sizes]]), ("classes", by_class), ("crops", ["count", "tiny", *by_class])]
    zeros = images.sparkSession.createDataFrame([(s, x, 0.0) for s, own in names for x in own], "section string, name string, value double")
    return out.union(zeros).groupBy("section", "name").agg(F.sum("value").alias("value"))
