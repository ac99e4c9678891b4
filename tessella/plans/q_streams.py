"""Queries that run a stream over the tables until it has read all, and of run logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import logs
from tessella.streaming import metrics as m

from . import views as v
from .registry import query, table


def events(s, d):
    stream = m.read_tables(s, d, "events.parquet", table(s, d, "events").schema)
    return stream.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "ts", "event_id", "value")


NAMED = "named AS (SELECT user_id AS run_id, event_type AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, value FROM events)"


@query("i1_smooth_stream", f"""WITH {NAMED} SELECT run_id, name, step, round(quantile_disc(value, 0.5) OVER w, 6) AS median, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS high, round(value, 6) AS last, round(avg(value) OVER (PARTITION BY run_id, name ORDER BY step), 6) AS global_mean
 FROM named WINDOW w AS (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    out = m.run_available(m.smooth_stream(events(s, d)))
    return out.select("run_id", "name", "step", *[F.round(c, 6).alias(c) for c in ("median", "mean", "high", "last", "global_mean")])


@query("i7_best_stream", f"WITH {NAMED} SELECT run_id, name, step, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM named) WHERE best IS NULL OR value > best")
def _(s, d):
    return m.run_available(m.best_stream(events(s, d))).withColumn("value", F.round("value", 6))


@query("i11_ingest_stream", "SELECT user_id, event_type FROM events GROUP BY ALL")
def _(s, d):
    stream = m.read_tables(s, d, "events.parquet", table(s, d, "events").schema)
    return m.run_available(m.ingest_stream(stream, ["user_id", "event_type"]).select("user_id", "event_type"))


@query("i3_step_timing", f"""WITH {v.STEPS}, t AS (SELECT run_id, step, epoch_us(ts) / 1e6 AS now_, lag(epoch_us(ts) / 1e6) OVER w AS was, first_value(epoch_us(ts) / 1e6) OVER w AS began FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step))
 SELECT run_id, step, round(now_ - was, 4) AS seconds, round(now_ - began, 4) AS total, round((now_ - began) / nullif(step - 1, 0) * (200 - step), 2) AS eta FROM t""")
def _(s, d):
    return logs.step_timing(v.steps(s, d), 200)


@query("i4_wide_log", f"WITH {v.STEPS} SELECT run_id, step, max(value) FILTER (name = 'click') AS click, max(value) FILTER (name = 'view') AS view, NULL::DOUBLE AS missing FROM steps WHERE NOT isnan(value) GROUP BY 1, 2")
def _(s, d):
    return logs.wide_log(v.steps(s, d), ["run_id", "step"], ["click", "view", "missing"])


@query("i5_latest_by_orientation", f"WITH {v.STEPS} SELECT run_id, name, step % 8 AS orientation, max(step) AS step, round(arg_max(value, step), 6) AS value FROM steps GROUP BY 1, 2, 3")
def _(s, d):
    return logs.latest(v.steps(s, d).withColumn("orientation", F.col("step") % 8), ["run_id", "name", "orientation"])


@query("i6_kind_score", f"""WITH {v.STEPS}, w AS (SELECT run_id, step, max(value) FILTER (name = 'purchase') AS a, max(value) FILTER (name = 'click') AS b, max(value) FILTER (name = 'view') AS c FROM steps GROUP BY 1, 2)
 SELECT run_id, step, round(coalesce(a, b, c), 6) AS score, CASE WHEN a IS NOT NULL THEN 'purchase' WHEN b IS NOT NULL THEN 'click' WHEN c IS NOT NULL THEN 'view' END AS source FROM w""")
def _(s, d):
    wide = logs.wide_log(v.steps(s, d), ["run_id", "step"], ["purchase", "click", "view"])
    return logs.kind_score(wide, ["purchase", "click", "view"]).select("run_id", "step", F.round("score", 6).alias("score"), "source")


@query("i7_best_by_kind", f"""WITH {v.STEPS}, k AS (SELECT run_id, step, value, CASE WHEN name IN ('click', 'view') THEN 'spatial' WHEN name = 'purchase' THEN 'holdout' ELSE 'capacity' END AS kind FROM steps), e AS (SELECT * FROM k UNION ALL SELECT run_id, step, value, 'overall' FROM k WHERE kind = 'holdout')
 SELECT run_id, kind, arg_max(step, value * 100000 - step) AS step, round(max(value), 6) AS value FROM e GROUP BY 1, 2""")
def _(s, d):
    kind = F.when(F.col("name").isin("click", "view"), "spatial").when(F.col("name") == "purchase", "holdout").otherwise("capacity")
    out = logs.best_by_kind(v.steps(s, d).withColumn("kind", kind), "run_id", "kind", "holdout")
    return out.withColumn("value", F.round("value", 6))


EARLY = f"""RECURSIVE {v.STEPS}, s AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) AS epoch, value FROM steps WHERE name = 'view'),
 r AS (SELECT run_id, epoch, value AS best, epoch AS best_epoch, 0 AS bad, false AS stopped FROM s WHERE epoch = 1 UNION ALL SELECT r.run_id, s.epoch, CASE WHEN s.value > r.best + 0.5 THEN s.value ELSE r.best END, CASE WHEN s.value > r.best + 0.5 THEN s.epoch ELSE r.best_epoch END,
 CASE WHEN s.value > r.best + 0.5 THEN 0 ELSE r.bad + 1 END, s.epoch >= 4 AND s.value <= r.best + 0.5 AND r.bad + 1 >= 3 FROM r JOIN s ON s.run_id = r.run_id AND s.epoch = r.epoch + 1 WHERE NOT r.stopped)"""


@query("i8_early_stop", f"WITH {EARLY} SELECT run_id, max(epoch) AS epochs, arg_max(best_epoch, epoch) AS best_epoch, round(arg_max(best, epoch), 6) AS best, arg_max(stopped, epoch) AS stopped FROM r GROUP BY 1")
def _(s, d):
    out = logs.early_stop(v.steps(s, d).where("name = 'view'"), "run_id", "step", least_epochs=4, delta=0.5, patience=3)
    return out.withColumn("best", F.round("best", 6))


@query("i12_eval_rows", f"WITH {v.STEPS} SELECT run_id % 3 AS model, name, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM steps GROUP BY 1, 2")
def _(s, d):
    return logs.eval_rows(v.steps(s, d).withColumn("model", F.col("run_id") % 3), ["model", "name"])


@query("i13_mean_meter", "SELECT event_type, round(sum(value * (1 + event_id % 4)) / sum(1 + event_id % 4), 6) AS mean, CAST(sum(1 + event_id % 4) AS BIGINT) AS n FROM events GROUP BY 1")
def _(s, d):
    return logs.mean_meter(table(s, d, "events").withColumn("size", 1 + F.col("event_id") % 4), ["event_type"], "value", "size")


@query("h29_merge_counters", "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS k, count(*) AS n FROM events GROUP BY user_id, event_type UNION ALL SELECT 'all', count(*) FROM events GROUP BY user_id) GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("t"))
    return logs.merge_counters(maps.select(F.map_concat("m", F.create_map(F.lit("all"), "t")).alias("m")), "m").select(F.col("key").alias("k"), "n")
