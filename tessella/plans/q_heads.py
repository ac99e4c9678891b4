"""Queries of several heads by several metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import heads as h

from .q_scoring import CLASSES, PREDS, preds
from .registry import query

METRICS = ["mean_accuracy", "mean_per_class_accuracy", "per_class_accuracy", "mean_multiclass_f1", "mean_per_class_multiclass_f1", "macro_averaged_mean_reciprocal_rank", "any_match_accuracy", "mean_per_class_multilabel_f1", "macro_multilabel_average_precision", "auroc"]


def evaluated(s, d):
    rows = preds(s, d)
    half = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.when(i < 5, F.get("scores", i)).otherwise(0.0))
    own = {"plain": F.col("scores"), "half": half, "reversed": F.reverse("scores")}
    return h.evaluate(rows, own, METRICS, CLASSES, index="test_id")


HEADS = f"""{PREDS}, hd AS (SELECT test_id, target, targets, 'plain' AS head, scores FROM preds UNION ALL SELECT test_id, target, targets, 'half', list_transform(scores, lambda v, i: CASE WHEN i <= 5 THEN v ELSE 0 END) FROM preds UNION ALL SELECT test_id, target, targets, 'reversed', list_reverse(scores) FROM preds),
 lg AS MATERIALIZED (SELECT head, test_id, target, c::INT AS c, scores[c + 1] AS s, scores[target + 1] AS own, CAST(list_contains(targets, c::INT) AS INT) AS truth FROM hd, (SELECT unnest(range({CLASSES})) AS c)),
 rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY head, test_id ORDER BY s DESC, c) AS r FROM lg),
 ac AS (SELECT head, k, target AS class, avg(CAST(r <= k AS INT)) AS a, sum(CAST(r <= k AS INT)) AS hit, count(*) AS n FROM rk, (VALUES (1), (5)) ks(k) WHERE c = target GROUP BY ALL),
 f0 AS (SELECT head, c, count(*) FILTER (r = 1 AND c = target) AS tp, count(*) FILTER (c = target) AS n, count(*) FILTER (r = 1) AS p FROM rk GROUP BY 1, 2), f1 AS (SELECT * FROM f0 WHERE n + p > 0),
 wr AS (SELECT head, k, class, a FROM ac UNION ALL SELECT head, 1, c, 0 FROM f1 WHERE n = 0),
 mr AS (SELECT head, sum(x) / {CLASSES} AS v FROM (SELECT head, target, sum(q) / (count(*) + 1e-6::DOUBLE) AS x FROM (SELECT head, test_id, target, 1.0::DOUBLE / count(*) FILTER (s >= own) AS q FROM lg GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1),
 am AS (SELECT head, k, avg(CAST(m <= k AS INT)) AS v FROM (SELECT head, test_id, min(r) AS m FROM rk WHERE truth = 1 GROUP BY 1, 2), (VALUES (1), (5)) ks(k) GROUP BY 1, 2),
 ml AS (SELECT head, avg(coalesce(2 * tp / nullif(n + p, 0), 0)) AS v FROM (SELECT head, c, count(*) FILTER (truth = 1 AND s > 0.5) AS tp, sum(truth) AS n, count(*) FILTER (s > 0.5) AS p FROM lg GROUP BY 1, 2) GROUP BY 1),
 cv AS (SELECT head, c, s, sum(truth) AS pos, sum(1 - truth) AS neg FROM lg GROUP BY 1, 2, 3), cu AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER w AS p, sum(neg) OVER w AS m FROM cv WINDOW d AS (PARTITION BY head, c ORDER BY s DESC), w AS (PARTITION BY head, c)),
 pr AS (SELECT head, c, CASE WHEN max(m) > 0 THEN sum(pos * (m - fp + neg / 2)) / max(p * m) END AS au, sum(pos / p * tp / (tp + fp)) AS ap FROM cu WHERE p > 0 GROUP BY 1, 2),
 al AS (SELECT head, 'mean_accuracy' AS metric, k, -1 AS class, sum(hit) / sum(n) AS v FROM ac GROUP BY 1, 3 UNION ALL SELECT head, 'mean_per_class_accuracy', k, -1, avg(a) FROM wr GROUP BY 1, 3 UNION ALL SELECT head, 'per_class_accuracy', k, class, a FROM ac
  UNION ALL SELECT head, 'mean_multiclass_f1', 1, -1, 2 * sum(tp) / sum(n + p) FROM f1 GROUP BY 1 UNION ALL SELECT head, 'mean_per_class_multiclass_f1', 1, -1, avg(2 * tp / (n + p)) FROM f1 GROUP BY 1 UNION ALL SELECT head, 'macro_averaged_mean_reciprocal_rank', 1, -1, v FROM mr
  UNION ALL SELECT head, 'any_match_accuracy', k, -1, v FROM am UNION ALL SELECT head, 'mean_per_class_multilabel_f1', 1, -1, v FROM ml UNION ALL SELECT head, 'macro_multilabel_average_precision', 1, -1, avg(ap) FROM pr GROUP BY 1 UNION ALL SELECT head, 'auroc', 1, -1, avg(au) FROM pr GROUP BY 1)"""


@query("g18_evaluate_heads", f"WITH {HEADS} SELECT head, metric, k, class, round(v, 6)::DOUBLE AS value FROM al")
def _(s, d):
    return evaluated(s, d)
