"""Queries of the evaluation operators (survey 2.J in part and 2.L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ioloom.operators import metrics
from ioloom.plans.core import r6, register, rounded
from ioloom.plans.sql import r6 as q6
from ioloom.sources import surrogate

DIMS = surrogate.PREDICTION_DIMS
_P = f"p AS ({surrogate.predictions_sql()})"
_LONG = f"{_P}, long AS (" + " UNION ALL ".join(f"SELECT job_id, benchmark, '{d}' AS dim, gt_{d} AS gt, pred_{d} AS pred, prob_{d} AS prob FROM p" for d in DIMS) + ")"
_COUNTS = "CAST(sum(gt * pred) AS BIGINT) AS tp, CAST(sum((1 - gt) * pred) AS BIGINT) AS fp, CAST(sum(gt * (1 - pred)) AS BIGINT) AS fn, CAST(sum((1 - gt) * (1 - pred)) AS BIGINT) AS tn"
_DIV = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
_SCORES = f"{q6(_DIV('tp', '(tp + fp)'))} AS precision, {q6(_DIV('tp', '(tp + fn)'))} AS recall, {q6(_DIV('2 * tp', '(2 * tp + fp + fn)'))} AS f1, tp + fn AS support"
_SCORED = ["precision", "recall", "f1"]


@register("L1_L8_per_label", f"WITH {_LONG}, c AS (SELECT dim, {_COUNTS} FROM long GROUP BY dim) SELECT dim, tp, fp, fn, tn, {_SCORES} FROM c")
def per_label(spark, sf_dir):
    return metrics.per_label(surrogate.predictions(spark, sf_dir), DIMS).select("dim", "tp", "fp", "fn", "tn", *rounded(*_SCORED), "support")


def _overall_sql(by: str, where: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""WITH {_LONG}, c AS (SELECT {b}dim, {_COUNTS} FROM long {where} GROUP BY {b}dim), s AS (SELECT *, {_DIV('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c)
SELECT {b}{q6(_DIV('sum(tp)', 'sum(tp + fp)'))} AS micro_precision, {q6(_DIV('sum(tp)', 'sum(tp + fn)'))} AS micro_recall, {q6(_DIV('2 * sum(tp)', 'sum(2 * tp + fp + fn)'))} AS micro_f1, {q6('avg(f1)')} AS macro_f1, {q6('coalesce(avg(f1) FILTER (tp + fn > 0), 0)')} AS macro_f1_supported FROM s {f'GROUP BY {by}' if by else ''}"""


_OVERALL = ["micro_precision", "micro_recall", "micro_f1", "macro_f1", "macro_f1_supported"]


@register("L2_L3_micro_macro", _overall_sql(""))
def micro_macro(spark, sf_dir):
    return metrics.overall(surrogate.predictions(spark, sf_dir), DIMS).select(*rounded(*_OVERALL))


@register("L10_per_benchmark", _overall_sql("benchmark"))
def per_benchmark(spark, sf_dir):
    return metrics.overall(surrogate.predictions(spark, sf_dir), DIMS, ["benchmark"]).select("benchmark", *rounded(*_OVERALL))


@register("L11_mapped_dims", _overall_sql("", f"WHERE dim IN ('{DIMS[0]}', '{DIMS[3]}', '{DIMS[5]}')"))
def mapped_dims(spark, sf_dir):
    return metrics.overall(surrogate.predictions(spark, sf_dir), [DIMS[0], DIMS[3], DIMS[5]]).select(*rounded(*_OVERALL))


_WRONG = " + ".join(f"CAST(gt_{d} <> pred_{d} AS INT)" for d in DIMS)
_TP = " + ".join(f"gt_{d} * pred_{d}" for d in DIMS)
_BOTH = " + ".join(f"gt_{d} + pred_{d}" for d in DIMS)


@register("L4_L7_row_scores", f"WITH {_P}, r AS (SELECT {_WRONG} AS wrong, {_TP} AS tp, {_BOTH} AS n FROM p) SELECT {q6(f'sum(wrong) / CAST(count(*) * {len(DIMS)} AS DOUBLE)')} AS hamming_loss, {q6('avg(CAST(wrong = 0 AS INT))')} AS subset_accuracy, {q6('avg(CAST(tp > 0 OR n = 0 AS INT))')} AS partial_match, {q6('avg(coalesce(2.0 * tp / nullif(n, 0), 0))')} AS samples_f1 FROM r")
def row_scores(spark, sf_dir):
    return metrics.row_scores(surrogate.predictions(spark, sf_dir), DIMS).select(*rounded("hamming_loss", "subset_accuracy", "partial_match", "samples_f1"))


@register("L9_agreement", f"""WITH {_LONG}, c AS (SELECT dim, {_COUNTS}, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY dim),
k AS (SELECT *, (tp + tn) / n AS seen, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn)) / (n * n) AS chance FROM c)
SELECT dim, {q6('seen')} AS agreement, {q6('CASE WHEN tp + fn = 0 OR fp + tn = 0 OR chance = 1 THEN 0 ELSE (seen - chance) / (1 - chance) END')} AS kappa, tp + fn = 0 AND tp + fp = 0 AS trivial FROM k""")
def agreement(spark, sf_dir):
    return metrics.agreement(surrogate.predictions(spark, sf_dir), DIMS).select("dim", *rounded("agreement", "kappa"), "trivial")


_T = "t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.05]) AS threshold)"
_SWEEP = [0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.05]


@register("L15_threshold_sweep", f"WITH {_LONG}, {_T}, x AS (SELECT CAST(threshold AS DOUBLE) AS threshold, gt, CAST(prob >= CAST(threshold AS DOUBLE) AS INT) AS pred FROM long, t), c AS (SELECT threshold, {_COUNTS} FROM x GROUP BY threshold) SELECT threshold, tp, fp, fn, tn, {_SCORES} FROM c")
def sweep(spark, sf_dir):
    return metrics.threshold_sweep(surrogate.predictions(spark, sf_dir), DIMS, _SWEEP).select("threshold", "tp", "fp", "fn", "tn", *rounded(*_SCORED), "support")


@register("L16_best_threshold", f"""WITH {_LONG}, g AS (SELECT unnest(generate_series(1, 99)) / 100.0 AS threshold), x AS (SELECT dim, threshold, gt, CAST(prob >= threshold AS INT) AS pred FROM long, g), c AS (SELECT dim, threshold, {_COUNTS} FROM x GROUP BY dim, threshold),
f AS (SELECT dim, threshold, {_DIV('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY f1 DESC, threshold) AS k FROM f) SELECT dim, threshold, {q6('f1')} AS f1 FROM o WHERE k = 1""")
def best_threshold(spark, sf_dir):
    return metrics.best_thresholds(surrogate.predictions(spark, sf_dir), DIMS).select("dim", "threshold", *rounded("f1"))


@register("L17_ranking", f"""WITH {_LONG}, r AS (SELECT dim, gt, prob, rank() OVER (PARTITION BY dim ORDER BY prob) + (count(*) OVER (PARTITION BY dim, prob) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY dim ORDER BY prob DESC) AS taken, sum(gt) OVER (PARTITION BY dim ORDER BY prob DESC) AS hits FROM long),
a AS (SELECT dim, CAST(sum(gt) AS DOUBLE) AS p, CAST(sum(1 - gt) AS DOUBLE) AS n, sum(gt * rk) AS ranks, sum(gt * CAST(hits AS DOUBLE) / taken) AS steps, avg(prob) FILTER (gt = 1) AS m1, avg(prob) FILTER (gt = 0) AS m0 FROM r GROUP BY dim),
b AS (SELECT *, (ranks - p * (p + 1) / 2) / (p * n) AS auc FROM a)
SELECT dim, {q6('auc')} AS auc_roc, {q6('steps / p')} AS auc_pr, {q6('m1')} AS mean_positive, {q6('m0')} AS mean_negative, CASE WHEN auc > 0.7 THEN 'STRONG' WHEN auc > 0.5 THEN 'PARTIAL' ELSE 'INVERSE' END AS signal FROM b""")
def ranking(spark, sf_dir):
    return metrics.ranking(surrogate.predictions(spark, sf_dir), DIMS).select("dim", *rounded("auc_roc", "auc_pr", "mean_positive", "mean_negative"), "signal")


@register("L18_left_out_threshold", f"""WITH {_LONG}, g AS (SELECT unnest(generate_series(1, 99)) / 100.0 AS t), c AS (SELECT dim, t, sum(gt * CAST(prob >= t AS INT)) AS tp, sum(CAST(prob >= t AS INT)) AS p, sum(gt) AS g FROM long, g GROUP BY dim, t),
f AS (SELECT job_id, l.dim, t, coalesce(2.0 * (tp - gt * CAST(prob >= t AS INT)) / nullif(p - CAST(prob >= t AS INT) + g - gt, 0), 0) AS f1 FROM (SELECT DISTINCT dim, prob, gt, min(job_id) OVER (PARTITION BY dim, prob, gt) AS job_id FROM long) l JOIN c ON l.dim = c.dim),
o AS (SELECT dim, job_id, t, row_number() OVER (PARTITION BY dim, job_id ORDER BY f1 DESC, t) AS k FROM f),
w AS (SELECT l.dim, l.job_id, min(l.job_id) OVER (PARTITION BY l.dim, l.prob, l.gt) AS first_id FROM long l)
SELECT w.job_id, w.dim, CAST(t AS DOUBLE) AS threshold FROM w JOIN o ON w.dim = o.dim AND w.first_id = o.job_id WHERE k = 1""")
def left_out(spark, sf_dir):
    return metrics.left_out_thresholds(surrogate.predictions(spark, sf_dir), DIMS, [i / 100 for i in range(1, 100)])


_GTS = "list_sort([x for x in [" + ", ".join(f"CASE WHEN gt_{d} = 1 THEN '{d}' END" for d in DIMS) + "] if x IS NOT NULL])"


@register("J11_L19_set_scores", f"WITH {_P}, r AS (SELECT benchmark, {_TP} AS tp, {' + '.join(f'pred_{d}' for d in DIMS)} AS np, {' + '.join(f'gt_{d}' for d in DIMS)} AS ng FROM p) SELECT benchmark, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(ng - tp) AS BIGINT) AS fn, {q6('avg(coalesce(CAST(tp AS DOUBLE) / nullif(np, 0), 1))')} AS precision, {q6('avg(coalesce(CAST(tp AS DOUBLE) / nullif(ng, 0), 1))')} AS recall FROM r GROUP BY benchmark")
def set_scores(spark, sf_dir):
    rows = metrics.set_scores(surrogate.predictions(spark, sf_dir), DIMS, ["benchmark"])
    return rows.groupBy("benchmark").agg(*[F.sum(F.size(c)).alias(c) for c in ("tp", "fp", "fn")], r6(F.avg("precision")).alias("precision"), r6(F.avg("recall")).alias("recall"))


@register("L12_bootstrap")
def bootstrap(spark, sf_dir):
    return metrics.bootstrap(surrogate.predictions(spark, sf_dir), DIMS)


@register("L13_paired_bootstrap")
def paired(spark, sf_dir):
    p = surrogate.predictions(spark, sf_dir).withColumns({f"base_{d}": (F.col(f"prob_{d}") >= 0.5).cast("int") for d in DIMS})
    return metrics.bootstrap(p, DIMS, other="base")


@register("L20_latency", f"SELECT event_type, {', '.join(f'{q6(e)} AS {n}' for n, e in (('mean', 'avg(value)'), ('std', 'stddev_pop(value)'), ('p50', 'quantile_cont(value, 0.5)'), ('p95', 'quantile_cont(value, 0.95)'), ('p99', 'quantile_cont(value, 0.99)'), ('min', 'min(value)'), ('max', 'max(value)')))} FROM events GROUP BY event_type")
def latency(spark, sf_dir):
    return metrics.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type").select("event_type", *rounded("mean", "std", "p50", "p95", "p99", "min", "max"))


@register("L21_compare_runs", f"""WITH {_LONG}, o AS (SELECT dim, {_COUNTS} FROM long GROUP BY dim), n AS (SELECT dim, {_COUNTS.replace('pred', 'CAST(prob >= 0.5 AS INT)')} FROM long WHERE dim <> '{DIMS[0]}' GROUP BY dim)
SELECT coalesce(o.dim, n.dim) AS dim, {q6(_DIV('2 * o.tp', '(2 * o.tp + o.fp + o.fn)'))} AS "old", CASE WHEN n.dim IS NOT NULL THEN {q6(_DIV('2 * n.tp', '(2 * n.tp + n.fp + n.fn)'))} END AS "new" FROM o FULL JOIN n ON o.dim = n.dim""")
def compare(spark, sf_dir):
    p = surrogate.predictions(spark, sf_dir)
    new = p.withColumns({f"pred_{d}": (F.col(f"prob_{d}") >= 0.5).cast("int") for d in DIMS})
    return metrics.compare_runs(metrics.per_label(p, DIMS), metrics.per_label(new, DIMS[1:]), "dim", "f1").select("dim", *rounded("old", "new"))
