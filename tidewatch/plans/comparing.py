"""Queries on drift-detection metrics, statistical comparison and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive
from ..operators import compare as C
from ..operators import drift as D
from ..operators import leaderboard as L
from ..operators import rolling as R
from .catalog import query
from .drifting import OBSERVED, detector_ctes, observed
from .shared import AT, FC, H, PLACE, ST, S, W, decided, events, p_sql, rounded, runs_sql

# true drifts: each seventh window; detections: the flagged ones
_TRUTH = "tr AS (SELECT entity_id, window_id AS step FROM ob WHERE window_id % 7 = 3), fo AS (SELECT entity_id, window_id AS step FROM ob WHERE drift)"


def _truth(spark, d):
    o = observed(spark, d).select("entity_id", "drift_detected", F.col("window_id").alias("step"), F.col("mae").alias("error"))
    return o, o.where("step % 7 = 3"), o.where("drift_detected")


@query(f"""WITH {OBSERVED}, {_TRUTH}, j AS (SELECT entity_id, step, (SELECT min(fo.step) FROM fo WHERE fo.entity_id = tr.entity_id AND fo.step >= tr.step) - step AS delay FROM tr)
SELECT entity_id, count(*) AS n_true, count(delay) AS n_detected, round(avg(delay), 6) AS mean_delay_steps, CAST(max(delay) AS DOUBLE) AS max_delay_steps, round(avg(delay) * 24.0::DOUBLE, 6) AS mean_delay_hours, max(delay) * 24.0::DOUBLE AS max_delay_hours FROM j GROUP BY 1""")
def detection_delay(spark, d):
    _, t, f = _truth(spark, d)
    return rounded(C.detection_delay(t, f, "entity_id", step_hours=24.0))


@query(f"""WITH {OBSERVED}, {_TRUTH}, fp AS (SELECT entity_id, count(*) AS fp FROM fo WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.entity_id = fo.entity_id AND abs(tr.step - fo.step) <= 1) GROUP BY 1),
a AS (SELECT entity_id, count(*) AS nt FROM tr GROUP BY 1), b AS (SELECT entity_id, count(*) AS nf FROM fo GROUP BY 1)
SELECT entity_id, coalesce(fp, 0) AS false_positives, round(coalesce(fp, 0) / 100.0::DOUBLE, 6) AS false_positive_rate, round((coalesce(nf, 0) - coalesce(fp, 0)) / nt, 6) AS detection_rate FROM a LEFT JOIN b USING (entity_id) LEFT JOIN fp USING (entity_id)""")
def false_positive(spark, d):
    _, t, f = _truth(spark, d)
    return rounded(C.false_positives(t, f, 100, "entity_id", window=1))


_BASE = "bs AS (SELECT entity_id, avg(mae) AS b FROM ob GROUP BY 1), er AS (SELECT entity_id, window_id AS step, mae AS error, b FROM ob JOIN bs USING (entity_id))"


def _errors(spark, d):
    o, _, _ = _truth(spark, d)
    base = o.groupBy("entity_id").agg(F.avg("error").alias("b"))
    return o.join(base, "entity_id")


@query(f"WITH {OBSERVED}, {_BASE} SELECT entity_id, min(CASE WHEN error <= b * 1.1 THEN step END) - min(step) AS recovery_steps FROM er WHERE step >= 3 GROUP BY 1")
def recovery_time(spark, d):
    return C.recovery_time(_errors(spark, d), F.lit(3), F.col("b"), "entity_id")


@query(f"""WITH {OBSERVED}, {_BASE}, dg AS (SELECT *, greatest(0.0::DOUBLE, error - b) AS d, lead(greatest(0.0::DOUBLE, error - b)) OVER (PARTITION BY entity_id ORDER BY step) AS n FROM er)
SELECT entity_id, round(coalesce(sum((d + n) / 2), 0), 6) AS area, round(max(d), 6) AS max_degradation, round(avg(d), 6) AS mean_degradation FROM dg GROUP BY 1""")
def degradation_area(spark, d):
    return rounded(C.degradation(_errors(spark, d), F.col("b"), "entity_id"))


@query(f"""WITH {OBSERVED}, rk AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY score) + (count(*) OVER (PARTITION BY entity_id, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY entity_id ORDER BY mae) + (count(*) OVER (PARTITION BY entity_id, mae) - 1) / 2.0::DOUBLE AS rm FROM (SELECT entity_id, round(score, 9) AS score, mae FROM ob))
SELECT entity_id, round(corr(score, mae), 6) AS pearson, round(corr(rs, rm), 6) AS spearman FROM rk GROUP BY 1""")
def magnitude_corr(spark, d):
    o = observed(spark, d).select("entity_id", F.round("drift_score", 9).alias("drift_score"), "mae")
    return rounded(C.correlations(o, "drift_score", "mae", "entity_id"))


@query(f"""WITH {OBSERVED}, {_TRUTH}, j AS (SELECT entity_id, step, (SELECT min(fo.step) FROM fo WHERE fo.entity_id = tr.entity_id AND fo.step >= tr.step) - step AS delay FROM tr),
dl AS (SELECT entity_id, count(*) AS n_true, count(delay) AS n_detected, round(avg(delay), 6) AS mean_delay_steps, CAST(max(delay) AS DOUBLE) AS max_delay_steps, round(avg(delay), 6) AS mean_delay_hours, CAST(max(delay) AS DOUBLE) AS max_delay_hours FROM j GROUP BY 1),
fp AS (SELECT entity_id, count(*) AS fp FROM fo WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.entity_id = fo.entity_id AND abs(tr.step - fo.step) <= 1) GROUP BY 1), nf AS (SELECT entity_id, count(*) AS nf FROM fo GROUP BY 1),
ft AS (SELECT entity_id, min(step) AS t0 FROM tr GROUP BY 1), bs AS (SELECT entity_id, avg(mae) AS b FROM ob JOIN ft USING (entity_id) WHERE window_id < t0 GROUP BY 1),
er AS (SELECT entity_id, window_id AS step, mae AS error, b FROM ob JOIN ft USING (entity_id) JOIN bs USING (entity_id) WHERE window_id >= t0),
rc AS (SELECT entity_id, min(CASE WHEN error <= b * 1.1 THEN step END) - min(step) AS recovery_steps FROM er GROUP BY 1),
dg AS (SELECT *, greatest(0.0::DOUBLE, error - b) AS d, lead(greatest(0.0::DOUBLE, error - b)) OVER (PARTITION BY entity_id ORDER BY step) AS n FROM er),
da AS (SELECT entity_id, round(coalesce(sum((d + n) / 2), 0), 6) AS area, round(max(d), 6) AS max_degradation, round(avg(d), 6) AS mean_degradation FROM dg GROUP BY 1)
SELECT dl.*, coalesce(fp, 0) AS false_positives, round(coalesce(fp, 0) / 100.0::DOUBLE, 6) AS false_positive_rate, round((coalesce(nf, 0) - coalesce(fp, 0)) / n_true, 6) AS detection_rate, recovery_steps, area, max_degradation, mean_degradation
FROM dl LEFT JOIN fp USING (entity_id) LEFT JOIN nf USING (entity_id) LEFT JOIN rc USING (entity_id) LEFT JOIN da USING (entity_id)""")
def drift_benchmark(spark, d):
    o, t, f = _truth(spark, d)
    return rounded(C.drift_benchmark(o, t, f, 100, "entity_id", window=1))


def _pairs(spark, d):
    s = events(spark, d)
    a = R.predictions(s, AT, "naive").select("entity_id", "window_id", "h", "y_true", F.col("y_pred").alias("p1"))
    b = R.predictions(s, AT, "seasonal_naive").select("entity_id", "window_id", "h", F.col("y_pred").alias("p2"))
    j = a.join(b, ["entity_id", "window_id", "h"])
    return j.withColumn("idx", F.col("window_id") * AT.forecast + F.col("h")).withColumn("d", F.abs(F.col("y_true") - F.col("p1")) - F.abs(F.col("y_true") - F.col("p2")))


_PAIRS = f"{W}, {p_sql('naive', 'each', 'p1')}, {p_sql('seasonal_naive', 'each', 'p2')}, pr AS (SELECT entity_id, window_id, h, p1.y_true, p1.y_pred AS a, p2.y_pred AS b, abs(p1.y_true - p1.y_pred) - abs(p1.y_true - p2.y_pred) AS d FROM p1 JOIN p2 USING (entity_id, window_id, h))"


@query(f"""WITH {_PAIRS}, l AS (SELECT *, lag(d) OVER (PARTITION BY entity_id ORDER BY window_id, h) AS l1 FROM pr), v AS (SELECT entity_id, count(d) AS n, avg(d) AS m, (var_samp(d) + 2 * covar_samp(d, l1)) / count(d) AS v FROM l GROUP BY 1)
SELECT entity_id, n, round(m, 6) AS mean_diff, round(CASE WHEN v > 0 THEN m / sqrt(v) END, 5) AS statistic FROM v""")
def diebold_mariano(spark, d):
    s = C.diebold_mariano(_pairs(spark, d), "entity_id", h=2)
    return s.select("entity_id", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("statistic", 5).alias("statistic"))


@query(f"""WITH {_PAIRS}, l AS (SELECT *, lag(d) OVER (PARTITION BY entity_id ORDER BY window_id, h) AS l1 FROM pr), v AS (SELECT entity_id, count(d) AS n, avg(d) AS m, (var_samp(d) + 2 * covar_samp(d, l1)) / count(d) AS v FROM l GROUP BY 1),
z AS (SELECT entity_id, n, m, CASE WHEN v > 0 THEN m / sqrt(v) END AS z FROM v), q AS (SELECT *, CASE WHEN abs(z) > 6 THEN 0.0::DOUBLE WHEN z = 0 THEN 1.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100),
lambda k: (1 - 2 * (k % 2)) / (2 * k + 1) * exp((2 * k + 1) * ln(abs(z) / sqrt(2)) - lgamma(k + 1)))) END AS p FROM z)
SELECT entity_id, n, round(m, 6) AS mean_diff, round(z, 5) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant FROM q""")
def diebold_mariano_p(spark, d):
    t = C.with_normal_p(C.diebold_mariano(_pairs(spark, d), "entity_id", h=2))
    return rounded(t.withColumn("statistic", F.round("statistic", 5)))


@query(f"""WITH {_PAIRS}, z AS (SELECT entity_id, round(d, 9) AS d FROM pr WHERE d IS NOT NULL AND round(d, 9) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY entity_id, abs(d)) - 1) / 2.0::DOUBLE AS r FROM z),
x AS (SELECT entity_id, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1) SELECT *, CASE WHEN n >= 10 THEN least(w_plus, w_minus) END AS statistic FROM x""")
def wilcoxon_stat(spark, d):
    return C.wilcoxon(_pairs(spark, d).select("entity_id", F.round("d", 9).alias("d")), "entity_id")


def _wilcoxon_sql(*by: str) -> str:
    keys = ", ".join(by)
    exact = """least(1.0::DOUBLE, 2 * list_sum(list_reduce(list_transform(range(1, n + 1), lambda k: [k::DOUBLE]), lambda c, k: list_transform(range(0, n * (n + 1) // 2 + 1), lambda i: (c[i + 1] + CASE WHEN i >= k[1] THEN c[i + 1 - k[1]::INT] ELSE 0 END) / 2),
list_transform(range(0, n * (n + 1) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))[1 : w::INT + 1]))"""
    normal = """CASE WHEN abs(z) > 6 THEN 0.0::DOUBLE WHEN z = 0 THEN 1.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda k: (1 - 2 * (k % 2)) / (2 * k + 1) * exp((2 * k + 1) * ln(abs(z) / sqrt(2)) - lgamma(k + 1)))) END"""
    return f"""WITH {_PAIRS}, z AS (SELECT {keys}, round(d, 9) AS d FROM pr WHERE d IS NOT NULL AND round(d, 9) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys}, abs(d)) AS t FROM z),
x AS (SELECT {keys}, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
y AS (SELECT {keys}, n, CASE WHEN n >= 10 THEN w END AS w, n >= 10 AND n <= 50 AND ties = 0 AS exact, (w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM x),
p AS (SELECT *, CASE WHEN w IS NULL THEN NULL WHEN exact THEN {exact} ELSE {normal} END AS p FROM y) SELECT {keys}, n, w AS statistic, exact, round(p + 1e-9::DOUBLE, 6) AS p_value, p < 0.05 AS significant FROM p"""


def _tested(spark, d, *by: str):
    return rounded(C.wilcoxon_test(_pairs(spark, d).withColumn("d", F.round("d", 9)), *by).withColumn("p_value", F.col("p_value") + 1e-9))


@query(_wilcoxon_sql("entity_id"))
def wilcoxon_p_value(spark, d):
    return _tested(spark, d, "entity_id")


@query(_wilcoxon_sql("entity_id", "window_id"))
def wilcoxon_window_p_value(spark, d):
    return _tested(spark, d, "entity_id", "window_id")


@query()
def bootstrap(spark, d):
    return rounded(C.bootstrap(_pairs(spark, d).select("entity_id", "d"), 1000, 42, True, "entity_id"))


def _losses(spark, d):
    s = events(spark, d)
    out = None
    for m, p in (("naive", "each"), ("seasonal_naive", "each"), ("naive", "fixed_retrain")):
        one = R.predictions(s, AT, m, p).select(F.lit(f"{m}/{p}").alias("model"), F.concat_ws(":", "entity_id", "window_id", "h").alias("idx"), F.abs(F.col("y_true") - F.col("y_pred")).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


_LOSSES = f"""{W}, {p_sql('naive', 'each', 'p1')}, {p_sql('seasonal_naive', 'each', 'p2')}, {p_sql('naive', 'fixed_retrain', 'p3')},
ls AS ({' UNION ALL '.join(f"SELECT '{n}' AS model, entity_id, window_id, h, abs(y_true - y_pred) AS loss FROM {p}" for n, p in (('naive/each', 'p1'), ('seasonal_naive/each', 'p2'), ('naive/fixed_retrain', 'p3')))}),
dd AS (SELECT a.model AS model1, b.model AS model2, a.loss - b.loss AS d FROM ls a JOIN ls b USING (entity_id, window_id, h) WHERE a.model < b.model),
pw AS (SELECT model1, model2, avg(d) AS m, var_samp(d) AS v, count(d) AS n FROM dd GROUP BY 1, 2)"""
_WINNER = "CASE WHEN m < 0 THEN model1 WHEN m > 0 THEN model2 ELSE 'tie' END"


@query(f"WITH {_LOSSES} SELECT model1, model2, round(m, 6) AS mean_diff, round(CASE WHEN v > 0 THEN m / sqrt(v / n) END, 5) AS statistic, {_WINNER} AS winner FROM pw")
def pairwise_models(spark, d):
    p = C.pairwise(_losses(spark, d))
    return p.select("model1", "model2", F.round("mean_diff", 6).alias("mean_diff"), F.round("statistic", 5).alias("statistic"), "winner")


@query(f"WITH {_LOSSES} SELECT {_WINNER} AS winner, count(*) AS wins FROM pw WHERE m <> 0 GROUP BY 1")
def pairwise_wins(spark, d):
    return C.wins(C.pairwise(_losses(spark, d)))


def runs(spark, d):
    return adaptive.run_table(events(spark, d), AT, {m: decided(spark, d, m) for m in PLACE})


_R = runs_sql()


@query(f"{_R} SELECT dataset, strategy, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape, retrain_total, n_windows FROM runs")
def all_runs(spark, d):
    return rounded(runs(spark, d))


@query(f"{_R}, rr AS (SELECT dataset, strategy, model, round(mae, 6) AS mae FROM runs), k AS (SELECT *, rank() OVER (PARTITION BY dataset, model ORDER BY mae) AS rank FROM rr) SELECT dataset, model, strategy, mae, CAST(rank AS INT) AS rank, rank = 1 AS best FROM k")
def strategy_rank(spark, d):
    return C.rank_strategies(rounded(runs(spark, d)))


# ranked on series whose second half is moved up: the true drift is the first window with moved test rows
_RANKED, _MOVE = ("adwin", "psi", "wasserstein"), 60.0
_MOVED = f"""{S.replace("s AS (", "s0 AS (", 1)}, half AS (SELECT entity_id, count(*) // 2 AS c FROM s0 GROUP BY 1),
s AS (SELECT entity_id, timestamp, target + CASE WHEN pos >= c THEN {_MOVE}::DOUBLE ELSE 0 END AS target, pos FROM s0 JOIN half USING (entity_id))"""


@query(f"""WITH RECURSIVE {detector_ctes(_RANKED, _MOVED)}, fd AS ({" UNION ALL ".join(f"SELECT '{k}' AS detector, entity_id, k AS step, drift FROM f_{k} WHERE k >= 0" for k in _RANKED)}),
tr AS (SELECT entity_id, greatest(0, (c - {H + FC}) // {ST} + 1) AS due FROM half), en AS (SELECT detector, entity_id, count(*) AS n, count(*) FILTER (drift AND abs(step - due) > 10) AS fp, min(CASE WHEN drift AND step >= due THEN step - due END) AS delay FROM fd JOIN tr USING (entity_id) GROUP BY 1, 2),
ds AS (SELECT detector, count(delay) / count(*) AS detection_rate, sum(fp) / sum(n) AS false_positive_rate, coalesce(avg(delay), 1e9) AS mean_delay FROM en GROUP BY 1),
k AS (SELECT detector, row_number() OVER (ORDER BY detection_rate DESC, detector) AS a, row_number() OVER (ORDER BY false_positive_rate, detector) AS b, row_number() OVER (ORDER BY mean_delay, detector) AS c FROM ds)
SELECT detector, CAST(a AS INT) AS rate_rank, CAST(b AS INT) AS fpr_rank, CAST(c AS INT) AS delay_rank, round((a + b + c) / 3.0::DOUBLE, 6) AS mean_rank FROM k""")
def detector_rank(spark, d):
    s = events(spark, d)
    half = s.groupBy("entity_id").agg(F.floor(F.count("*") / 2).alias("c"))
    s = s.join(half, "entity_id").withColumn("target", F.col("target") + F.when(F.col("pos") >= F.col("c"), _MOVE).otherwise(0.0)).drop("c")
    rows, ref = R.predictions(s, AT), s.where((F.col("pos") < H) & F.col("target").isNotNull()).select("entity_id", "pos", F.col("target").alias("x"))
    found = None
    for kind in _RANKED:
        one = D.detect_windows(rows, ref, kind, on="target").select(F.lit(kind).alias("detector"), "entity_id", F.col("window_id").alias("step"), "drift_detected")
        found = one if found is None else found.unionByName(one)
    at = F.greatest(F.lit(0), F.floor((F.col("c") - (H + FC)) / ST) + 1).cast("bigint")
    seen = found.groupBy("detector", "entity_id").agg(F.count("*").alias("n"))
    truth = seen.join(half, "entity_id").select("detector", "entity_id", at.alias("step"))
    hits = found.where("drift_detected")
    delay = C.detection_delay(truth, hits, "detector", "entity_id").select("detector", "entity_id", "n_true", "n_detected", "mean_delay_steps")
    false = C.false_positives(truth, hits, 1, "detector", "entity_id").select("detector", "entity_id", "false_positives")
    scores = seen.join(delay, ["detector", "entity_id"]).join(false, ["detector", "entity_id"]).groupBy("detector").agg(
        (F.sum("n_detected") / F.sum("n_true")).alias("detection_rate"), (F.sum("false_positives") / F.sum("n")).alias("false_positive_rate"), F.coalesce(F.avg("mean_delay_steps"), F.lit(1e9)).alias("mean_delay"),
    )
    return rounded(C.rank_detectors(scores))


for _key in ("model", "strategy"):

    def _board(spark, d, key=_key):
        return L.by(rounded(runs(spark, d)), key)

    _board.__name__ = f"{_key}_leaderboard"
    query(f"""{_R}, b AS (SELECT {_key}, round(avg(round(mae, 6)), 2) AS avg_mae, round(avg(round(rmse, 6)), 2) AS avg_rmse, CAST(sum(retrain_total) AS BIGINT) AS total_retrains, count(*) AS n_runs FROM runs GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY avg_mae, {_key}) AS INT) AS place FROM b""")(_board)


def _first(keys: str, order: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, strategy, model) AS rn FROM r6) WHERE rn = 1)"


_R6 = f"{_R}, r6 AS (SELECT * REPLACE (round(mae, 6) AS mae) FROM runs)"


@query(f"{_R6}, {_first('dataset', 'mae', 'b')} SELECT dataset, strategy, model, mae FROM b")
def best_per_dataset(spark, d):
    return L.best_per(rounded(runs(spark, d)), "dataset")


@query(f"{_R6}, {_first('dataset, strategy', 'mae', 'b')} SELECT dataset, strategy, model, mae FROM b")
def best_per_dataset_strategy(spark, d):
    return L.best_per(rounded(runs(spark, d)), "dataset", "strategy")


@query(f"""{_R6}, {_first('dataset', 'mae', 'b')}, {_first('dataset', 'mae DESC', 'x')} SELECT dataset, b.strategy || '/' || b.model AS best, b.mae AS best_mae, x.strategy || '/' || x.model AS worst, x.mae AS worst_mae,
round((x.mae - b.mae) / x.mae * 100, 6) AS improvement_pct FROM b JOIN x USING (dataset)""")
def dataset_best_worst(spark, d):
    return L.best_and_worst(rounded(runs(spark, d)))


_P = ", ".join(f"round(avg(mae) FILTER (strategy = '{s}'), 6) AS {s}" for s in ("no_retrain", "fixed_retrain", "adaptive_retrain"))


@query(f"{_R6} SELECT dataset, {_P} FROM r6 GROUP BY 1")
def heatmap_pivot(spark, d):
    return L.pivot(rounded(runs(spark, d)), "dataset", "strategy", ["no_retrain", "fixed_retrain", "adaptive_retrain"])


@query(f"{_R6} SELECT model, {_P} FROM r6 GROUP BY 1")
def model_strategy_pivot(spark, d):
    return L.pivot(rounded(runs(spark, d)), "model", "strategy", ["no_retrain", "fixed_retrain", "adaptive_retrain"])


@query(f"{_R6} SELECT dataset, round(avg(mae) FILTER (model = 'naive'), 6) AS naive, round(avg(mae) FILTER (model = 'seasonal_naive'), 6) AS seasonal_naive FROM r6 GROUP BY 1")
def dataset_model_pivot(spark, d):
    return L.pivot(rounded(runs(spark, d)), "dataset", "model", ["naive", "seasonal_naive"])


@query(f"{_R6} SELECT dataset, strategy, model, mae, retrain_total, row_number() OVER (PARTITION BY dataset ORDER BY mae, strategy, model) = 1 AS best FROM r6")
def comparison_cells(spark, d):
    return L.cells(rounded(runs(spark, d)))


_AF = f"{_R6}, af AS (SELECT dataset, model, max(mae) FILTER (strategy = 'adaptive_retrain') AS adaptive, max(mae) FILTER (strategy = 'fixed_retrain') AS fixed FROM r6 GROUP BY 1, 2)"


@query(f"{_AF} SELECT dataset, model, adaptive, fixed, round((fixed - adaptive) / fixed * 100, 6) AS improvement_pct, CASE WHEN adaptive < fixed THEN 'Adaptive' ELSE 'Fixed' END AS winner, abs((fixed - adaptive) / fixed * 100) > 10 AS significant FROM af")
def adaptive_vs_fixed(spark, d):
    return L.adaptive_vs_fixed(rounded(runs(spark, d)))


@query(f"""{_AF}, g AS (SELECT *, round((fixed - adaptive) / fixed * 100, 6) AS improvement_pct FROM af)
SELECT CAST(row_number() OVER (ORDER BY improvement_pct DESC, dataset, model) AS INT) AS place, dataset, model, adaptive, fixed, improvement_pct FROM g WHERE improvement_pct > 2""")
def adaptive_gains(spark, d):
    """Gains of more than 2 per cent: few runs on these series reach the published 10."""
    return L.adaptive_gains(rounded(runs(spark, d)), 2.0)


@query(f"{_AF} SELECT model, count(*) FILTER (adaptive < fixed) AS adaptive_wins, count(*) AS n FROM af GROUP BY 1")
def adaptive_win_counts(spark, d):
    return L.adaptive_wins(rounded(runs(spark, d)))


@query(f"""{_R6}, {_first('dataset, strategy', 'mae', 'b')}, c AS (SELECT *, (mae - min(mae) OVER (PARTITION BY dataset)) / nullif(max(mae) OVER (PARTITION BY dataset) - min(mae) OVER (PARTITION BY dataset), 0) AS sh FROM b)
SELECT dataset, strategy, model, mae, CASE WHEN coalesce(sh, 0) < 1.0::DOUBLE / 3 THEN 'good' WHEN sh < 2.0::DOUBLE / 3 THEN 'middle' ELSE 'poor' END AS band FROM c""")
def heat_bands(spark, d):
    return L.heat(rounded(runs(spark, d)))


@query(f"""{_R6}, c AS (SELECT *, min(mae) OVER (PARTITION BY dataset ORDER BY retrain_total, mae, strategy, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM r6)
SELECT dataset, strategy, model, mae, retrain_total, least IS NULL OR mae < least AS frontier FROM c""")
def cost_frontier(spark, d):
    return L.frontier(rounded(runs(spark, d)))


@query(f"{_R6} SELECT DISTINCT dataset FROM r6")
def datasets(spark, d):
    return runs(spark, d).select("dataset").distinct()


@query(f"{_R6} SELECT dataset, strategy, model, mae FROM r6 WHERE strategy = 'fixed_retrain' AND model = 'naive'")
def filtered_runs(spark, d):
    return L.filtered(rounded(runs(spark, d)), strategy="fixed_retrain", model="naive").select("dataset", "strategy", "model", "mae")


@query(f"""{_R6}, l AS (SELECT strategy, model, dataset, unnest(['mae', 'rmse']) AS metric, unnest([mae, rmse]) AS value FROM r6)
SELECT strategy, model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def seed_statistics(spark, d):
    r = runs(spark, d).withColumn("mae", F.round("mae", 6))
    long = r.unpivot(["strategy", "model", "dataset"], ["mae", "rmse"], "metric", "value").withColumnRenamed("dataset", "seed")
    return rounded(L.seed_statistics(long, "strategy", "model"))
