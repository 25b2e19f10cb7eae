"""Queries on rolling evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import models
from ..operators import rolling as R
from .catalog import query
from .shared import AT, FC, H, METRICS, RETRAINS, ST, VERSION, W, events, p_sql, rounded


@query(f"WITH {W} SELECT entity_id, window_id, step, window_id * {ST} AS train_start, window_id * {ST} + {H} AS test_start, window_id * {ST} + {H + FC} AS test_end FROM w")
def window_bounds(spark, d):
    return R.windows(events(spark, d), AT)


@query(f"WITH {W} SELECT entity_id, window_id, h, y_true FROM t")
def window_rows(spark, d):
    return R.test_rows(events(spark, d), AT).drop("timestamp")


@query(f"""WITH {W.replace(f'// {ST}', '// 12').replace(f'window_id * {ST}', 'window_id * 12')} SELECT entity_id, window_id, h, y_true FROM t""")
def overlapping_window_rows(spark, d):
    return R.test_rows(events(spark, d), R.Layout(H, FC, 12)).drop("timestamp")


def _by_entity(model: str, policy: str):
    def run(spark, d):
        return rounded(R.predictions(events(spark, d), AT, model, policy).groupBy("entity_id").agg(*M.all_metrics(), F.count("*").alias("n_predictions")))

    return run, f"WITH {W}, {p_sql(model, policy)} SELECT entity_id, {METRICS}, count(*) AS n_predictions FROM p GROUP BY 1"


for _name, _model, _policy in (
    ("naive_rolling_metrics", "naive", "each"), ("seasonal_naive_metrics", "seasonal_naive", "each"), ("no_retrain_metrics", "naive", "no_retrain"),
    ("fixed_policy_metrics", "naive", "fixed_retrain"), ("seasonal_fixed_metrics", "seasonal_naive", "fixed_retrain"),
):
    _run, _sql = _by_entity(_model, _policy)
    _run.__name__ = _name
    query(_sql)(_run)


@query(f"WITH {W}, {p_sql()} SELECT entity_id, {METRICS}, count(*) AS n_predictions FROM p GROUP BY 1")
def lstm_fallback_metrics(spark, d):
    return rounded(models.baseline(events(spark, d), AT, "lstm").groupBy("entity_id").agg(*M.all_metrics(), F.count("*").alias("n_predictions")))


@query(f"""WITH {W}, q AS (SELECT *, {VERSION['fixed_retrain'].format(k='step')} AS v FROM t), o AS (SELECT step AS v, entity_id AS ve, window_id AS vk FROM w),
p AS (SELECT q.*, s.target AS y_pred FROM q JOIN o USING (v) LEFT JOIN s ON s.entity_id = o.ve AND s.pos = o.vk * {ST} + {H} - 1) SELECT entity_id, {METRICS}, count(*) AS n_predictions FROM p GROUP BY 1""")
def shared_scope_metrics(spark, d):
    return rounded(R.predictions(events(spark, d), AT, "naive", "fixed_retrain", scope="shared").groupBy("entity_id").agg(*M.all_metrics(), F.count("*").alias("n_predictions")))


@query(f"""WITH {W}, h AS (SELECT w.entity_id, w.window_id, avg(target) AS m FROM w JOIN s ON s.entity_id = w.entity_id AND pos >= window_id * {ST} AND pos < window_id * {ST} + {H} GROUP BY 1, 2),
p AS (SELECT t.*, CASE WHEN {H} - 168 + h % 168 < 0 THEN m ELSE b.target END AS y_pred FROM t JOIN h USING (entity_id, window_id) LEFT JOIN s b ON b.entity_id = t.entity_id AND b.pos = window_id * {ST} + {H} - 168 + h % 168)
SELECT entity_id, {METRICS}, count(*) AS n_predictions FROM p GROUP BY 1""")
def seasonal_fallback_metrics(spark, d):
    return rounded(R.predictions(events(spark, d), AT, "seasonal_naive", m=168).groupBy("entity_id").agg(*M.all_metrics(), F.count("*").alias("n_predictions")))


@query(f"""WITH {W}, {p_sql()} SELECT entity_id, window_id, step, {METRICS}, round(avg(abs(y_true - y_pred)), 6) AS mean_error, round(max(abs(y_true - y_pred)), 6) AS max_error,
round(stddev_pop(abs(y_true - y_pred)), 6) AS std_error FROM p GROUP BY 1, 2, 3""")
def window_error_summary(spark, d):
    return rounded(R.window_metrics(R.predictions(events(spark, d), AT)).drop("timestamp"))


@query(f"WITH {W}, {p_sql()} SELECT {METRICS}, count(*) AS n_predictions FROM p")
def overall_metrics(spark, d):
    return rounded(R.predictions(events(spark, d), AT).agg(*M.all_metrics(), F.count("*").alias("n_predictions")))


_M = "m AS (SELECT entity_id, window_id, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(CASE WHEN y_true <> 0 AND y_pred <> 0 THEN abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100 AS smape FROM p GROUP BY 1, 2)"


@query(f"WITH {W}, {p_sql()}, {_M} SELECT entity_id, " + ", ".join(f"round({f}({m}), 6) AS {m}_{k}" for m in ("mae", "rmse", "smape") for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + ", count(*) AS n_windows FROM m GROUP BY 1")
def window_metric_aggregates(spark, d):
    return rounded(R.aggregate_windows(R.window_metrics(R.predictions(events(spark, d), AT)), "entity_id"))


@query(f"WITH {W}, {p_sql()}, {_M} SELECT entity_id, window_id, round(coalesce(avg(mae) OVER (PARTITION BY entity_id ORDER BY window_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) + 1e-9::DOUBLE, 6) AS error_ma FROM m")
def error_moving_average(spark, d):
    return rounded(R.error_moving_average(R.window_metrics(R.predictions(events(spark, d), AT))).select("entity_id", "window_id", "error_ma"), nudge=1e-9)


@query(f"""WITH {W}, {p_sql()}, e AS (SELECT *, abs(y_true - y_pred) AS e, lag(abs(y_true - y_pred)) OVER (PARTITION BY entity_id ORDER BY window_id, h) AS l FROM p)
SELECT entity_id, {METRICS}, round(avg(e), 6) AS error_mean, round(stddev_pop(e), 6) AS error_std, round(max(e), 6) AS error_max, round(corr(e, l), 6) AS error_autocorr_lag1,
round(avg(CASE WHEN y_true <> 0 THEN e / abs(y_true) END), 6) AS relative_error_mean FROM e GROUP BY 1""")
def extended_metrics(spark, d):
    return rounded(M.extended(R.predictions(events(spark, d), AT), "entity_id"))


@query(f"WITH {W}, c AS (SELECT entity_id, window_id + 1 AS nw FROM w) " + " UNION ALL ".join(f"SELECT entity_id, '{k}' AS policy, nw AS n_windows, CAST({v} AS BIGINT) AS retrains FROM c" for k, v in RETRAINS.items()))
def policy_retrain_counts(spark, d):
    """Retrains of the policies after each window of the series."""
    n = R.windows(events(spark, d), AT).select("entity_id", (F.col("window_id") + 1).alias("n_windows"))
    counts = [F.struct(F.lit(k).alias("policy"), R.retrains(k, F.col("n_windows")).cast("bigint").alias("retrains")) for k in RETRAINS]
    return n.select("entity_id", "n_windows", F.explode(F.array(*counts)).alias("c")).select("entity_id", "c.policy", "n_windows", "c.retrains")


@query()
def ridge_metrics(spark, d):
    return rounded(models.get_model("tsmixer")(events(spark, d), AT, policy="fixed_retrain").groupBy("entity_id").agg(*M.all_metrics()))


@query()
def lstm_metrics(spark, d):
    return rounded(models.get_model("lstm")(events(spark, d), AT).groupBy("entity_id").agg(*M.all_metrics()))


@query()
def random_forest_metrics(spark, d):
    return rounded(models.get_model("rf")(events(spark, d), AT).groupBy("entity_id").agg(*M.all_metrics()))


@query()
def boosted_trees_metrics(spark, d):
    return rounded(models.get_model("lgbm")(events(spark, d), AT).groupBy("entity_id").agg(*M.all_metrics()))


@query(f"""WITH {W} SELECT entity_id, pos, {', '.join(f'lag(target, {k}) OVER o AS lag_{k}' for k in (1, 2, 3))}, round(lag(target, 1) OVER o - lag(target, 24) OVER o, 6) AS seasonal_diff
FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY pos)""")
def model_features(spark, d):
    f, _ = models.feature_frame(events(spark, d))
    return rounded(f.select("entity_id", "pos", "lag_1", "lag_2", "lag_3", "seasonal_diff"))


