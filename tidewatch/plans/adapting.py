"""Queries on the adaptive loop, against SQL that steps through the series value by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import adaptive, models
from .catalog import query
from .shared import AT, DECAY, GAP, LIMIT, METRICS, RUN, SCORE, SLACK, W, adaptive_sql, decided, events, loop_sql, rounded


@query(f"WITH RECURSIVE {W}, {loop_sql()} SELECT entity_id, window_id, version, drift_detected, round(drift_score, 6) AS drift_score, retrain FROM loop_naive")
def adaptive_loop(spark, d):
    return rounded(decided(spark, d).select("entity_id", "window_id", F.col("v_window").alias("version"), "drift_detected", "drift_score", "retrain"))


@query(
    f"""WITH RECURSIVE {W}, {loop_sql()}, {adaptive_sql()} SELECT entity_id, {METRICS}, count(*) AS n_predictions, any_value(retrains) AS retrains
    FROM p JOIN (SELECT entity_id, CAST(count_if(retrain) AS BIGINT) AS retrains FROM loop_naive GROUP BY 1) USING (entity_id) GROUP BY 1"""
)
def adaptive_loop_metrics(spark, d):
    found = decided(spark, d)
    per = adaptive.predictions(events(spark, d), AT, found).groupBy("entity_id").agg(*M.all_metrics(), F.count("*").alias("n_predictions"))
    return rounded(per.join(found.groupBy("entity_id").agg(F.count_if("retrain").alias("retrains")), "entity_id"))


@query(f"WITH RECURSIVE {W}, {loop_sql('seasonal_naive')}, {adaptive_sql('seasonal_naive')} SELECT entity_id, {METRICS}, count(*) AS n_predictions FROM p GROUP BY 1")
def adaptive_policy_metrics(spark, d):
    p = models.get_model("seasonal_naive")(events(spark, d), AT, policy="adaptive_retrain", decided=decided(spark, d, "seasonal_naive"))
    return rounded(p.groupBy("entity_id").agg(*M.all_metrics(), F.count("*").alias("n_predictions")))


@query()
def adaptive_ridge_loop(spark, d):
    """The loop of ridge's own residuals: decisions and errors of each window."""
    framed, make = models.prepared(events(spark, d), "ridge_features")
    policy = {"kind": "drift_triggered", "gap": GAP, "consecutive": RUN, "threshold": SCORE, "decay": DECAY}
    found = adaptive.loop(framed, AT, detector="cusum", policy=policy, make=make, threshold=LIMIT, drift=SLACK)
    return rounded(found.select("entity_id", "window_id", F.col("v_window").alias("version"), "drift_detected", "drift_score", "error", "retrain"))
