"""Rolling evaluation: train/test windows by position, model versions by policy, forecasts by joins on positions.

Nothing is looped over windows: a window's number follows from a row's position by arithmetic, and the row that a baseline
forecast repeats is one position, which is joined. Training rows are never expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M


@dataclass(frozen=True)
class Layout:
    """History, forecast and step lengths, in rows."""

    history: int = 120
    forecast: int = 24
    step: int = 24


def windows(series: DataFrame, at: Layout) -> DataFrame:
    """entity_id, window_id, step (over all entities in order), and the bounds of train and test positions.

    Steps are prefix sums of the entities' window counts, so no window spans the rows of all entities.
    """
    counts = series.groupBy("entity_id").agg(F.count("*").alias("n"))
    n = F.expr(f"(n - {at.history + at.forecast}) div {at.step} + 1")
    counts = counts.where(F.col("n") >= at.history + at.forecast).select("entity_id", n.alias("w"))
    before = Window.orderBy("entity_id").rowsBetween(Window.unboundedPreceding, -1)  # one row an entity
    counts = counts.withColumn("o", F.coalesce(F.sum("w").over(before), F.lit(0)))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1))
    out = counts.select("entity_id", "o", k.alias("window_id"))
    start = F.col("window_id") * at.step
    return out.select(
        "entity_id", "window_id", (F.col("o") + F.col("window_id")).alias("step"), start.alias("train_start"), (start + at.history).alias("test_start"), (start + at.history + at.forecast).alias("test_end")
    )


def test_rows(series: DataFrame, at: Layout, *keep: str) -> DataFrame:
    """Each test row of each window: entity_id, window_id, h (from 0), timestamp, y_true, and columns to keep."""
    sizes = series.groupBy("entity_id").agg(F.count("*").alias("n"))
    last = F.expr(f"(n - {at.history + at.forecast}) div {at.step}")
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - (at.history + at.forecast) + 1) / at.step)).cast("bigint")
    high = F.least(F.floor((F.col("pos") - at.history) / at.step).cast("bigint"), last)
    rows = series.join(sizes.where(F.col("n") >= at.history + at.forecast), "entity_id").where(F.col("pos") >= at.history)
    rows = rows.where(low <= high).withColumn("window_id", F.explode(F.sequence(low, high)))
    h = F.col("pos") - F.col("window_id") * at.step - at.history
    return rows.select("entity_id", "window_id", h.cast("int").alias("h"), "timestamp", F.col("target").alias("y_true"), *keep)


def version(policy: str, step: Column, every: int = 10) -> Column:
    """The step whose training window serves `step`: a retrain at a step takes effect from the next one on.

    each: refit in every window; no_retrain: the first; fixed_retrain: each `every` steps. Adaptive retrains follow from the data: see adaptive.loop.
    """
    zero = F.lit(0).cast("bigint")
    if policy == "each":
        return step
    if policy == "no_retrain":
        return zero
    if policy == "fixed_retrain":
        return F.when(step > 0, F.floor((step - 1) / every).cast("bigint") * every).otherwise(zero)
    raise ValueError(f"unknown policy: {policy}")


def retrains(policy: str, n: Column, every: int = 10) -> Column:
    """Retrains among n windows, the first fit included."""
    if policy == "each":
        return n
    if policy == "no_retrain":
        return F.least(n, F.lit(1))
    if policy == "fixed_retrain":
        return F.floor((n + every - 1) / every).cast("bigint")
    raise ValueError(f"unknown policy: {policy}")


def predictions(series: DataFrame, at: Layout, model: str = "naive", policy: str = "each", every: int = 10, scope: str = "entity", m: int = 24) -> DataFrame:
    """entity_id, window_id, step, h, timestamp, y_true, y_pred of the baseline models.

    scope: with `entity` each entity has its own model and steps; with `shared` one model serves all entities in order, so a
    window may be forecast from another entity's history. `lstm` is what an installation without a network of its own falls back to: naive.
    """
    wins = windows(series, at).select("entity_id", "window_id", "step")
    own = F.col("window_id") if scope == "entity" else F.col("step")
    wins = wins.withColumn("v", version(policy, own, every))
    if scope == "entity":
        served = wins.select("entity_id", "window_id", "step", F.col("entity_id").alias("v_entity"), F.col("v").alias("v_window"))
    else:
        by_step = wins.select(F.col("step").alias("v"), F.col("entity_id").alias("v_entity"), F.col("window_id").alias("v_window"))
        served = wins.join(by_step, "v").select("entity_id", "window_id", "step", "v_entity", "v_window")
    rows = test_rows(series, at).join(served, ["entity_id", "window_id"])
    end = F.col("v_window") * at.step + at.history
    values = series.select(F.col("entity_id").alias("v_entity"), F.col("pos").alias("v_pos"), F.col("target").alias("y_pred"))
    if model in ("naive", "lstm"):
        rows = rows.withColumn("v_pos", end - 1)
    elif model == "seasonal_naive":
        rows = rows.withColumn("v_pos", F.when(F.lit(at.history - m) + F.col("h") % m >= 0, end - m + F.col("h") % m))
    else:
        raise ValueError(f"no baseline model: {model}")
    out = rows.join(values, ["v_entity", "v_pos"], "left")
    if model == "seasonal_naive" and m > at.history:
        # a row lies in history / step windows: it names them, so nothing is joined by entity alone
        low, high = F.greatest(F.lit(0), F.floor((F.col("pos") - at.history) / at.step) + 1).cast("bigint"), F.floor(F.col("pos") / at.step).cast("bigint")
        marks = served.select(F.col("v_entity").alias("entity_id"), "v_window").distinct()
        means = series.where(low <= high).select("entity_id", "target", F.explode(F.sequence(low, high)).alias("v_window")).join(marks, ["entity_id", "v_window"], "left_semi")
        means = means.groupBy(F.col("entity_id").alias("v_entity"), "v_window").agg(F.avg("target").alias("__mean"))
        out = out.join(means, ["v_entity", "v_window"], "left").withColumn("y_pred", F.when(F.col("v_pos").isNull(), F.col("__mean")).otherwise(F.col("y_pred")))
    return out.select("entity_id", "window_id", "step", "h", "timestamp", "y_true", "y_pred")


def window_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics and error summary of each window."""
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return predictions.groupBy("entity_id", "window_id", "step").agg(
        F.min("timestamp").alias("timestamp"), *M.all_metrics(), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.stddev_pop(e).alias("std_error")
    )


def aggregate_windows(per_window: DataFrame, *by: str, names=("mae", "rmse", "smape")) -> DataFrame:
    """Mean, population deviation, minimum and maximum of the windows' metrics."""
    fs = (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    return per_window.groupBy(*by).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in fs], F.count("*").alias("n_windows"))


def error_moving_average(per_window: DataFrame, n: int = 5) -> DataFrame:
    """The mean MAE of the n windows before, 0 for the first."""
    w = Window.partitionBy("entity_id").orderBy("window_id").rowsBetween(-n, -1)
    return per_window.withColumn("error_ma", F.coalesce(F.avg("mae").over(w), F.lit(0.0)))

