"""Leaderboards over a table of runs: dataset, strategy, model, mae, rmse, smape, retrain_total, n_windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by(runs: DataFrame, key: str) -> DataFrame:
    """Mean errors, summed retrains, number of runs and place, of each model or strategy."""
    s = runs.groupBy(key).agg(F.round(F.avg("mae"), 2).alias("avg_mae"), F.round(F.avg("rmse"), 2).alias("avg_rmse"), F.sum("retrain_total").alias("total_retrains"), F.count("*").alias("n_runs"))
    return s.withColumn("place", F.row_number().over(Window.orderBy("avg_mae", key)))  # one row a model or strategy


def _first(runs: DataFrame, keys: list[str], *order) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return runs.withColumn("__n", n).where("__n = 1").drop("__n")


def best_per(runs: DataFrame, *keys: str) -> DataFrame:
    return _first(runs, list(keys), "mae", "strategy", "model").select("dataset", "strategy", "model", "mae")


def best_and_worst(runs: DataFrame) -> DataFrame:
    """Of each dataset the best and worst run and by how many per cent they differ."""
    best = _first(runs, ["dataset"], "mae", "strategy", "model").select("dataset", F.concat_ws("/", "strategy", "model").alias("best"), F.col("mae").alias("best_mae"))
    worst = _first(runs, ["dataset"], F.desc("mae"), "strategy", "model").select("dataset", F.concat_ws("/", "strategy", "model").alias("worst"), F.col("mae").alias("worst_mae"))
    return best.join(worst, "dataset").withColumn("improvement_pct", F.round(F.try_divide(F.col("worst_mae") - F.col("best_mae"), F.col("worst_mae")) * 100, 6))


def pivot(runs: DataFrame, rows: str, columns: str, names: list[str], metric: str = "mae") -> DataFrame:
    return runs.groupBy(rows).pivot(columns, names).agg(F.round(F.avg(metric), 6))


def cells(runs: DataFrame) -> DataFrame:
    """Each run as a cell, with whether it is its dataset's best."""
    n = F.row_number().over(Window.partitionBy("dataset").orderBy("mae", "strategy", "model"))
    return runs.select("dataset", "strategy", "model", "mae", "retrain_total", (n == 1).alias("best"))


def adaptive_vs_fixed(runs: DataFrame, least: float = 10.0) -> DataFrame:
    """Improvement of adaptive over fixed retraining in per cent, the winner, and whether it is more than `least` per cent."""
    pick = lambda s: F.max(F.when(F.col("strategy") == s, F.col("mae")))
    s = runs.groupBy("dataset", "model").agg(pick("adaptive_retrain").alias("adaptive"), pick("fixed_retrain").alias("fixed")).where("adaptive is not null and fixed is not null")
    gain = F.try_divide(F.col("fixed") - F.col("adaptive"), F.col("fixed")) * 100
    return s.withColumn("improvement_pct", F.round(gain, 6)).withColumns({"winner": F.when(F.col("adaptive") < F.col("fixed"), "Adaptive").otherwise("Fixed"), "significant": F.abs(gain) > least})


def adaptive_gains(runs: DataFrame, least: float = 10.0) -> DataFrame:
    """The cases in which adaptive retraining is better by more than `least` per cent, largest gain first (ties by dataset and model), with their place."""
    found = adaptive_vs_fixed(runs, least).where(F.col("improvement_pct") > least)
    place = F.row_number().over(Window.orderBy(F.desc("improvement_pct"), "dataset", "model"))  # a row a dataset and model at most
    return found.select(place.alias("place"), "dataset", "model", "adaptive", "fixed", "improvement_pct").orderBy("place")


def adaptive_wins(runs: DataFrame) -> DataFrame:
    return adaptive_vs_fixed(runs).groupBy("model").agg(F.count_if(F.col("winner") == "Adaptive").alias("adaptive_wins"), F.count("*").alias("n"))


def heat(runs: DataFrame) -> DataFrame:
    """The best model of each dataset and strategy, in one of three bands between its dataset's least and largest."""
    best = best_per(runs, "dataset", "strategy")
    w = Window.partitionBy("dataset")
    share = F.try_divide(F.col("mae") - F.min("mae").over(w), F.max("mae").over(w) - F.min("mae").over(w))
    return best.withColumn("band", F.when(F.coalesce(share, F.lit(0.0)) < 1 / 3, "good").when(share < 2 / 3, "middle").otherwise("poor"))


def frontier(runs: DataFrame) -> DataFrame:
    """Runs with error and cost, and whether no run of their dataset is better in one and as good in the other.

    One ordered pass: by cost and then error, a run is on the frontier if it beats the least error so far.
    """
    w = Window.partitionBy("dataset").orderBy("retrain_total", "mae", "strategy", "model").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("mae").over(w)
    return runs.select("dataset", "strategy", "model", "mae", "retrain_total", (least.isNull() | (F.col("mae") < least)).alias("frontier"))


def filtered(runs: DataFrame, dataset: str = "all", strategy: str = "all", model: str = "all") -> DataFrame:
    for c, v in (("dataset", dataset), ("strategy", strategy), ("model", model)):
        if v != "all":
            runs = runs.where(F.col(c) == v)
    return runs


def summary(windows: DataFrame, *by_: str) -> DataFrame:
    """Counts, rates and conditional means of window rows with mae, drift_detected, drift_score and retrained."""
    d = F.col("drift_detected")
    return windows.groupBy(*by_).agg(
        F.count("*").alias("n_windows"), F.count_if(d).alias("n_drift"), F.avg(d.cast("double")).alias("drift_rate"), F.count_if("retrained").alias("n_retrains"),
        F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"), F.avg("drift_score").alias("mean_score"), F.max("drift_score").alias("max_score"),
        F.avg(F.when(d, F.col("mae"))).alias("mae_drift"), F.avg(F.when(~d, F.col("mae"))).alias("mae_quiet"),
    ).withColumn("mae_difference", F.col("mae_drift") - F.col("mae_quiet"))


def report(windows: DataFrame) -> str:
    """The summary as text."""
    row = summary(windows).first()
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items())


def recoveries(windows: DataFrame, quiet: int = 5) -> DataFrame:
    """For each run of drifting windows that `quiet` calm ones follow: where it ends, and the windows until it was calm."""
    w = Window.partitionBy("entity_id").orderBy("window_id")
    flagged = windows.select("entity_id", "window_id", F.col("drift_detected").cast("int").alias("d"))
    runs = flagged.withColumn("g", F.sum(F.when(F.col("d") != F.lag("d", 1, 0).over(w), 1).otherwise(0)).over(w))
    spans = runs.groupBy("entity_id", "g", "d").agg(F.min("window_id").alias("first"), F.max("window_id").alias("last"), F.count("*").alias("n"))
    s = Window.partitionBy("entity_id").orderBy("g")
    nxt = spans.withColumn("calm", F.lead("n").over(s))
    return nxt.where((F.col("d") == 1) & (F.col("calm") >= quiet)).select("entity_id", "first", "last", (F.col("last") - F.col("first") + quiet).alias("recovered_after"))


def seed_statistics(rows: DataFrame, *by_: str) -> DataFrame:
    """Of rows (key, seed, metric, value): mean, deviation (0 for one seed), minimum, maximum and number over seeds."""
    clean = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return clean.groupBy(*by_, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n")
    )
