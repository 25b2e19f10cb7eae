"""Forecast metrics as aggregate columns over y_true and y_pred; pairs with a null or NaN take no part, no pairs give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(y: str, p: str) -> tuple[Column, Column]:
    y_, p_ = F.nanvl(F.col(y), F.lit(None)), F.nanvl(F.col(p), F.lit(None))
    both = y_.isNotNull() & p_.isNotNull()
    return F.when(both, y_), F.when(both, p_)


def mae(y: str = "y_true", p: str = "y_pred") -> Column:
    a, b = _clean(y, p)
    return F.avg(F.abs(a - b))


def rmse(y: str = "y_true", p: str = "y_pred") -> Column:
    a, b = _clean(y, p)
    return F.sqrt(F.avg((a - b) * (a - b)))


def smape(y: str = "y_true", p: str = "y_pred") -> Column:
    """Pairs in which either is 0 take no part."""
    a, b = _clean(y, p)
    return F.avg(F.when((a != 0) & (b != 0), F.try_divide(F.abs(b - a), (F.abs(a) + F.abs(b)) / 2))) * 100


def mape(y: str = "y_true", p: str = "y_pred") -> Column:
    """Pairs in which y_true is 0 take no part."""
    a, b = _clean(y, p)
    return F.avg(F.when(a != 0, F.try_divide(F.abs(a - b), F.abs(a)))) * 100


METRICS = {"mae": mae, "rmse": rmse, "smape": smape, "mape": mape}


def all_metrics(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    return [f(y, p).alias(k) for k, f in METRICS.items()]


def extended(predictions: DataFrame, *by: str, order: tuple[str, ...] = ("entity_id", "window_id", "h")) -> DataFrame:
    """The four metrics, and mean, deviation and maximum of errors, their lag-1 autocorrelation and the relative error.

    Without a key the order runs over all entities; with a column `step` (the number of the window over all entities) no task sees all rows: lags are
    taken within a step, and the first row of a step takes the last error of the step before.
    """
    e = predictions.withColumn("__e", F.abs(F.col("y_true") - F.col("y_pred")))
    if not by and "step" in predictions.columns:
        w = Window.partitionBy("step").orderBy("h")
        seams = e.groupBy((F.col("step") + 1).alias("step")).agg(F.max_by("__e", "h").alias("__seam"))
        e = e.withColumns({"__l": F.lag("__e").over(w), "__n": F.row_number().over(w)}).join(seams, "step", "left")
        e = e.withColumn("__l", F.when(F.col("__n") == 1, F.col("__seam")).otherwise(F.col("__l")))
    else:
        own = [c for c in order if c not in by]
        e = e.withColumn("__l", F.lag("__e").over(Window.partitionBy(*by).orderBy(*own)))
    relative = F.avg(F.when(F.col("y_true") != 0, F.try_divide(F.col("__e"), F.abs("y_true"))))
    columns = [
        *all_metrics(), F.avg("__e").alias("error_mean"), F.stddev_pop("__e").alias("error_std"), F.max("__e").alias("error_max"),
        F.corr("__e", "__l").alias("error_autocorr_lag1"), relative.alias("relative_error_mean"),
    ]
    return e.groupBy(*by).agg(*columns)
