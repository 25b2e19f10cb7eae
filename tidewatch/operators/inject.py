"""Drift injection: transforms of a series within a period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("sudden_mean_shift", "gradual_drift", "variance_increase", "seasonal_phase_shift", "concept_drift")


@dataclass(frozen=True)
class Drift:
    """start and end as timestamps; without a start the period is the second half of all rows in order."""

    kind: str = "sudden_mean_shift"
    start: str | None = None
    end: str | None = None
    magnitude: float = 0.5
    slope: float = 0.01
    features: tuple[str, ...] = ()
    enabled: bool = True
    seed: int = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown drift type: {self.kind}")


def _masked(series: DataFrame, d: Drift) -> DataFrame:
    """series with __in, whether the row is in the period."""
    if d.start is None:
        # the place of a row among all: rows of the entities before, plus its own position; one row an entity meets in a window
        sizes = series.groupBy(F.col("entity_id").alias("__e")).agg(F.count("*").alias("__n"))
        before = Window.orderBy("__e").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.orderBy("__e").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sizes = sizes.select("__e", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), F.sum("__n").over(whole).alias("__all"))
        out = series.join(sizes, F.col("entity_id") == F.col("__e"))
        return out.withColumn("__in", F.col("__o") + F.col("pos") >= F.expr("__all div 2")).drop("__e", "__o", "__all")
    inside: Column = F.col("timestamp") >= F.to_timestamp(F.lit(d.start))
    if d.end is not None:
        inside = inside & (F.col("timestamp") < F.to_timestamp(F.lit(d.end)))
    return series.withColumn("__in", inside)


def inject(series: DataFrame, d: Drift) -> DataFrame:
    """The series with its target changed within the period, entity by entity."""
    if not d.enabled:
        return series
    rows = _masked(series, d)
    x, inside, own = F.col("target"), F.col("__in"), Window.partitionBy("entity_id")
    within = F.when(inside, x)
    if d.kind == "sudden_mean_shift":
        value = x + F.avg(within).over(own) * d.magnitude
    elif d.kind == "gradual_drift":
        part = Window.partitionBy("entity_id", "__in")
        i, n = F.row_number().over(part.orderBy("pos")) - 1, F.count("*").over(part)
        value = x + x * d.magnitude * d.slope * i / n
    elif d.kind == "variance_increase":
        m, s = F.avg(within).over(own), F.stddev_pop(within).over(own)
        value = F.when(s > 0, (x - m) * (1 + d.magnitude) + m).otherwise(x)
    elif d.kind == "seasonal_phase_shift":
        # the first value of each hour in the period; then, for each row, that of the nearest hour to its own shifted one
        hours = rows.where("__in").groupBy(F.col("entity_id").alias("__e"), F.hour("timestamp").alias("__h")).agg(F.min_by("target", "pos").alias("__v"), F.min("pos").alias("__p"))
        table = hours.groupBy("__e").agg(F.collect_list(F.struct("__h", "__p", "__v")).alias("__t"))
        rows = rows.join(table, F.col("entity_id") == F.col("__e"), "left")
        goal = (F.hour("timestamp") + int(d.magnitude * 12)) % 24
        value = F.array_min(F.transform("__t", lambda t: F.struct(F.abs(t["__h"] - goal).alias("d"), t["__p"].alias("p"), t["__v"].alias("v"))))["v"]
    else:
        if not d.features:
            return series
        f = F.avg(F.when(inside, F.col(d.features[0]))).over(own)
        value = x + f * d.magnitude + F.randn(d.seed) * (F.stddev_pop(within).over(own) * 0.1)
    return rows.withColumn("target", F.when(inside, value).otherwise(x)).select(series.columns)


def period_info(series: DataFrame, d: Drift) -> DataFrame:
    """n_rows, n_drift and drift_fraction."""
    rows = _masked(series, d)
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("__in").alias("n_drift"), F.try_divide(F.count_if("__in"), F.count("*")).alias("drift_fraction"))
