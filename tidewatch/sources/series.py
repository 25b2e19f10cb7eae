"""Sources of entity series, all in the canonical form entity_id, timestamp, target, pos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the row's number from 0 in its entity, by timestamp and then `order`.

    Rows are numbered within a day and moved by the days before, so an entity with very many rows is
    spread over tasks; only counts of days meet by entity.
    """
    keyed = df.withColumn("__day", F.to_date("timestamp"))
    days = keyed.groupBy("entity_id", "__day").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("entity_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("entity_id").alias("__e"), F.col("__day").alias("__d"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    own = F.row_number().over(Window.partitionBy("entity_id", "__day").orderBy("timestamp", *order))
    joined = keyed.join(days, F.col("entity_id").eqNullSafe(F.col("__e")) & F.col("__day").eqNullSafe(F.col("__d")))
    return joined.withColumn("pos", F.col("__o") + own - 1).drop("__day", "__e", "__d", "__o")


def canonical(df: DataFrame, entity: str, timestamp: str, target: str, *order: str) -> DataFrame:
    """entity_id, timestamp, target (NaN is null), pos of any long table."""
    rows = df.select(
        F.col(entity).cast("string").alias("entity_id"), F.col(timestamp).cast("timestamp").alias("timestamp"), F.nanvl(F.col(target).cast("double"), F.lit(None)).alias("target"), *order,
    )
    return with_position(rows, *order).select("entity_id", "timestamp", "target", "pos")


def wide_panel(spark: SparkSession, path: str, date: str = "date", sample: int | None = None, freq: str | None = None, seed: int = 42) -> DataFrame:
    """A CSV with a date column and one column for each entity, as long series."""
    raw = spark.read.csv(path, header=True)
    return from_wide(raw, date, sample, freq, seed)


def from_wide(raw: DataFrame, date: str, sample: int | None = None, freq: str | None = None, seed: int = 42) -> DataFrame:
    values = [c for c in raw.columns if c != date]
    named = raw.select(F.to_timestamp(date).alias("timestamp"), *[F.col(c).try_cast("double").alias(c) for c in values])
    long = named.unpivot("timestamp", values, "entity_id", "target")
    if sample is not None:
        long = sample_entities(long, sample, seed)
    return downsample(with_position(long), freq)


def single_site(spark: SparkSession, path: str, entity: str = "i94_westbound", date: str = "date_time", value: str = "traffic_volume", freq: str | None = None) -> DataFrame:
    """A CSV of one site's counts; timestamps may repeat."""
    raw = spark.read.csv(path, header=True)
    rows = raw.select(F.lit(entity).alias("entity_id"), F.to_timestamp(date).alias("timestamp"), F.col(value).try_cast("double").alias("target"))
    return downsample(with_position(rows, "target"), freq)


def prices(spark: SparkSession, path: str, entity: str | None = None, date: str = "DATE_DT", freq: str | None = None) -> DataFrame:
    """A CSV of prices: the first column beside the date; rows without a number go."""
    raw = spark.read.csv(path, header=True)
    entity = entity or ("brent" if "brent" in path.lower() else "wti" if "wti" in path.lower() else "oil")
    return downsample(from_prices(raw, entity, date), freq)


def from_prices(raw: DataFrame, entity: str, date: str) -> DataFrame:
    value = next(c for c in raw.columns if c != date)
    rows = raw.select(F.lit(entity).alias("entity_id"), F.to_timestamp(date).alias("timestamp"), F.col(value).try_cast("double").alias("target"))
    return with_position(rows.dropna(subset=["target"]))


def downsample(series: DataFrame, freq: str | None) -> DataFrame:
    """Means over 'hour', 'day', 'week' or 'month'; None changes nothing."""
    if freq is None:
        return series
    cut = series.groupBy("entity_id", F.date_trunc(freq, "timestamp").alias("timestamp")).agg(F.avg("target").alias("target"))
    return with_position(cut)


def sample_entities(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rows of n entities, chosen by a seeded hash of the id."""
    ids = df.select("entity_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "entity_id")), "entity_id").limit(n)
    return df.join(ids, "entity_id", "left_semi")


def _grid(spark: SparkSession, n_steps: int, n_entities: int, start: str) -> DataFrame:
    rows = spark.range(n_steps * n_entities, numPartitions=max(1, n_steps * n_entities // 2_000_000)).select(F.expr(f"cast(id div {n_steps} as int)").alias("e"), F.expr(f"id % {n_steps}").alias("pos"))
    return rows.withColumn("timestamp", F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("pos") * 3600))


def weather(spark: SparkSession, start: str = "2010-01-01 00:00:00", n_steps: int = 43_824, n_entities: int = 10, seed: int = 42, noise: float = 1.0) -> DataFrame:
    """Hourly stations: base, annual and daily sine, trend and noise, floored at 0."""
    x = _grid(spark, n_steps, n_entities, start)
    level = (
        F.lit(15.0) + F.col("e") * 2.0 + 10.0 * F.sin(2 * F.pi() * F.dayofyear("timestamp") / 365.25) + 5.0 * F.sin(2 * F.pi() * F.hour("timestamp") / 24.0) + F.col("pos") * 0.0001
    )
    if noise:
        level = level + F.randn(seed) * noise
    return x.select(F.concat(F.lit("station_"), F.col("e").cast("string")).alias("entity_id"), "timestamp", F.greatest(F.lit(0.0), level).alias("target"), "pos")


def synthetic_drift(
    spark: SparkSession, n_steps: int = 10_000, n_entities: int = 5, kind: str = "sudden", start_share: float = 0.7, magnitude: float = 0.5, seed: int = 42, noise: float = 15.0, start: str = "2020-01-01 00:00:00",
) -> tuple[DataFrame, DataFrame]:
    """Series with a known drift and has_drift, and one event for each entity.

    sudden: the level shifts at once; gradual: it grows to the end; incremental: it grows by a fixed step an hour; recurring: a
    sine with a period of 1000 steps, counted as drift over 0.1.
    """
    if kind not in ("sudden", "gradual", "incremental", "recurring"):
        raise ValueError(f"unknown drift type: {kind}")
    begin = int(n_steps * start_share)
    x = _grid(spark, n_steps, n_entities, start)
    base = F.lit(100.0) + 20.0 * F.col("e")
    level = base + 10.0 * F.sin(2 * F.pi() * (F.col("pos") % 24) / 24.0)
    since = F.col("pos") - begin
    factor = {
        "sudden": F.lit(1.0),
        "gradual": since / F.lit(float(max(1, n_steps - begin))),
        "incremental": since * 0.001,
        "recurring": F.abs(F.sin(2 * F.pi() * since / 1000.0)),
    }[kind]
    after = F.col("pos") >= begin
    flagged = after & (F.lit(True) if kind in ("sudden", "incremental") else factor > 0.1)
    value = level + F.when(after, base * magnitude * factor).otherwise(0.0)
    if noise:
        value = value + F.randn(seed) * noise
    name = F.concat(F.lit("entity_"), F.col("e").cast("string"))
    series = x.select(name.alias("entity_id"), "timestamp", value.alias("target"), flagged.alias("has_drift"), "pos")
    events = x.where(F.col("pos") == begin).select(
        name.alias("entity"), F.lit(kind).alias("type"), F.col("pos").alias("start_idx"), F.lit(n_steps - 1).cast("bigint").alias("end_idx"), F.col("timestamp").alias("start_time"), F.lit(magnitude).alias("magnitude"),
    )
    return series, events


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as series: one entity for each event type, ordered by time and id."""
    return canonical(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = o.groupBy(F.col("o_orderstatus").alias("e"), F.col("o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("v"))
    return canonical(day, "e", "d", "v")


DATASETS: dict[str, Callable[..., DataFrame]] = {
    "electricity": wide_panel, "traffic": single_site, "weather": weather, "synthetic": lambda spark, **kw: synthetic_drift(spark, **kw)[0],
    "brent": lambda spark, path, **kw: prices(spark, path, "brent", **kw), "wti": lambda spark, path, **kw: prices(spark, path, "wti", **kw), "events": events_series,
}


def get_dataset(spark: SparkSession, name: str, *args, **kw) -> DataFrame:
    if name.lower() not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; there are {', '.join(available_datasets())}")
    return DATASETS[name.lower()](spark, *args, **kw)


def available_datasets() -> list[str]:
    return list(DATASETS)
