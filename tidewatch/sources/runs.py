"""Scans of run folders and sinks of run results."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "mae double, rmse double, smape double, mape double, compute_proxy double, n_windows bigint, n_predictions bigint, retrain_total_retrains bigint, retrain_retrain_count bigint, retrain_retrain_rate double, drift_detection_rate double"


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """A row for each <root>/<dataset>/<strategy>/<model>/metrics.json; other depths are not runs."""
    raw = spark.read.schema(METRICS).option("multiLine", True).json(f"{root}/*/*/*/metrics.json").withColumn("__f", F.input_file_name())
    part = lambda k: F.regexp_extract("__f", r"([^/]+)/([^/]+)/([^/]+)/metrics\.json$", k)
    return raw.select(part(1).alias("dataset"), part(2).alias("strategy"), part(3).alias("model"), *[c for c in raw.columns if c != "__f"])


def normalised(runs: DataFrame) -> DataFrame:
    """Defaults for missing metrics, rates in percent, and one retrain total."""
    count, total = F.col("retrain_retrain_count"), F.col("retrain_total_retrains")
    return runs.select(
        "dataset", "strategy", "model", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mae", "rmse", "smape")],
        F.coalesce(F.nullif(count, F.lit(0)), total, F.lit(0)).cast("bigint").alias("retrain_total"),
        (F.coalesce("retrain_retrain_rate", F.lit(0.0)) * 100).alias("retrain_rate"),
        (F.coalesce("drift_detection_rate", F.lit(0.0)) * 100).alias("drift_detection_rate"),
        F.coalesce("compute_proxy", F.lit(0.0)).alias("compute_proxy"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
    )


def scan_logs(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All runs' rows of a CSV log (drift_log, retraining_log, window_metrics), with their run's names."""
    raw = spark.read.schema(schema).option("header", True).csv(f"{root}/*/*/*/{name}.csv").withColumn("__f", F.input_file_name())
    part = lambda k: F.regexp_extract("__f", r"([^/]+)/([^/]+)/([^/]+)/[^/]+$", k)
    return raw.withColumns({"dataset": part(1), "strategy": part(2), "model": part(3)}).drop("__f")


def write_run(folder: str, metrics: Mapping[str, float], config: Mapping, **tables: DataFrame | None) -> None:
    """One run's files: metrics.json, config_snapshot.yaml and a CSV for each table that has rows.

    A run's metrics and configuration are a few values; tables are written by Spark, and small ones as one file.
    """
    import yaml

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "metrics.json").write_text(json.dumps(metrics, indent=2, default=str))
    (out / "config_snapshot.yaml").write_text(yaml.safe_dump(dict(config)))
    for name, table in tables.items():
        if table is not None and table.limit(1).count():
            table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_tables(df: DataFrame, path: str) -> None:
    """Run rows at scale: Parquet, partitioned so that a scan prunes by run."""
    df.write.mode("overwrite").partitionBy("dataset", "strategy", "model").parquet(path)


def write_summary(df: DataFrame, path: str, digits: int = 4) -> None:
    """A CSV with doubles rounded."""
    df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
