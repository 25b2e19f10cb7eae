"""Features and fills by blocks of positions equal those of whole entities, whatever the block's length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features as X


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, n, gaps in (("a", 400, 0.2), ("b", 130, 0.0), ("c", 90, 1.0), ("d", 1, 0.0)):
        y = np.cumsum(rng.normal(0, 1, n)) + 1000
        y[rng.random(n) < gaps] = np.nan
        if name == "a":
            y[:5] = y[200:280] = np.nan
        rows += [(name, i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "entity_id string, pos bigint, target double").cache()
    return df, pd.DataFrame(rows, columns=["entity_id", "pos", "target"])


def close(df, want, name):
    got = df.toPandas().sort_values(["entity_id", "pos"])[name].to_numpy(float)
    assert np.allclose(got, want.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_exponential_means(table, block):
    df, pdf = table
    got = X.ewm(df, (2, 12, 300), block=block)
    assert got.columns == ["entity_id", "pos", "target", "ewm_2", "ewm_12", "ewm_300"]
    for s in (2, 12, 300):
        want = pdf.groupby("entity_id").target.transform(lambda v: v.shift(1).ewm(span=s, adjust=False).mean())  # noqa: B023
        close(got, want, f"ewm_{s}")


@pytest.mark.parametrize("block", [3, 50, 5000])
def test_expanding_and_fills(table, block):
    df, pdf = table
    g = pdf.groupby("entity_id").target
    got = X.expanding(df, block=block)
    close(got, g.transform(lambda v: v.shift(1).expanding().mean()), "expanding_mean")
    close(got, g.transform(lambda v: v.shift(1).expanding().std()), "expanding_std")
    close(X.fill_missing(df, "target", "forward_fill", block=block), g.ffill(), "target")
    close(X.fill_missing(df, "target", "backward_fill", block=block), g.bfill(), "target")
    close(X.fill_missing(df, "target", "mean", block=block), pdf.target.fillna(g.transform("mean")), "target")


@pytest.mark.parametrize("block", [5, 24, 5000])
def test_bounded_frames(table, block):
    df, _ = table
    make = lambda by: X.lag_columns(by=by) | X.rolling_columns(by=by) | X.diff_columns(by=by) | X.seasonal_columns(by=by)
    got = X.in_blocks(df, 168, make, block).toPandas().sort_values(["entity_id", "pos"]).reset_index(drop=True)
    want = df.withColumns(make(("entity_id",))).toPandas().sort_values(["entity_id", "pos"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_a_long_entity_is_many_tasks(spark):
    n = 200_000
    df = spark.range(n, numPartitions=4).select(F.lit("one").alias("entity_id"), F.col("id").alias("pos"), (F.col("id") % 24).cast("double").alias("target"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = X.in_blocks(df, 24, lambda by: X.lag_columns((24,), by=by)).select("lag_24", F.spark_partition_id().alias("p"))
        sizes = [r.n for r in rows.groupBy("p").agg(F.count("*").alias("n"), F.count("lag_24").alias("lags")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(sizes) == n and len(sizes) > 4 and max(sizes) < n / 2
