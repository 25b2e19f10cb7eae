"""Features, fills and statistics of series. Window specifications are shared, so a plan sorts once.

A long entity is many tasks: what looks back a bounded number of rows is computed in blocks of positions that each get the rows before them
as well (in_blocks); what looks back without bound (exponential and expanding means, fills) is computed within blocks, one row a block is carried along
the entity, and each row joins the carry of its block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
WINDOWS = (3, 6, 12, 24, 48)
DIFFS = (1, 24, 168)
SPANS = (12, 24, 48)
#: Positions in a block.
BLOCK = 1 << 14


def order(partition_by: Sequence[str] = ("entity_id",)):
    return Window.partitionBy(*partition_by).orderBy("pos")


def in_blocks(series: DataFrame, reach: int, columns: Callable[[Sequence[str]], dict[str, Column]], block: int = BLOCK, by: Sequence[str] = ("entity_id",), keep: bool = False) -> DataFrame:
    """The series with columns(keys) whose frames look back `reach` rows at most (by position), computed block by block.

    A row is sent to its own block, and to later ones that it is in reach of; there it is only looked back at. keep: leave the block's number in `__block`.
    """
    own = F.floor(F.col("pos") / block).cast("bigint")
    rows = series.withColumn("__block", F.explode(F.sequence(own, F.floor((F.col("pos") + reach) / block).cast("bigint"))))
    out = rows.withColumns(columns((*by, "__block"))).where(F.col("__block") == own)
    return out if keep else out.drop("__block")


def time_columns(cyclical: bool = True) -> dict[str, Column]:
    ts = F.col("timestamp")
    out = {
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "quarter": F.quarter(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"), "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"),
    }
    if cyclical:
        for name, x, n in (("hour", F.hour(ts), 24), ("day", F.weekday(ts), 7), ("month", F.month(ts), 12)):
            out[f"{name}_sin"] = F.sin(x * (2 * F.pi()) / n)
            out[f"{name}_cos"] = F.cos(x * (2 * F.pi()) / n)
    return out


def lag_columns(lags: Sequence[int] = LAGS, c: str = "target", by=("entity_id",)) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(c, k).over(order(by)) for k in lags}


def rolling_columns(windows: Sequence[int] = WINDOWS, c: str = "target", by=("entity_id",), strict: bool = False) -> dict[str, Column]:
    """Over the `w` rows before the current one; strict: null until all of them are there."""
    out = {}
    for w in windows:
        frame = order(by).rowsBetween(-w, -1)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            value = f(c).over(frame)
            out[f"rolling_{name}_{w}"] = F.when(F.count(c).over(frame) == w, value) if strict else value
    return out


def expanding_columns(c: str = "target", by=("entity_id",)) -> dict[str, Column]:
    frame = order(by).rowsBetween(Window.unboundedPreceding, -1)
    return {"expanding_mean": F.avg(c).over(frame), "expanding_std": F.stddev_samp(c).over(frame)}


def diff_columns(periods: Sequence[int] = DIFFS, c: str = "target", by=("entity_id",)) -> dict[str, Column]:
    return {f"diff_{k}": F.col(c) - F.lag(c, k).over(order(by)) for k in periods}


def seasonal_columns(m: int = 24, c: str = "target", by=("entity_id",)) -> dict[str, Column]:
    near, far = F.lag(c, 1).over(order(by)), F.lag(c, m).over(order(by))
    return {"seasonal_diff": near - far, "seasonal_ratio": F.try_divide(near, far + F.lit(1e-6))}


def rolling_diff_mean(series: DataFrame, w: int, c: str = "target", by=("entity_id",)) -> DataFrame:
    """Mean of the last w first differences of the shifted series."""

    def columns(keys: Sequence[str]) -> dict[str, Column]:
        # the differences within the frame telescope only without gaps, so they are averaged one by one
        shifted = [F.lag(c, k).over(order(keys)) - F.lag(c, k + 1).over(order(keys)) for k in range(1, w + 1)]
        there = sum((d.isNotNull().cast("int") for d in shifted), F.lit(0))
        return {f"rolling_diff_mean_{w}": F.try_divide(sum((F.coalesce(d, F.lit(0.0)) for d in shifted), F.lit(0.0)), there)}

    return in_blocks(series, w + 1, columns, by=by)


def _carried(blocks: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One row a block with columns over the blocks before it."""
    return blocks.select(*by, "__block", *[c.alias(k) for k, c in columns.items()])


def expanding(series: DataFrame, c: str = "target", by: Sequence[str] = ("entity_id",), block: int = BLOCK) -> DataFrame:
    """expanding_mean and expanding_std of the rows before each one, from sums within blocks and sums of the blocks before.

    Values are taken from the entity's mean, so that the squares' sums do not drown what differs.
    """
    keys = list(by)
    means = series.groupBy(*keys).agg(F.avg(c).alias("__mean"))
    rows = series.join(means, keys).withColumn("__x", F.col(c) - F.col("__mean")).withColumn("__block", F.floor(F.col("pos") / block).cast("bigint"))
    sums = {"n": F.count("__x"), "s": F.sum("__x"), "q": F.sum(F.col("__x") * F.col("__x"))}
    blocks = rows.groupBy(*keys, "__block").agg(*[f.alias(f"__{k}") for k, f in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(blocks, keys, {f"__{k}": F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)) for k in sums})
    within = order((*keys, "__block")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__in_{k}": F.coalesce(f.over(within), F.lit(0)) for k, f in sums.items()}).join(carry, [*keys, "__block"])
    n, s, q = (F.col(f"__{k}") + F.col(f"__in_{k}") for k in sums)
    variance = F.try_divide(q - F.try_divide(s * s, n), n - 1)
    out = {"expanding_mean": F.col("__mean") + F.try_divide(s, n), "expanding_std": F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))}
    return rows.select(*series.columns, *[v.alias(k) for k, v in out.items()])


def ewm(series: DataFrame, spans: Sequence[int] = SPANS, c: str = "target", by: Sequence[str] = ("entity_id",), block: int | None = None) -> DataFrame:
    """Exponential means of the series up to the row before, recursively (no adjustment), alpha = 2 / (span + 1).

    A gap lowers the weight of what came before it once for each row of the gap. An observation x after g rows maps the mean m to a m + b, a = q^g / (q^g + alpha),
    b = alpha x / (q^g + alpha), q = 1 - alpha; such maps compose. Within a block they are composed by running products and sums (a block is so short
    that the products stay above 1e-260); each block with observations is one map, composed along the entity by doubling the reach until
    what is older weighs nothing in double precision; a row applies its own map to what its block begins with.
    """
    keys, alphas = list(by), {s: 2.0 / (s + 1) for s in spans}
    if min(spans) <= 1:
        raise ValueError("a span must be above 1")
    fastest, slowest = (-math.log1p(-f(alphas.values())) for f in (max, min))
    block = block or max(1, min(BLOCK, int(600 / fastest)))
    lagged = lambda k: {"__z": F.nanvl(F.lag(F.col(c).cast("double"), 1).over(order(k)), F.lit(None).cast("double"))}
    rows = in_blocks(series, 1, lagged, block, keys, keep=True)
    w = order((*keys, "__block"))
    here = F.when(F.col("__z").isNotNull(), F.col("pos"))
    rows = rows.withColumns({"__gap": F.col("pos") - F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__p0": F.first(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__z0": F.first("__z", True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    inner = F.col("__z").isNotNull() & F.col("__gap").isNotNull()  # the block's first observation is mapped by what the block begins with
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def old(alpha: float, gap: Column) -> Column:
        return F.pow(F.lit(1 - alpha), gap)

    rows = rows.withColumns({f"__a{s}": F.product(F.when(inner, old(a, F.col("__gap")) / (old(a, F.col("__gap")) + a)).otherwise(1.0)).over(upto) for s, a in alphas.items()})
    rows = rows.withColumns({f"__b{s}": F.sum(F.when(inner, a * F.col("__z") / (old(a, F.col("__gap")) + a) / F.col(f"__a{s}")).otherwise(0.0)).over(upto) for s, a in alphas.items()})

    ends = [F.max_by(f"__{x}{s}", "pos").alias(f"__{x}{s}") for s in spans for x in "ab"]
    blocks = rows.groupBy(*keys, "__block").agg(F.min("__p0").alias("__p0"), F.max_by("__z0", "pos").alias("__z0"), F.max(here).alias("__last"), *ends)
    along = Window.partitionBy(*keys).orderBy("__block")
    chain = blocks.where(F.col("__last").isNotNull()).withColumn("__gap", F.col("__p0") - F.lag("__last").over(along))
    for s, a in alphas.items():
        first = old(a, F.col("__gap"))
        chain = chain.withColumns({
            f"__m{s}": F.when(F.col("__gap").isNull(), 0.0).otherwise(F.col(f"__a{s}") * first / (first + a)),
            f"__k{s}": F.col(f"__a{s}") * (F.when(F.col("__gap").isNull(), F.col("__z0")).otherwise(a * F.col("__z0") / (first + a)) + F.col(f"__b{s}")),
        })
    for r in range(max(1, math.ceil(math.log2(max(2.0, 3000 / (block * slowest)))) + 1)):
        chain = chain.withColumns({
            x: v for s in spans for x, v in (
                (f"__m{s}", F.col(f"__m{s}") * F.lag(f"__m{s}", 1 << r, 0.0).over(along)), (f"__k{s}", F.col(f"__k{s}") + F.col(f"__m{s}") * F.lag(f"__k{s}", 1 << r, 0.0).over(along))
            )
        })
    back = along.rowsBetween(Window.unboundedPreceding, -1)
    chain = chain.select(*keys, "__block", F.col("__last").alias("__at"), *[f"__k{s}" for s in spans])
    carry = blocks.select(*keys, "__block").join(chain, [*keys, "__block"], "left")
    carry = _carried(carry, keys, {"__at": F.last("__at", True).over(back)} | {f"__k{s}": F.last(f"__k{s}", True).over(back) for s in spans})

    rows = rows.join(carry, [*keys, "__block"])
    out = {}
    for s, a in alphas.items():
        start = old(a, F.col("__p0") - F.col("__at"))
        begin = F.when(F.col("__at").isNull(), F.col("__z0")).otherwise((start * F.col(f"__k{s}") + a * F.col("__z0")) / (start + a))
        out[f"ewm_{s}"] = F.when(F.col("__p0").isNull(), F.col(f"__k{s}")).otherwise(F.col(f"__a{s}") * (begin + F.col(f"__b{s}")))
    return rows.select(*series.columns, *[v.alias(k) for k, v in out.items()])


def all_features(series: DataFrame) -> DataFrame:
    """Calendar, lag, rolling, difference and exponential features."""
    near = in_blocks(series, max(*LAGS, *WINDOWS, *DIFFS), lambda by: lag_columns(by=by) | rolling_columns(by=by) | diff_columns(by=by))
    return ewm(near.withColumns(time_columns()))


def fill_missing(df: DataFrame, column: str, method: str = "forward_fill", by: Sequence[str] = ("entity_id",), block: int = BLOCK) -> DataFrame:
    """Fills nulls: forward_fill, backward_fill, mean or zero. Fills look within their block of positions, then at the nearest block that has a value."""
    keys, c = list(by), F.col(column)
    if method == "zero":
        return df.withColumn(column, F.coalesce(c, F.lit(0.0)))
    if method == "mean":
        means = df.groupBy(*keys).agg(F.avg(column).alias("__mean"))
        return df.join(means, keys).select(*[F.coalesce(c, F.col("__mean")).alias(n) if n == column else F.col(n) for n in df.columns])
    if method not in ("forward_fill", "backward_fill"):
        raise ValueError(f"unknown method: {method}")
    # backward in reverse order: a frame that grows is updated row by row, one that shrinks would be computed anew for each row
    turn = F.asc if method == "forward_fill" else F.desc
    rows = df.withColumn("__block", F.floor(F.col("pos") / block).cast("bigint"))
    nearest = F.max_by if method == "forward_fill" else F.min_by
    blocks = rows.groupBy(*keys, "__block").agg(nearest(c, F.when(c.isNotNull(), F.col("pos"))).alias("__v"))
    before = Window.partitionBy(*keys).orderBy(turn("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(blocks, keys, {"__carry": F.last("__v", True).over(before)})
    within = Window.partitionBy(*keys, "__block").orderBy(turn("pos")).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__own", F.last(c, True).over(within)).join(carry, [*keys, "__block"])
    return filled.select(*[F.coalesce("__own", "__carry").alias(n) if n == column else F.col(n) for n in df.columns])


def tail(series: DataFrame, n: int, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """The last n rows of each entity. Positions have no gaps, so they follow from each entity's last one; no entity is sorted."""
    last = series.groupBy(*by).agg(F.max("pos").alias("__last"))
    return series.join(last, list(by)).where(F.col("pos") > F.col("__last") - n).drop("__last")


def missing_profile(df: DataFrame) -> DataFrame:
    """column, missing_count, missing_pct and total_rows, in one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot("n", df.columns, "column", "missing_count")
    return long.select("column", "missing_count", F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("n")), 6).alias("missing_pct"), F.col("n").alias("total_rows"))


def entity_statistics(series: DataFrame) -> DataFrame:
    return series.groupBy("entity_id").agg(
        F.avg("target").alias("mean"), F.stddev_samp("target").alias("std"), F.min("target").alias("min"), F.max("target").alias("max"), F.count("target").alias("count")
    )


def entity_features(series: DataFrame, start, end) -> DataFrame:
    """Each row with its entity's statistics over the reference time; entities without any get the mean of the others'."""
    names = ("mean", "std", "min", "max", "median")
    ref = series.where((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))
    stats = ref.groupBy("entity_id").agg(
        *[f("target").alias(f"{n}_entity_stat") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
        F.percentile("target", F.lit(0.5)).alias("median_entity_stat"),
    )
    means = stats.agg(*[F.avg(f"{n}_entity_stat").alias(f"__{n}") for n in names])
    joined = series.join(stats, "entity_id", "left").join(F.broadcast(means))  # one row
    return joined.select(*series.columns, *[F.coalesce(f"{n}_entity_stat", f"__{n}").alias(f"{n}_entity_stat") for n in names])


def scaled(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is all but 0)."""
    w = Window.partitionBy(*by) if by else None
    if w is None:
        stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
        df = df.join(F.broadcast(stats))  # one row
    else:
        df = df.withColumns({f"__m_{c}": F.avg(c).over(w) for c in columns} | {f"__s_{c}": F.stddev_pop(c).over(w) for c in columns})
    out = df.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") < 1e-10, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns})
    return out.drop(*[f"__{k}_{c}" for k in "ms" for c in columns])
