"""Queries on sources, fills, features and entity statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..sources import series as src
from .catalog import QUERIES, query
from .shared import S, events, rounded


@query(f"WITH {S} SELECT entity_id, pos, target FROM s")
def canonical_series(spark, d):
    return events(spark, d).select("entity_id", "pos", "target")


@query("""SELECT o_orderstatus AS entity_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) - 1 AS pos, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS target
FROM orders GROUP BY o_orderstatus, o_orderdate""")
def daily_order_series(spark, d):
    return src.daily_orders(spark, d).select("entity_id", "pos", F.round("target", 2).alias("target"))


@query("""WITH w AS (SELECT o_orderdate AS d, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DOUBLE) END) AS o, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DOUBLE) END) AS f FROM orders GROUP BY 1),
l AS (SELECT d, 'o' AS entity_id, o AS target FROM w UNION ALL SELECT d, 'f', f FROM w)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY d) - 1 AS pos, round(target, 2) AS target FROM l""")
def wide_panel_melt(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    price = F.col("o_totalprice").cast("double")
    wide = o.groupBy(F.col("o_orderdate").alias("date")).agg(F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("o"), F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("f"))
    return src.from_wide(wide, "date").select("entity_id", "pos", F.round("target", 2).alias("target"))


@query("""SELECT 'supplier' AS entity_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, CAST(s_acctbal AS DOUBLE) AS target FROM supplier WHERE TRY_CAST(s_acctbal AS DOUBLE) IS NOT NULL""")
def price_series(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("DATE_DT"), F.col("s_acctbal").cast("string").alias("price"))
    return src.from_prices(s, "supplier", "DATE_DT").select("entity_id", "pos", "target")


#: The event series with numbers of its entities, and its longest entity's length.
_LAID = f"{S}, n AS (SELECT max(pos) + 1 AS n FROM s), g AS (SELECT s.*, dense_rank() OVER (ORDER BY entity_id) - 1 AS e, pos AS p, n, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS b FROM s, n)"


def _laid(spark, d, make, *columns: str):
    """Generated series without noise, as many and as long as the event series, whose values take the noise's place."""
    s = events(spark, d)
    ids = s.select("entity_id").distinct().withColumn("e", F.row_number().over(Window.orderBy("entity_id")) - 1)  # one row an entity
    size = s.agg((F.max("pos") + 1).alias("n"), F.count_distinct("entity_id").alias("k")).first()
    made = make(size.n or 0, size.k).select(F.col("target").alias("made"), "pos", F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int").alias("e"), *columns)
    return s.join(ids, "entity_id").join(made, ["e", "pos"]).select("entity_id", "pos", F.round(F.col("made") + F.col("target"), 6).alias("target"), *columns)


@query(f"""WITH {_LAID}, h AS (SELECT *, TIMESTAMP '2010-01-01' + INTERVAL 1 HOUR * p AS ts FROM g)
SELECT entity_id, pos, round(greatest(0.0::DOUBLE, 15.0::DOUBLE + e * 2.0::DOUBLE + 10.0::DOUBLE * sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) + 5.0::DOUBLE * sin(2 * pi() * hour(ts) / 24.0::DOUBLE) + p * 0.0001::DOUBLE) + target, 6) AS target FROM h""")
def weather_generator(spark, d):
    return _laid(spark, d, lambda n, k: src.weather(spark, n_steps=n, n_entities=k, noise=0.0))


def _drift_sql(kind: str) -> str:
    factor = {"sudden": "1.0::DOUBLE", "gradual": "(p - b) / greatest(1, n - b)::DOUBLE", "incremental": "(p - b) * 0.001::DOUBLE", "recurring": "abs(sin(2 * pi() * (p - b) / 1000.0::DOUBLE))"}[kind]
    flag = "true" if kind in ("sudden", "incremental") else f"({factor}) > 0.1"
    return f"""WITH {_LAID} SELECT entity_id, pos, round(100.0::DOUBLE + 20.0::DOUBLE * e + 10.0::DOUBLE * sin(2 * pi() * (p % 24) / 24.0::DOUBLE) + CASE WHEN p >= b THEN (100.0::DOUBLE + 20.0::DOUBLE * e) * 0.5::DOUBLE * ({factor}) ELSE 0 END + target, 6) AS target,
p >= b AND {flag} AS has_drift FROM g"""


for _kind in ("sudden", "gradual", "incremental", "recurring"):

    def _generated(spark, d, kind=_kind):
        return _laid(spark, d, lambda n, k: src.synthetic_drift(spark, n, k, kind, noise=0.0)[0], "has_drift")

    _generated.__name__ = f"synthetic_{_kind}"
    query(_drift_sql(_kind))(_generated)


@query(f"WITH {_LAID} SELECT DISTINCT 'entity_' || e AS entity, 'sudden' AS type, b AS start_idx, CAST(n - 1 AS BIGINT) AS end_idx, CAST(0.5 AS DOUBLE) AS magnitude FROM g")
def synthetic_events(spark, d):
    size = events(spark, d).agg((F.max("pos") + 1).alias("n"), F.count_distinct("entity_id").alias("k")).first()
    return src.synthetic_drift(spark, size.n or 0, size.k, "sudden")[1].drop("start_time")


@query(f"WITH {S}, i AS (SELECT entity_id FROM s GROUP BY 1 ORDER BY md5('42:' || entity_id), entity_id LIMIT 2) SELECT entity_id, count(*) AS n FROM s SEMI JOIN i USING (entity_id) GROUP BY 1")
def entity_sample(spark, d):
    return src.sample_entities(events(spark, d), 2).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT entity_id, date_trunc('day', timestamp)::VARCHAR[:10] AS day, round(avg(target), 6) AS target FROM s GROUP BY 1, 2".replace("::VARCHAR[:10]", "::DATE::VARCHAR"))
def downsampled(spark, d):
    return rounded(src.downsample(events(spark, d), "day").select("entity_id", F.to_date("timestamp").cast("string").alias("day"), "target"))


@query(f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos DESC) AS i FROM s) SELECT entity_id, pos, target FROM r WHERE i <= 24")
def series_tail(spark, d):
    return X.tail(events(spark, d), 24).select("entity_id", "pos", "target")


@query(f"WITH {S} SELECT entity_id, round(avg(target), 6) AS mean, round(stddev_samp(target), 6) AS std, min(target) AS min, max(target) AS max, count(target) AS count FROM s GROUP BY 1")
def series_entity_stats(spark, d):
    s = X.entity_statistics(events(spark, d))
    return s.select("entity_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", "count")


@query("SELECT count(DISTINCT event_type) AS entities, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last, count(*) AS n FROM events".replace("CAST(min(ts) AS VARCHAR)", "strftime(min(ts), '%Y-%m-%d %H:%M:%S')").replace("CAST(max(ts) AS VARCHAR)", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def series_extent(spark, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return events(spark, d).agg(F.count_distinct("entity_id").alias("entities"), f(F.min("timestamp")).alias("first"), f(F.max("timestamp")).alias("last"), F.count("*").alias("n"))


@query(f"""WITH {S} SELECT entity_id, pos, CAST(hour(timestamp) AS INT) AS hour, CAST(isodow(timestamp) - 1 AS INT) AS day_of_week, CAST(day(timestamp) AS INT) AS day_of_month, CAST(month(timestamp) AS INT) AS month,
CAST(quarter(timestamp) AS INT) AS quarter, CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend, CAST(day(timestamp) = 1 AS INT) AS is_month_start, CAST(timestamp::DATE = last_day(timestamp) AS INT) AS is_month_end,
round(sin(hour(timestamp) * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour(timestamp) * 2 * pi() / 24), 6) AS hour_cos, round(sin((isodow(timestamp) - 1) * 2 * pi() / 7), 6) AS day_sin,
round(cos((isodow(timestamp) - 1) * 2 * pi() / 7), 6) AS day_cos, round(sin(month(timestamp) * 2 * pi() / 12), 6) AS month_sin, round(cos(month(timestamp) * 2 * pi() / 12), 6) AS month_cos FROM s""")
def time_features(spark, d):
    s = rounded(events(spark, d).select("entity_id", "pos", *[c.alias(k) for k, c in X.time_columns().items()]))
    return s.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"WITH {S} SELECT entity_id, pos, " + ", ".join(f"lag(target, {k}) OVER o AS lag_{k}" for k in X.LAGS) + " FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY pos)")
def lag_features(spark, d):
    return X.in_blocks(events(spark, d).select("entity_id", "pos", "target"), max(X.LAGS), lambda by: X.lag_columns(by=by)).drop("target")


def _roll(w: int, strict: bool = False) -> str:
    f = f"OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    g = lambda x: f"CASE WHEN count(target) {f} = {w} THEN {x} END" if strict else x
    return ", ".join(f"round({g(f'{fn}(target) {f}')} + 1e-9::DOUBLE, 6) AS rolling_{k}_{w}" for k, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query(f"WITH {S} SELECT entity_id, pos, {', '.join(map(_roll, X.WINDOWS))} FROM s")
def rolling_features(spark, d):
    return rounded(X.in_blocks(events(spark, d).select("entity_id", "pos", "target"), max(X.WINDOWS), lambda by: X.rolling_columns(by=by)).drop("target"), nudge=1e-9)


@query(f"WITH {S} SELECT entity_id, pos, {_roll(7, True)} FROM s")
def strict_rolling_features(spark, d):
    return rounded(X.in_blocks(events(spark, d).select("entity_id", "pos", "target"), 7, lambda by: X.rolling_columns((7,), by=by, strict=True)).drop("target"), nudge=1e-9)


@query(f"""WITH {S}, x AS (SELECT *, lag(target, 1) OVER o - lag(target, 2) OVER o AS df FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY pos))
SELECT entity_id, pos, round(avg(df) OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling_diff_mean_6 FROM x""")
def rolling_diff_features(spark, d):
    return rounded(X.rolling_diff_mean(events(spark, d), 6).select("entity_id", "pos", "rolling_diff_mean_6"))


_E = "OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {S} SELECT entity_id, pos, round(avg(target) {_E} + 1e-9::DOUBLE, 6) AS expanding_mean, round(stddev_samp(target) {_E} + 1e-9::DOUBLE, 6) AS expanding_std FROM s")
def expanding_features(spark, d):
    return rounded(X.expanding(events(spark, d).select("entity_id", "pos", "target")).drop("target"), nudge=1e-9)


@query(f"WITH {S} SELECT entity_id, pos, " + ", ".join(f"round(target - lag(target, {k}) OVER o, 6) AS diff_{k}" for k in X.DIFFS) + " FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY pos)")
def diff_features(spark, d):
    return rounded(X.in_blocks(events(spark, d).select("entity_id", "pos", "target"), max(X.DIFFS), lambda by: X.diff_columns(by=by)).drop("target"))


@query(f"""WITH {S} SELECT entity_id, pos, round(lag(target, 1) OVER o - lag(target, 24) OVER o, 6) AS seasonal_diff, round(lag(target, 1) OVER o / (lag(target, 24) OVER o + 1e-6::DOUBLE), 4) AS seasonal_ratio
FROM s WINDOW o AS (PARTITION BY entity_id ORDER BY pos)""")
def seasonal_features(spark, d):
    s = X.in_blocks(events(spark, d), 24, lambda by: X.seasonal_columns(by=by))
    return s.select("entity_id", "pos", F.round("seasonal_diff", 6).alias("seasonal_diff"), F.round("seasonal_ratio", 4).alias("seasonal_ratio"))


def _ewm_sql() -> str:
    a = {s: f"(2.0::DOUBLE / {s + 1})" for s in X.SPANS}
    step = ", ".join(f"CASE WHEN x.x IS NULL THEN e.y{s} WHEN e.y{s} IS NULL THEN x.x ELSE (e.w{s} * (1 - {v}) * e.y{s} + {v} * x.x) / (e.w{s} * (1 - {v}) + {v}) END AS y{s}, CASE WHEN x.x IS NULL THEN e.w{s} * (1 - {v}) ELSE 1.0::DOUBLE END AS w{s}" for s, v in a.items())
    return f"""WITH RECURSIVE {S}, x AS (SELECT entity_id, pos, lag(target) OVER (PARTITION BY entity_id ORDER BY pos) AS x FROM s),
e AS (SELECT entity_id, pos, {', '.join(f'x AS y{s}, 1.0::DOUBLE AS w{s}' for s in a)} FROM x WHERE pos = 0
UNION ALL SELECT x.entity_id, x.pos, {step} FROM e JOIN x ON x.entity_id = e.entity_id AND x.pos = e.pos + 1)
SELECT entity_id, pos, {', '.join(f'round(y{s}, 6) AS ewm_{s}' for s in a)} FROM e"""


@query(_ewm_sql())
def ewm_features(spark, d):
    return rounded(X.ewm(events(spark, d).select("entity_id", "pos", "target")).drop("target"))


_PARTS = " JOIN ".join(f"({QUERIES[k].sql}) USING (entity_id, pos)" if i else f"({QUERIES[k].sql})" for i, k in enumerate(("time_features", "lag_features", "rolling_features", "diff_features", "ewm_features")))


@query(f"WITH {S} SELECT * FROM {_PARTS} JOIN (SELECT entity_id, pos, target FROM s) USING (entity_id, pos)")
def all_features(spark, d):
    f = X.all_features(events(spark, d)).drop("timestamp")
    # the means of windows are nudged as in their own query
    return f.select(*[F.round(F.col(c) + (1e-9 if c.startswith("rolling_") else 0.0), 6).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


#: Every third target missing.
_GAP = "g AS (SELECT entity_id, pos, CASE WHEN pos % 3 = 0 THEN NULL ELSE target END AS target FROM s)"
_FILLS = {
    "forward_fill": "last_value(target IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY pos)",
    "backward_fill": "first_value(target IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "mean": "round(coalesce(target, avg(target) OVER (PARTITION BY entity_id)), 6)",
    "zero": "coalesce(target, 0)",
}
for _method, _sql in _FILLS.items():

    def _filled(spark, d, method=_method):
        s = events(spark, d).select("entity_id", "pos", F.when(F.col("pos") % 3 != 0, F.col("target")).alias("target"))
        out = X.fill_missing(s, "target", method)
        return rounded(out) if method == "mean" else out

    _filled.__name__ = f"fill_{_method}"
    query(f"WITH {S}, {_GAP} SELECT entity_id, pos, {_sql} AS target FROM g")(_filled)


@query(f"""WITH {S}, {_GAP}, c AS (SELECT count(*) AS n, count(*) FILTER (entity_id IS NULL) AS e, count(*) FILTER (pos IS NULL) AS p, count(*) FILTER (target IS NULL) AS t FROM g)
SELECT 'entity_id' AS "column", e AS missing_count, round(e * 100.0::DOUBLE / n, 6) AS missing_pct, n AS total_rows FROM c UNION ALL SELECT 'pos', p, round(p * 100.0::DOUBLE / n, 6), n FROM c UNION ALL SELECT 'target', t, round(t * 100.0::DOUBLE / n, 6), n FROM c""")
def missing_profile(spark, d):
    return X.missing_profile(events(spark, d).select("entity_id", "pos", F.when(F.col("pos") % 3 != 0, F.col("target")).alias("target")))


_STAT = ("mean", "std", "min", "max", "median")


@query(f"""WITH {S}, r AS (SELECT entity_id, avg(target) AS mean, stddev_samp(target) AS std, min(target) AS min, max(target) AS max, quantile_cont(target, 0.5) AS median FROM s
WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-08' AND entity_id <> 'click' GROUP BY 1), a AS (SELECT {', '.join(f'avg({k}) AS a_{k}' for k in _STAT)} FROM r)
SELECT s.entity_id, pos, {', '.join(f'round(coalesce({k}, a_{k}), 6) AS {k}_entity_stat' for k in _STAT)} FROM s LEFT JOIN r USING (entity_id), a""")
def entity_ref_features(spark, d):
    # one entity has no reference rows, so that it gets the means
    s = events(spark, d)
    early = s.withColumn("timestamp", F.when((F.col("entity_id") == "click"), F.lit("2030-01-01").cast("timestamp")).otherwise(F.col("timestamp")))
    out = X.entity_features(early, "2024-01-01", "2024-01-08")
    return rounded(out.select("entity_id", "pos", *[f"{k}_entity_stat" for k in _STAT]))


@query(f"""WITH {S}, m AS (SELECT avg(target) AS m, stddev_pop(target) AS sd FROM s) SELECT entity_id, pos, round((target - m) / CASE WHEN sd < 1e-10 THEN 1 ELSE sd END, 6) AS target FROM s, m""")
def scaled_series(spark, d):
    return rounded(X.scaled(events(spark, d).select("entity_id", "pos", "target"), ["target"]))
