"""Queries on drift distances, detectors, policies and injection."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import inject as I
from ..operators import leaderboard as L
from ..operators import rolling as R
from ..operators import sliding
from ..streaming import online
from .catalog import query
from .shared import AT, FC, H, ST, S, W, events, p_sql, rounded


def sides(spark, d):
    """The entity's first targets, and test targets with half of the mean added in every second window."""
    s = events(spark, d)
    cur = R.test_rows(s, AT).select("entity_id", "window_id", F.when(F.col("window_id") % 2 == 1, F.col("y_true") + 25.0).otherwise(F.col("y_true")).alias("x"))
    return s.where(F.col("pos") < H).select("entity_id", F.col("target").alias("x")), cur


SIDES = f"""{W}, sd AS (SELECT entity_id, window_id, 'cur' AS side, y_true + CASE WHEN window_id % 2 = 1 THEN 25.0::DOUBLE ELSE 0 END AS x FROM t WHERE y_true IS NOT NULL
UNION ALL SELECT w.entity_id, window_id, 'ref', target FROM w JOIN s ON s.entity_id = w.entity_id WHERE pos < {H} AND target IS NOT NULL)"""
_ECDF = """v AS (SELECT entity_id, window_id, x, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM sd GROUP BY 1, 2, 3),
e AS (SELECT *, sum(r) OVER k / sum(r) OVER g AS fr, sum(c) OVER k / sum(c) OVER g AS fc, lead(x) OVER k AS nx, CAST(sum(r) OVER g AS BIGINT) AS nr, CAST(sum(c) OVER g AS BIGINT) AS nc FROM v
WINDOW k AS (PARTITION BY entity_id, window_id ORDER BY x), g AS (PARTITION BY entity_id, window_id))"""


@query(f"WITH {SIDES}, {_ECDF} SELECT entity_id, window_id, round(max(abs(fr - fc)), 6) AS ks_d, any_value(nr) AS ref_size, any_value(nc) AS cur_size FROM e GROUP BY 1, 2")
def ks_score(spark, d):
    return rounded(sliding.ks(*sides(spark, d)))


def ks_p_sql(d: str, n: str, m: str) -> str:
    """The exact p by the same counts of lattice paths, as a fold of lists; d, n and m are columns."""
    cell = f"CASE WHEN s[1] - i BETWEEN 0 AND least({n}, {m}) AND abs(i / greatest({n}, {m}) - (s[1] - i) / least({n}, {m})) < {d} - 1e-12 THEN CASE WHEN i > 0 THEN r[i] * i / s[1] ELSE 0 END + r[i + 1] * (s[1] - i) / s[1] ELSE 0.0::DOUBLE END"
    return f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - list_reduce(list_transform(range(1, {n} + {m} + 1), lambda k: [k::DOUBLE]), lambda r, s: list_transform(range(0, greatest({n}, {m}) + 1), lambda i: {cell}),
list_transform(range(0, greatest({n}, {m}) + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))[greatest({n}, {m}) + 1]))"""


@query(f"""WITH {SIDES}, {_ECDF}, g AS (SELECT entity_id, window_id, max(abs(fr - fc)) AS d, any_value(nr) AS n, any_value(nc) AS m FROM e GROUP BY 1, 2)
SELECT entity_id, window_id, round(d, 6) AS ks_d, n AS ref_size, m AS cur_size, round({ks_p_sql('d', 'n', 'm')} + 1e-9::DOUBLE, 6) AS p FROM g""")
def ks_p_value(spark, d):
    return rounded(D.with_ks_p(sliding.ks(*sides(spark, d))).withColumn("p", F.col("p") + 1e-9))


@query(f"""WITH {SIDES}, {_ECDF}, a AS (SELECT entity_id, window_id, sum(abs(fr - fc) * (nx - x)) AS w1 FROM e GROUP BY 1, 2), z AS (SELECT entity_id, window_id, stddev_pop(x) AS sd FROM sd WHERE side = 'ref' GROUP BY 1, 2)
SELECT entity_id, window_id, round(w1, 6) AS w1, round(w1 / greatest(sd, 1e-10), 6) AS w1_normalised FROM a JOIN z USING (entity_id, window_id)""")
def wasserstein_score(spark, d):
    return rounded(sliding.wasserstein(*sides(spark, d)))


def _psi_sql() -> str:
    bins = ", ".join(f"count(*) FILTER (side = '{s}' AND x >= q[{k + 1}] AND x {'<' if k < 9 else '<='} q[{k + 2}]{' + 1' if k == 9 else ''}) AS {s}{k}" for k in range(10) for s in ("ref", "cur"))
    share = lambda s, k: f"CASE WHEN {s}{k} = 0 THEN 1e-4 ELSE {s}{k} / n_{s} END"
    total = " + ".join(f"(({share('cur', k)}) - ({share('ref', k)})) * ln(({share('cur', k)}) / ({share('ref', k)}))" for k in range(10))
    return f"""WITH {SIDES}, q AS (SELECT entity_id, window_id, quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM sd WHERE side = 'ref' GROUP BY 1, 2),
c AS (SELECT entity_id, window_id, {bins}, count(*) FILTER (side = 'ref') AS n_ref, count(*) FILTER (side = 'cur') AS n_cur FROM sd JOIN q USING (entity_id, window_id) GROUP BY 1, 2), p AS (SELECT entity_id, window_id, {total} AS psi FROM c)
SELECT entity_id, window_id, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END AS category FROM p"""


@query(_psi_sql())
def psi_score(spark, d):
    return rounded(sliding.psi(*sides(spark, d)))


@query(f"""WITH {S}, n AS (SELECT entity_id, count(*) AS n FROM s WHERE target IS NOT NULL GROUP BY 1), m AS (SELECT entity_id, avg(target) FILTER (pos < n // 2) AS a, avg(target) FILTER (pos >= n // 2) AS b,
var_samp(target) FILTER (pos < n // 2) AS va, var_samp(target) FILTER (pos >= n // 2) AS vb FROM s JOIN n USING (entity_id) GROUP BY 1) SELECT entity_id, round(CASE WHEN va + vb > 0 THEN abs(b - a) / sqrt((va + vb) / 2) ELSE 0 END, 6) AS effect FROM m""")
def cohen_split_score(spark, d):
    return rounded(D.split_effect(events(spark, d).where("target is not null").select("entity_id", F.col("pos").alias("i"), F.col("target").alias("x")), "entity_id"))


@query(f"WITH {S} SELECT entity_id, " + ", ".join(f"count(*) FILTER (target >= {a} AND target {'<=' if b == 200 else '<'} {b}) AS bin_{k}" for k, (a, b) in enumerate(((0, 10), (10, 50), (50, 100), (100, 200)))) + " FROM s GROUP BY 1")
def value_histogram(spark, d):
    return D.histogram(events(spark, d).withColumnRenamed("target", "x"), [0.0, 10.0, 50.0, 100.0, 200.0], "entity_id")


@query(f"WITH {S} SELECT entity_id, " + ", ".join(f"round(quantile_cont(target, {p}), 6) AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM s GROUP BY 1")
def value_percentiles(spark, d):
    return rounded(events(spark, d).groupBy("entity_id").agg(*[F.percentile("target", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))


def _targets(spark, d):
    s = events(spark, d)
    p = R.predictions(s, AT)
    return p, s.where((F.col("pos") < H) & F.col("target").isNotNull()).select("entity_id", "pos", F.col("target").alias("x"))


_REF = f"ref AS (SELECT entity_id, avg(target) AS mu, count(target) AS nr FROM s WHERE pos < {H} GROUP BY 1), x AS (SELECT entity_id, window_id, h, y_true AS x, row_number() OVER (PARTITION BY entity_id ORDER BY window_id, h) AS i FROM t WHERE y_true IS NOT NULL)"


@query(f"""WITH RECURSIVE {W}, {_REF}, f AS (
SELECT entity_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS window_id, 0.0::DOUBLE AS c, nr AS n, false AS stopped, mu FROM ref
UNION ALL SELECT f.entity_id, x.i, x.window_id, CASE WHEN f.stopped AND f.window_id = x.window_id THEN f.c ELSE (1 - 0.005::DOUBLE) * (f.c + x.x - f.mu - 0.005::DOUBLE) END,
CASE WHEN f.stopped AND f.window_id = x.window_id THEN f.n ELSE f.n + 1 END,
CASE WHEN f.stopped AND f.window_id = x.window_id THEN true ELSE abs((1 - 0.005::DOUBLE) * (f.c + x.x - f.mu - 0.005::DOUBLE)) > 50.0 END, f.mu
FROM f JOIN x ON x.entity_id = f.entity_id AND x.i = f.i + 1)
SELECT entity_id, window_id, arg_max(stopped, i) AS drift_detected, round(arg_max(abs(c) / n, i), 6) AS drift_score FROM f WHERE window_id >= 0 GROUP BY 1, 2""")
def page_hinkley(spark, d):
    p, ref = _targets(spark, d)
    return rounded(D.detect_windows(p, ref, "page_hinkley", on="target"))


@query(f"""WITH RECURSIVE {W}, {_REF}, f AS (
SELECT entity_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS window_id, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0.0::DOUBLE AS score, false AS stopped, mu FROM ref
UNION ALL SELECT entity_id, i, wid, CASE WHEN skip THEN up WHEN hit THEN 0.0 ELSE u END, CASE WHEN skip THEN dn WHEN hit THEN 0.0 ELSE v END, CASE WHEN skip THEN score ELSE greatest(u, v) END, skip OR hit, mu
FROM (SELECT *, NOT skip AND greatest(u, v) > 200 AS hit FROM (SELECT f.entity_id, x.i, x.window_id AS wid, f.stopped AND f.window_id = x.window_id AS skip, f.up, f.dn, f.score, f.mu,
greatest(0.0::DOUBLE, f.up + x.x - f.mu - 0.1::DOUBLE) AS u, greatest(0.0::DOUBLE, f.dn - (x.x - f.mu) - 0.1::DOUBLE) AS v FROM f JOIN x ON x.entity_id = f.entity_id AND x.i = f.i + 1)))
SELECT entity_id, window_id, arg_max(stopped, i) AS drift_detected, round(arg_max(score, i), 6) AS drift_score FROM f WHERE window_id >= 0 GROUP BY 1, 2""")
def cusum(spark, d):
    p, ref = _targets(spark, d)
    return rounded(D.detect_windows(p, ref, "cusum", on="target", threshold=200.0))


# the detectors below are fed residuals of the naive forecast; their windows are lists that the recursion carries
_BATCHES = f"""{W}, {p_sql()}, b AS (SELECT entity_id, window_id, coalesce(list(y_true - y_pred ORDER BY h) FILTER (y_true - y_pred IS NOT NULL), []) AS b FROM p GROUP BY 1, 2),
rf AS (SELECT entity_id, list(target ORDER BY pos) FILTER (target IS NOT NULL) AS r FROM s WHERE pos < {H} GROUP BY 1)"""
_NEXT = "f JOIN b ON b.entity_id = f.entity_id AND b.window_id = f.k + 1"
_FOUND = "SELECT entity_id, k AS window_id, drift AS drift_detected, round(score, 6) AS drift_score FROM f WHERE k >= 0"

_ADWIN = f"""WITH RECURSIVE {_BATCHES}, f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, r AS w, false AS drift, 0.0::DOUBLE AS score FROM rf
UNION ALL SELECT entity_id, k, CASE WHEN d > 0.5 THEN w[len(w) // 2 + 1:] ELSE w END, d > 0.5, d FROM (
SELECT entity_id, k, w, CASE WHEN len(w) >= 60 AND pooled > 1e-10 THEN abs(list_avg(w[len(w) // 2 + 1:]) - list_avg(w[:len(w) // 2])) / pooled ELSE 0.0::DOUBLE END AS d FROM (
SELECT *, sqrt((list_var_samp(w[:len(w) // 2]) + list_var_samp(w[len(w) // 2 + 1:])) / 2) AS pooled FROM (SELECT f.entity_id, b.window_id AS k, list_concat(f.w, b.b)[-1000:] AS w FROM {_NEXT}))))
{_FOUND}"""

_WASSERSTEIN = f"""WITH RECURSIVE {_BATCHES}, f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, r AS old, CAST([] AS DOUBLE[]) AS w, false AS drift, 0.0::DOUBLE AS score FROM rf
UNION ALL SELECT entity_id, k, CASE WHEN d > 0.1 THEN w ELSE old END, CASE WHEN d > 0.1 THEN [] ELSE w END, d > 0.1, d FROM (
SELECT *, CASE WHEN len(w) < 30 THEN 0.0::DOUBLE ELSE list_sum(list_transform(range(1, len(x)), lambda i: (x[i + 1] - x[i]) * abs(
len(list_filter(old, lambda v: v <= x[i])) / len(old) - len(list_filter(w, lambda v: v <= x[i])) / len(w)))) / greatest(list_stddev_pop(old), 1e-10::DOUBLE) END AS d FROM (
SELECT *, list_sort(list_concat(old, w)) AS x FROM (SELECT f.entity_id, b.window_id AS k, f.old, list_concat(f.w, b.b)[-100:] AS w FROM {_NEXT}))))
{_FOUND}"""


def _psi_detector_sql() -> str:
    # linear interpolation between the two nearest order statistics, from the nearer one
    near = lambda q: f"(len(o) - 1) * {q!r}::DOUBLE"
    edge = lambda q: f"""(CASE WHEN {near(q)} - floor({near(q)}) < 0.5 THEN o[floor({near(q)})::INT + 1] + (o[ceil({near(q)})::INT + 1] - o[floor({near(q)})::INT + 1]) * ({near(q)} - floor({near(q)}))
ELSE o[ceil({near(q)})::INT + 1] - (o[ceil({near(q)})::INT + 1] - o[floor({near(q)})::INT + 1]) * (1 - ({near(q)} - floor({near(q)}))) END)"""  # noqa: E731
    edges = ", ".join(edge(float(q)) + (" + 1" if k == 10 else "") for k, q in enumerate(np.linspace(0, 1, 11)))
    share = lambda x: f"list_transform(range(1, 11), lambda i: greatest(len(list_filter({x}, lambda v: v >= q[i] AND (v < q[i + 1] OR (i = 10 AND v = q[11])))) / len({x}), 0.0::DOUBLE))"
    some = lambda x: f"(CASE WHEN {x} = 0 THEN 1e-4::DOUBLE ELSE {x} END)"
    return f"""WITH RECURSIVE {_BATCHES}, f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, r AS old, CAST([] AS DOUBLE[]) AS w, false AS drift, 0.0::DOUBLE AS score FROM rf
UNION ALL SELECT entity_id, k, CASE WHEN d > 0.2 THEN w ELSE old END, CASE WHEN d > 0.2 THEN [] ELSE w END, d > 0.2, d FROM (
SELECT *, CASE WHEN len(w) < 2 THEN 0.0::DOUBLE ELSE list_sum(list_transform(range(1, 11), lambda i: ({some("a[i]")} - {some("e[i]")}) * ln({some("a[i]")} / {some("e[i]")}))) END AS d FROM (
SELECT *, {share("old")} AS e, {share("w")} AS a FROM (SELECT *, [{edges}] AS q FROM (
SELECT f.entity_id, b.window_id AS k, f.old, list_sort(f.old) AS o, list_concat(f.w, b.b)[-1000:] AS w FROM {_NEXT})))))
{_FOUND}"""



def _ks_detector_sql(start: str, windows: str, short: str, kept: str) -> str:
    """start: old and w at first; windows: what a batch makes of w; short: too few values; kept: old and w after it, by `drift`."""
    share = lambda x: f"len(list_filter({x}, lambda u: u <= v)) / len({x})"
    return f"""WITH RECURSIVE {_BATCHES}, f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, {start}, false AS drift, 0.0::DOUBLE AS score FROM rf
UNION ALL SELECT entity_id, k, {kept}, drift, d FROM (
SELECT *, d > 0 AND (CASE WHEN pooled > 1e-10 THEN abs(list_avg(old) - list_avg(w)) / pooled ELSE 0 END > 0.5 OR {ks_p_sql("d", "len(old)", "len(w)")} < 0.05) AS drift FROM (
SELECT *, CASE WHEN {short} THEN 0.0::DOUBLE ELSE list_max(list_transform(list_concat(old, w), lambda v: abs({share("old")} - {share("w")}))) END AS d, CASE WHEN {short} THEN 0.0::DOUBLE ELSE sqrt((list_var_pop(old) + list_var_pop(w)) / 2) END AS pooled FROM (
SELECT f.entity_id, b.window_id AS k, f.old, {windows} AS w, b.b AS x FROM {_NEXT}))))
{_FOUND}"""


_RESIDUAL_KS = _ks_detector_sql("r[-100:] AS old, CAST([] AS DOUBLE[]) AS w", "list_concat(f.w, b.b)[-100:]", "least(len(old), len(w)) < 30", "CASE WHEN drift THEN w ELSE old END, CASE WHEN drift THEN [] ELSE w END")
_KS_TEST = _ks_detector_sql("r AS old, r[-200:] AS w", "list_concat(f.w, b.b)[-200:]", "len(w) < 50 OR len(old) = 0", "CASE WHEN drift OR len(x) = 0 THEN old ELSE list_append(old[2:], x[-1]) END, w")
_DETECTOR_SQL = {"adwin": _ADWIN, "residual_ks": _RESIDUAL_KS, "wasserstein": _WASSERSTEIN, "ks_test": _KS_TEST, "psi": _psi_detector_sql()}


def detector_ctes(kinds, series: str) -> str:
    """The recursions of detectors on the targets of another series, as f_<kind>; needs WITH RECURSIVE."""
    batches = _BATCHES.replace(S, series, 1).replace("y_true - y_pred", "y_true")
    parts = [_DETECTOR_SQL[k].removeprefix(f"WITH RECURSIVE {_BATCHES}, ").removesuffix(_FOUND) for k in kinds]
    return ", ".join([batches, *[re.sub(r"\bf\b", f"f_{k}", part) for k, part in zip(kinds, parts, strict=True)]])


for _kind, _sql in _DETECTOR_SQL.items():

    def _detected(spark, d, kind=_kind):
        p, ref = _targets(spark, d)
        return rounded(D.detect_windows(p, ref, kind))

    _detected.__name__ = f"detector_{_kind}"
    query(_sql)(_detected)


def observed(spark, d):
    """Windows with a drift flag (KS distance over 0.3) and score, and the error average."""
    k = sliding.ks(*sides(spark, d)).select("entity_id", "window_id", (F.col("ks_d") > 0.3).alias("drift_detected"), (F.col("ks_d") + 0.3).alias("drift_score"))
    m = R.error_moving_average(R.window_metrics(R.predictions(events(spark, d), AT)))
    return m.join(k, ["entity_id", "window_id"]).withColumnRenamed("error_ma", "error")


OBSERVED = f"""{SIDES}, {_ECDF}, {p_sql()}, ks AS (SELECT entity_id, window_id, max(abs(fr - fc)) > 0.3 AS drift, max(abs(fr - fc)) + 0.3::DOUBLE AS score FROM e GROUP BY 1, 2),
m AS (SELECT entity_id, window_id, step, min(timestamp) AS timestamp, avg(abs(y_true - y_pred)) AS mae FROM p GROUP BY 1, 2, 3), ob AS (SELECT * FROM m JOIN ks USING (entity_id, window_id))"""


@query(f"""WITH RECURSIVE {OBSERVED}, f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS last, 0.0::DOUBLE AS c, false AS retrain, CAST(0 AS BIGINT) AS total FROM (SELECT DISTINCT entity_id FROM ob)
UNION ALL SELECT entity_id, k, CASE WHEN go THEN k ELSE last END, CASE WHEN go THEN 0.0 ELSE c END, go, total + go::BIGINT FROM (SELECT *, NOT cool AND score > 0.5 AND c >= 2 AS go FROM (
SELECT f.entity_id, ob.window_id AS k, f.last, f.total, ob.score, ob.window_id - f.last < 3 AS cool, CASE WHEN ob.window_id - f.last < 3 THEN f.c WHEN ob.drift THEN f.c + 1 ELSE greatest(0.0, f.c - 0.5::DOUBLE) END AS c
FROM f JOIN ob ON ob.entity_id = f.entity_id AND ob.window_id = f.k + 1)))
SELECT f.entity_id, w.step, retrain, total AS total_retrains FROM f JOIN w ON w.entity_id = f.entity_id AND w.window_id = f.k""")
def drift_triggered_trace(spark, d):
    return D.policy_trace(observed(spark, d), D.create_policy("drift", gap=3, consecutive=2)).drop("reason")


@query(f"""WITH RECURSIVE {OBSERVED}, f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS last, 4.0::DOUBLE AS budget, false AS retrain, CAST(0 AS BIGINT) AS total FROM (SELECT DISTINCT entity_id FROM ob)
UNION ALL SELECT entity_id, k, CASE WHEN go THEN k ELSE last END, CASE WHEN go THEN budget - 1 ELSE budget END, go, total + go::BIGINT FROM (
SELECT f.entity_id, ob.window_id AS k, f.last, f.budget, f.total, ob.window_id - f.last >= 5 AND f.budget >= 1 AND ob.drift AS go FROM f JOIN ob ON ob.entity_id = f.entity_id AND ob.window_id = f.k + 1))
SELECT f.entity_id, w.step, retrain, total AS total_retrains FROM f JOIN w ON w.entity_id = f.entity_id AND w.window_id = f.k""")
def budget_trace(spark, d):
    return D.policy_trace(observed(spark, d), D.create_policy("budget")).drop("reason")


@query(f"WITH {OBSERVED} SELECT entity_id, step, window_id % 10 = 0 AS retrain, CAST(1 + window_id // 10 AS BIGINT) AS total_retrains FROM ob")
def fixed_schedule_trace(spark, d):
    return D.policy_trace(observed(spark, d), D.create_policy("fixed", interval=10)).drop("reason")


@query(f"WITH {OBSERVED} SELECT entity_id, step, window_id = 0 AS retrain, CAST(1 AS BIGINT) AS total_retrains FROM ob")
def no_retraining_trace(spark, d):
    return D.policy_trace(observed(spark, d), D.create_policy("none")).drop("reason")


@query(f"""WITH RECURSIVE {OBSERVED}, ma AS (SELECT entity_id, window_id, step, coalesce(avg(mae) OVER (PARTITION BY entity_id ORDER BY window_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS err FROM ob), f AS (
SELECT entity_id, CAST(-1 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS step, CAST(-1 AS BIGINT) AS last, CAST([] AS DOUBLE[]) AS e, CAST(NULL AS DOUBLE) AS base, false AS retrain, '' AS reason, CAST(0 AS BIGINT) AS total FROM (SELECT DISTINCT entity_id FROM ob)
UNION ALL SELECT entity_id, k, step, CASE WHEN go THEN k ELSE last END, CASE WHEN go THEN [] ELSE e END, base, go, CASE WHEN go THEN 'errors_over_' || printf('%.3f', lim) WHEN k - last < 5 THEN 'cooldown' ELSE 'errors_normal' END, total + go::BIGINT FROM (
SELECT *, k - last >= 5 AND len(list_filter(e[-10:], lambda v: v > lim)) >= 2 AS go FROM (SELECT *, coalesce(base * 1.1::DOUBLE, 0.1::DOUBLE) AS lim FROM (
SELECT * REPLACE (CASE WHEN base IS NULL AND len(e) >= 10 THEN list_avg(e[:10]) ELSE base END AS base) FROM (
SELECT f.entity_id, ma.window_id AS k, ma.step, f.last, f.base, f.total, CASE WHEN ma.err > 0 THEN list_append(f.e, ma.err)[-100:] ELSE f.e END AS e FROM f JOIN ma ON ma.entity_id = f.entity_id AND ma.window_id = f.k + 1)))))
SELECT entity_id, step, retrain, reason, total AS total_retrains FROM f WHERE k >= 0""")
def error_threshold_trace(spark, d):
    return D.policy_trace(observed(spark, d), D.create_policy("error_threshold"))


@query(f"""WITH {OBSERVED}, l AS (SELECT *, window_id % 10 = 0 AS retrain FROM ob), g AS (SELECT entity_id, epoch(timestamp) - lag(epoch(timestamp)) OVER (PARTITION BY entity_id ORDER BY step) AS gap FROM l WHERE retrain),
h AS (SELECT entity_id, avg(gap) / 3600.0 AS a, quantile_cont(gap, 0.5) / 3600.0 AS b FROM g GROUP BY 1)
SELECT entity_id, count(*) FILTER (retrain) AS total_retrains, count(*) FILTER (retrain AND drift) AS drift_triggered, count(*) AS steps, round(any_value(a), 2) AS mean_hours, round(any_value(b), 2) AS median_hours,
round(count(*) FILTER (retrain) / count(*), 6) AS retrain_rate FROM l LEFT JOIN h USING (entity_id) GROUP BY 1""")
def retrain_stats(spark, d):
    log = observed(spark, d).withColumn("retrain", F.col("window_id") % 10 == 0)
    s = D.retraining_statistics(log)
    return s.select("entity_id", "total_retrains", "drift_triggered", "steps", F.round("mean_hours", 2).alias("mean_hours"), F.round("median_hours", 2).alias("median_hours"), F.round("retrain_rate", 6).alias("retrain_rate"))


@query(f"""WITH {OBSERVED} SELECT entity_id, count(*) AS n_windows, count(*) FILTER (drift) AS n_drift, round(avg(drift::DOUBLE), 6) AS drift_rate, count(*) FILTER (window_id % 10 = 0) AS n_retrains, round(avg(mae), 6) AS mean_mae,
round(stddev_samp(mae), 6) AS std_mae, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, round(avg(mae) FILTER (drift), 6) AS mae_drift, round(avg(mae) FILTER (NOT drift), 6) AS mae_quiet,
round(avg(mae) FILTER (drift) - avg(mae) FILTER (NOT drift), 6) AS mae_difference FROM ob GROUP BY 1""")
def run_summary(spark, d):
    return rounded(L.summary(observed(spark, d).withColumn("retrained", F.col("window_id") % 10 == 0), "entity_id"))


@query(f"""WITH {OBSERVED}, r AS (SELECT *, sum(CASE WHEN drift <> pd THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY window_id) AS g FROM (SELECT *, lag(drift, 1, false) OVER (PARTITION BY entity_id ORDER BY window_id) AS pd FROM ob)),
z AS (SELECT entity_id, g, any_value(drift) AS d, min(window_id) AS first, max(window_id) AS last, count(*) AS n FROM r GROUP BY 1, 2), y AS (SELECT *, lead(n) OVER (PARTITION BY entity_id ORDER BY g) AS calm FROM z)
SELECT entity_id, first, last, last - first + 1 AS recovered_after FROM y WHERE d AND calm >= 1""")
def drift_recoveries(spark, d):
    return L.recoveries(observed(spark, d), quiet=1)


@query(f"WITH {OBSERVED} SELECT entity_id, step, round(mae, 6) AS mae FROM ob ORDER BY step LIMIT 100")
def first_windows(spark, d):
    return observed(spark, d).orderBy("step").limit(100).select("entity_id", "step", F.round("mae", 6).alias("mae"))


@query(f"WITH {OBSERVED} SELECT entity_id, step, round(avg(mae) OVER (PARTITION BY entity_id ORDER BY window_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-9::DOUBLE, 6) AS mae_ma10 FROM ob")
def mae_moving_average(spark, d):
    w = Window.partitionBy("entity_id").orderBy("window_id").rowsBetween(-9, 0)
    return observed(spark, d).select("entity_id", "step", F.round(F.avg("mae").over(w) + 1e-9, 6).alias("mae_ma10"))


# ---- injection --------------------------------------------------------------------------------------------------------------

_IN = "timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20'"
_PERIOD = dict(start="2024-01-10", end="2024-01-20")
_Z = f"z AS (SELECT *, {_IN} AS inside FROM s)"
_INJECT = {
    "sudden_mean_shift": f"WITH {S}, {_Z} SELECT entity_id, pos, round(target + CASE WHEN inside THEN 0.5 * avg(target) FILTER (inside) OVER (PARTITION BY entity_id) ELSE 0 END, 6) AS target FROM z",
    "gradual_drift": f"""WITH {S}, {_Z} SELECT entity_id, pos, round(CASE WHEN inside THEN target + target * 0.5 * 0.01 * (row_number() OVER (PARTITION BY entity_id, inside ORDER BY pos) - 1) / count(*) OVER (PARTITION BY entity_id, inside) ELSE target END, 6) AS target FROM z""",
    "variance_increase": f"""WITH {S}, {_Z}, m AS (SELECT entity_id, avg(target) AS m, stddev_pop(target) AS sd FROM z WHERE inside GROUP BY 1)
SELECT entity_id, pos, round(CASE WHEN inside AND sd > 0 THEN (target - m) * 1.5 + m ELSE target END, 6) AS target FROM z LEFT JOIN m USING (entity_id)""",
    "seasonal_phase_shift": f"""WITH {S}, {_Z}, hr AS (SELECT entity_id, hour(timestamp) AS hh, min(pos) AS p, arg_min(target, pos) AS v FROM z WHERE inside GROUP BY 1, 2),
c AS (SELECT z.entity_id, z.pos, v, row_number() OVER (PARTITION BY z.entity_id, z.pos ORDER BY abs(hh - (hour(timestamp) + 6) % 24), p) AS k FROM z JOIN hr USING (entity_id) WHERE inside)
SELECT z.entity_id, z.pos, round(CASE WHEN inside THEN v ELSE target END, 6) AS target FROM z LEFT JOIN c ON c.entity_id = z.entity_id AND c.pos = z.pos AND k = 1""",
}
for _kind, _sql in _INJECT.items():

    def _injected(spark, d, kind=_kind):
        return rounded(I.inject(events(spark, d), I.Drift(kind, **_PERIOD)).select("entity_id", "pos", "target"))

    _injected.__name__ = f"inject_{_kind}"
    query(_sql)(_injected)


@query(f"""WITH {S}, a AS (SELECT *, row_number() OVER (ORDER BY entity_id, pos) - 1 AS i, count(*) OVER () AS n FROM s), z AS (SELECT *, i >= n // 2 AS inside FROM a)
SELECT entity_id, pos, round(target + CASE WHEN inside THEN 0.5 * avg(target) FILTER (inside) OVER (PARTITION BY entity_id) ELSE 0 END, 6) AS target FROM z""")
def inject_second_half(spark, d):
    return rounded(I.inject(events(spark, d), I.Drift("sudden_mean_shift")).select("entity_id", "pos", "target"))


@query()
def inject_concept_drift(spark, d):
    s = events(spark, d).withColumn("f", F.col("target") * 2)
    return rounded(I.inject(s, I.Drift("concept_drift", features=("f",), **_PERIOD)).select("entity_id", "pos", "target"))


@query(f"WITH {S}, {_Z} SELECT count(*) AS n_rows, count(*) FILTER (inside) AS n_drift, round(count(*) FILTER (inside) / count(*), 6) AS drift_fraction FROM z")
def drift_period_info(spark, d):
    return rounded(I.period_info(events(spark, d), I.Drift(**_PERIOD)))


# ---- streaming forms over a bounded input -----------------------------------------------------------------------------------


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2""")
def hourly_windows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    out = online.windowed(e, "ts", "event_type", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))


@query("""WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM k GROUP BY event_type, k""")
def event_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return online.sessions(e, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
