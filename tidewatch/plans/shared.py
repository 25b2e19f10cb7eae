"""What the queries share: the series, window lengths, and SQL of common parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adaptive
from ..operators.rolling import Layout
from ..sources.series import events_series as events  # noqa: F401

AT = Layout(120, 24, 24)
H, FC, ST = AT.history, AT.forecast, AT.step

#: The event series.
S = """s AS (
  SELECT event_type AS entity_id, ts AS timestamp, CASE WHEN isnan(value) THEN NULL ELSE value END AS target,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"""
#: Windows (w) and their test rows (t).
W = f"""{S}, n AS (SELECT entity_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= {H + FC}),
w AS (SELECT *, row_number() OVER (ORDER BY entity_id, window_id) - 1 AS step FROM (SELECT entity_id, unnest(range(0, (n - {H + FC}) // {ST} + 1)) AS window_id FROM n)),
t AS (SELECT w.entity_id, window_id, step, CAST(pos - window_id * {ST} - {H} AS INT) AS h, timestamp, target AS y_true
      FROM w JOIN s ON s.entity_id = w.entity_id AND pos >= window_id * {ST} + {H} AND pos < window_id * {ST} + {H + FC})"""
VERSION = {
    "each": "{k}", "no_retrain": "0", "fixed_retrain": "CASE WHEN {k} > 0 THEN (({k} - 1) // 10) * 10 ELSE 0 END",
}
RETRAINS = {"no_retrain": "least(nw, 1)", "fixed_retrain": "(nw + 9) // 10"}
#: CUSUM's limit and slack, in units of the series; the policy's gap, run of drifts, score and decay.
LIMIT, SLACK = 400.0, 10.0
GAP, RUN, SCORE, DECAY = 3, 2, 0.5, 0.5
PLACE = {"naive": f"{H} - 1", "seasonal_naive": f"{H} - 24 + h % 24"}
METRICS = """round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse,
  round(avg(CASE WHEN y_true <> 0 AND y_pred <> 0 THEN abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100, 6) AS smape,
  round(avg(CASE WHEN y_true <> 0 THEN abs(y_true - y_pred) / abs(y_true) END) * 100, 6) AS mape"""


def p_sql(model: str = "naive", policy: str = "each", name: str = "p") -> str:
    """Predictions, after W."""
    v = VERSION[policy].format(k="window_id")
    return f"{name} AS (SELECT t.*, b.target AS y_pred FROM t LEFT JOIN s b ON b.entity_id = t.entity_id AND b.pos = ({v}) * {ST} + {PLACE[model]})"


def loop_sql(model: str = "naive") -> str:
    """The adaptive loop, after W, value by value: loop_<model> has a row a window. Needs WITH RECURSIVE."""
    base = {"naive": f"y[{H}]", "seasonal_naive": f"y[{H} - 23 + p % 24]"}[model]
    pred = {"naive": f"y[v * {ST} + {H}]", "seasonal_naive": f"y[v * {ST} + {H} - 23 + (i + 1) % 24]"}[model]
    return f"""y_{model} AS (
  SELECT entity_id, y, list_avg([y[p + 1] - {base} for p in range(0, {H})]) AS mean, ((len(y) - {H + FC}) // {ST} + 1) * {FC} AS total
  FROM (SELECT entity_id, list(target ORDER BY pos) AS y FROM s GROUP BY 1 HAVING count(*) >= {H + FC})
), st_{model}(entity_id, i, v, used, up, down, hit, score, last_score, run, last, fired) AS (
  SELECT entity_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, false, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(-1 AS BIGINT), false FROM y_{model}
  UNION ALL
  SELECT entity_id, i, CASE WHEN fire THEN i // {FC} ELSE v END, v, up, down, hit, score, last_score, CASE WHEN fire THEN 0.0 ELSE run END, CASE WHEN fire THEN i // {FC} ELSE last END, fire
  FROM (SELECT *, ended AND ready AND last_score > {SCORE} AND run >= {RUN} AS fire
  FROM (SELECT * EXCLUDE (run, last_score), CASE WHEN ended AND score > 0 THEN score ELSE last_score END AS last_score,
               CASE WHEN ended AND ready THEN (CASE WHEN hit THEN run + 1 ELSE greatest(0.0, run - {DECAY}) END) ELSE run END AS run
  FROM (SELECT entity_id, i, v, CASE WHEN over THEN 0.0 ELSE u END AS up, CASE WHEN over THEN 0.0 ELSE d END AS down, hit OR over AS hit,
               CASE WHEN over THEN greatest(u, d) WHEN hit THEN score ELSE greatest(u, d) END AS score, last_score, run, last, i % {FC} = {FC} - 1 AS ended, i // {FC} - last >= {GAP} AS ready
  FROM (SELECT *, NOT hit AND (u > {LIMIT} OR d > {LIMIT}) AS over
  FROM (SELECT *, CASE WHEN hit OR x IS NULL THEN up ELSE greatest(0.0, up + x - {SLACK}) END AS u, CASE WHEN hit OR x IS NULL THEN down ELSE greatest(0.0, down - x - {SLACK}) END AS d
  FROM (SELECT entity_id, i + 1 AS i, v, up, down, CASE WHEN (i + 1) % {FC} = 0 THEN false ELSE hit END AS hit, score, last_score, run, last, y[i + 2 + {H}] - {pred} - mean AS x
        FROM st_{model} JOIN y_{model} USING (entity_id) WHERE i + 1 < total))))))
), loop_{model} AS (SELECT entity_id, i // {FC} AS window_id, used AS version, hit AS drift_detected, score AS drift_score, fired AS retrain FROM st_{model} WHERE i >= 0 AND i % {FC} = {FC} - 1)"""


def adaptive_sql(model: str = "naive", name: str = "p") -> str:
    """Predictions of the loop, after W and loop_sql."""
    return f"{name} AS (SELECT t.*, b.target AS y_pred FROM t JOIN loop_{model} USING (entity_id, window_id) LEFT JOIN s b ON b.entity_id = t.entity_id AND b.pos = version * {ST} + {PLACE[model]})"


def runs_sql() -> str:
    """The table of runs."""
    parts, unions = [loop_sql(model) for model in PLACE], []
    for policy in (*RETRAINS, "adaptive_retrain"):
        for model in PLACE:
            name = f"p_{policy}_{model}"
            adapts = policy == "adaptive_retrain"
            parts.append(adaptive_sql(model, name) if adapts else p_sql(model, policy, name))
            fits = f"(SELECT 1 + count_if(retrain) FROM loop_{model} l WHERE l.entity_id = dataset)" if adapts else RETRAINS[policy]
            unions.append(
                f"SELECT * EXCLUDE nw, CAST({fits} AS BIGINT) AS retrain_total, nw AS n_windows FROM (SELECT entity_id AS dataset, '{policy}' AS strategy, '{model}' AS model, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,"
                " avg(CASE WHEN y_true <> 0 AND y_pred <> 0 THEN abs(y_pred - y_true) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100 AS smape,"
                f" count(DISTINCT window_id) AS nw FROM {name} GROUP BY 1)"
            )
    return f"WITH RECURSIVE {W}, {', '.join(parts)}, runs AS ({' UNION ALL '.join(unions)})"


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles to some digits; a nudge keeps means of two-digit values, which are often exact ties, off the edge."""
    return df.select(*[F.round(F.col(c) + nudge if nudge else F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def decided(spark, d, model: str = "naive") -> DataFrame:
    """The loop of loop_sql on the event series."""
    policy = {"kind": "drift_triggered", "gap": GAP, "consecutive": RUN, "threshold": SCORE, "decay": DECAY}
    return adaptive.loop(events(spark, d), AT, model, "cusum", policy, threshold=LIMIT, drift=SLACK)
