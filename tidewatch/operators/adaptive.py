"""The adaptive loop: each window's forecast is observed by a detector, a policy decides on a retrain, and a retrain moves the training
window that serves the next forecasts.

The order within a window is predict, detect, decide, refit. A loop is sequential, so one task folds one entity (one task folds all
entities in `shared` scope, which is one sequence by its meaning); entities run side by side. A fold reads its rows in order and holds a window
and a batch of them, however long the series are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from . import drift, learned, ordered
from .rolling import Layout, test_rows, version, windows

ERRORS = 5
SCHEMA = "entity_id string, window_id bigint, v_entity string, v_window bigint, drift_detected boolean, drift_score double, error double, retrain boolean, reason string"


def loop(
    series: DataFrame, at: Layout, model: str = "naive", detector: str = "ks_test", policy: Mapping[str, object] | None = None, scope: str = "entity",
    reference: str = "residual", m: int = 24, make: learned.Make | None = None, on: str = "residual", **params: float,
) -> DataFrame:
    """For each window: the window (v_entity, v_window) whose history its forecast was fitted on, what the detector found in the residuals,
    the mean error of the ERRORS windows before, and the policy's decision.

    The detector starts from the first history: its targets, or with reference `residual` their differences from the first fit.
    model: naive (also for lstm) or seasonal_naive. Missing residuals are not shown to the detector; a series too short for a window has no rows.

    on: what the detector is shown, residuals or targets (it then starts from targets, too).

    make: a learner instead of a baseline, over a series with features x (models.prepared). Then detector and policy see the residuals of the learned model
    itself, fitted anew on the rows of a window at each retrain only, and rows have its forecasts, y_pred, as an array.
    """
    model = "naive" if model == "lstm" else model
    if model not in ("naive", "seasonal_naive") or not {reference, on} <= {"residual", "target"} or scope not in ("entity", "shared"):
        raise ValueError(f"no loop for {model}, {reference}, {scope}")
    if make is None and model == "seasonal_naive" and m > at.history:
        raise ValueError("the history is shorter than a season")
    h, f, s = at.history, at.forecast, at.step
    rules = drift.create_policy(**(policy or {"kind": "drift_triggered", "gap": 3, "consecutive": 2, "threshold": 0.5, "decay": 0.5}))

    def starts() -> dict:
        return {"found": None, "rules": rules.start(), "served": None, "fitted": None, "step": 0}

    def each(name: object, parts: Iterator[pd.DataFrame], s_: dict) -> Iterator[pd.DataFrame]:
        """The loop over one entity. y (and x) hold its rows from position `low` on: those of the next window, and what is left of a batch."""
        y, x, low, k, errors = np.empty(0), None, 0, 0, deque(maxlen=ERRORS)

        def fit(v: int) -> object:
            """What serves from here on: a model, or the targets that a baseline repeats (as numbers of steps after the history)."""
            a = v * s - low
            return make(x[a : a + h], y[a : a + h], v * s).fit(0, h) if make else (y[a + h - 1 : a + h] if model == "naive" else y[a + h - m : a + h])

        def says(a: int, b: int, first: int) -> np.ndarray:
            """Forecasts of the rows from a to b; for a baseline, of steps after its history from `first` on."""
            return s_["fitted"].predict(x[a - low : b - low]) if make else s_["fitted"][(np.arange(b - a) + first) % len(s_["fitted"])]

        for part in parts:
            y, out = np.concatenate((y, part["target"].to_numpy(float))), []
            if make:
                x = learned.matrix(part["x"]) if x is None or not len(x) else np.vstack((x, learned.matrix(part["x"])))
            while k * s + h + f <= low + len(y):
                start, end = k * s, k * s + h
                if s_["found"] is None:
                    s_["served"], s_["fitted"] = (name, 0), fit(0)
                    s_["found"] = drift.create_detector(detector, **params).fit(y[:h] - says(0, h, -h) if reference == on == "residual" else y[:h])
                y_pred = says(end, end + f, 0)
                seen_y = y[end - low : end - low + f]
                gap = seen_y - y_pred
                seen = s_["found"].observe(gap if on == "residual" else seen_y)
                error = float(np.mean(errors)) if errors else 0.0
                go, reason = rules.decide(s_["rules"], s_["step"], bool(seen.drift), float(seen.score), error)
                out.append((name, k, *s_["served"], bool(seen.drift), float(seen.score), error, bool(go), reason, *([y_pred] if make else [])))
                gap = gap[~np.isnan(gap)]
                if len(gap):
                    errors.append(float(np.abs(gap).mean()))
                if go:
                    s_["served"], s_["fitted"] = (name, k), fit(k)
                s_["step"] += 1
                k += 1
            drop = min(k * s - low, len(y))  # a step may pass over rows that aren't here yet
            y, x, low = y[drop:].copy(), x[drop:].copy() if make else None, low + drop
            yield pd.DataFrame(out, columns=names)

    schema = SCHEMA + (", y_pred array<double>" if make else "")
    names = [c.split()[0] for c in schema.split(", ")]
    columns = ["entity_id", "pos", F.col("target").cast("double").alias("target"), *(["x"] if make else [])]
    rows = series.select(*columns).where(F.col("entity_id").isNotNull())
    if scope == "entity":
        return ordered.fold(rows, "entity_id", ("pos",), lambda name, parts: each(name, parts, starts()), schema)

    def sequence(entities: Iterator[tuple[object, Iterator[pd.DataFrame]]]) -> Iterator[pd.DataFrame]:
        state = starts()
        for name, parts in entities:
            yield from each(name, parts, state)

    return ordered.fold_all(rows, "entity_id", ("pos",), sequence, schema)


def predictions(series: DataFrame, at: Layout, decided: DataFrame, model: str = "naive", m: int = 24) -> DataFrame:
    """entity_id, window_id, step, h, timestamp, y_true, y_pred of a loop's windows, each from the history that serves it."""
    if "y_pred" in decided.columns:
        own = decided.select("entity_id", "window_id", "y_pred").join(windows(series, at).select("entity_id", "window_id", "step"), ["entity_id", "window_id"])
        rows = test_rows(series, at).join(own, ["entity_id", "window_id"]).withColumn("y_pred", F.get("y_pred", F.col("h")))
        return rows.select("entity_id", "window_id", "step", "h", "timestamp", "y_true", "y_pred")
    served = decided.select("entity_id", "window_id", "v_entity", "v_window").join(windows(series, at).select("entity_id", "window_id", "step"), ["entity_id", "window_id"])
    end = F.col("v_window") * at.step + at.history
    rows = test_rows(series, at).join(served, ["entity_id", "window_id"]).withColumn("v_pos", end - m + F.col("h") % m if model == "seasonal_naive" else end - 1)
    values = series.select(F.col("entity_id").alias("v_entity"), F.col("pos").alias("v_pos"), F.col("target").alias("y_pred"))
    return rows.join(values, ["v_entity", "v_pos"], "left").select("entity_id", "window_id", "step", "h", "timestamp", "y_true", "y_pred")


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a window as one array, by h."""
    return rows.groupBy("entity_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("h", "y_true"))).alias(name))


def run_table(
    series: DataFrame, at: Layout, decided: Mapping[str, DataFrame], policies: tuple[str, ...] = ("no_retrain", "fixed_retrain", "adaptive_retrain"), every: int = 10, m: int = 24
) -> DataFrame:
    """A leaderboard row for each entity (as dataset), policy and baseline model, in one plan; retrain_total counts the first fit too.

    decided: for each model, the loop whose decisions are its adaptive_retrain. Windows, test rows and the ends of histories are made once; every policy
    and model is a row a window that names the history it is forecast from.
    """
    if m > at.history:
        raise ValueError("the history is shorter than a season")
    fixed = [p for p in policies if p != "adaptive_retrain"]
    k, first = F.col("window_id"), (F.col("window_id") == 0).cast("int")
    due = {"no_retrain": first, "fixed_retrain": (k % every == 0).cast("int"), "each": F.lit(1)}
    cases = [F.struct(F.lit(n).alias("model"), F.lit(p).alias("strategy"), version(p, k, every).alias("v_window"), due[p].alias("fits")) for p in fixed for n in decided]
    served = []
    if cases:
        served.append(windows(series, at).select("entity_id", "window_id", F.explode(F.array(*cases)).alias("c")).select("entity_id", "window_id", "c.*"))
    if "adaptive_retrain" in policies:
        fits = (first + F.col("retrain").cast("int")).alias("fits")
        served += [d.select("entity_id", "window_id", F.lit(n).alias("model"), F.lit("adaptive_retrain").alias("strategy"), "v_window", fits) for n, d in decided.items()]
    runs = reduce(DataFrame.unionByName, served)
    ends = _lists(test_rows(series, Layout(at.history - m, m, at.step)), "end").withColumnRenamed("window_id", "v_window")
    rows = runs.join(ends, ["entity_id", "v_window"]).join(_lists(test_rows(series, at), "y"), ["entity_id", "window_id"])
    rows = rows.withColumn("r", F.explode("y")).withColumn("at", F.when(F.col("model") == "seasonal_naive", F.col("r.h") % m + 1).otherwise(m))
    rows = rows.select(F.col("entity_id").alias("dataset"), "strategy", "model", "fits", "r.h", "r.y_true", F.element_at("end", F.col("at")).getField("y_true").alias("y_pred"))
    return rows.groupBy("dataset", "strategy", "model").agg(
        M.mae().alias("mae"), M.rmse().alias("rmse"), M.smape().alias("smape"), F.sum(F.when(F.col("h") == 0, F.col("fits"))).alias("retrain_total"), F.count_if(F.col("h") == 0).alias("n_windows")
    )
