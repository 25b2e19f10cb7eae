"""Streams: detectors and policies over micro-batches, and event-time aggregates. Extensions; the batch operators are their model."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drift import create_detector, create_policy


def windowed(events: DataFrame, ts: str, key: str, value: str, every: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, sum and mean by event-time window (tumbling, or sliding with `slide`), with a watermark."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", every, slide) if slide else F.window("__t", every)
    out = rows.groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy(F.session_window("__t", gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def watch(residuals: DataFrame, batch: int = 24, history: int = 120, kind: str = "ks_test", policy: dict | None = None) -> DataFrame:
    """entity_id, step, drift_detected, drift_score, retrain, reason for each `batch` residuals (entity_id, pos, x) of an entity.

    The first `history` values are the reference. State is the detector, the policy's counters and what does not fill a batch yet: all bounded.
    """
    settings = dict(policy or {"kind": "drift_triggered", "gap": 3})

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rules = create_policy(**settings)
        held, detector, memory, step = pickle.loads(state.get[0]) if state.exists else ([], None, rules.start(), 0)
        rows = pd.concat(list(frames)).sort_values("pos")
        held = [*held, *rows.x.astype(float)]
        out = []
        if detector is None and len(held) >= history:
            detector, held = create_detector(kind).fit(held[:history]), held[history:]
        while detector is not None and len(held) >= batch:
            r = detector.detect(held[:batch])
            detector.history.clear()
            go, reason = rules.decide(memory, step, r.drift, r.score, 0.0)
            out.append((key[0], step, bool(r.drift), float(r.score), bool(go), reason))
            held, step = held[batch:], step + 1
        state.update((pickle.dumps((held, detector, memory, step)),))
        yield pd.DataFrame(out, columns=["entity_id", "step", "drift_detected", "drift_score", "retrain", "reason"])

    schema = "entity_id string, step bigint, drift_detected boolean, drift_score double, retrain boolean, reason string"
    return residuals.groupBy("entity_id").applyInPandasWithState(update, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
