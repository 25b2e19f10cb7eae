"""Typed stream state: a restart in mid-stream, rows out of order, late rows and gaps, against the batch loop."""

import datetime as dt

import numpy as np
import pytest

from tidewatch.operators import drift
from tidewatch.streaming import stateful

POLICY = {"kind": "drift_triggered", "gap": 1, "consecutive": 1, "threshold": 0.1, "decay": 0.5}


def values():
    rng = np.random.default_rng(4)
    return np.concatenate((rng.normal(0, 1, 160), rng.normal(6, 1, 140)))


def batches(x, kind, history=100, batch=20):
    d, rules = drift.create_detector(kind).fit(x[:history]), drift.create_policy(**POLICY)
    state, out = rules.start(), []
    for k, i in enumerate(range(history, len(x) - batch + 1, batch)):
        r = d.detect(x[i : i + batch])
        go, reason = rules.decide(state, k, bool(r.drift), float(r.score), 0.0)
        out.append((k, bool(r.drift), round(float(r.score), 9), bool(go), reason))
    return out


@pytest.mark.parametrize("kind", list(drift.DETECTORS))
def test_a_dumped_detector_goes_on(kind):
    x = values()
    whole, s = drift.create_detector(kind).fit(x[:100]), drift.create_policy(**POLICY).start()
    parts = drift.create_detector(kind).fit(x[:100])
    for i in range(100, 300, 20):
        a = whole.detect(x[i : i + 20])
        parts = stateful.restore(kind, {}, *stateful.dump(parts, s), s)
        b = parts.detect(x[i : i + 20])
        assert (bool(a.drift), a.score) == (bool(b.drift), pytest.approx(b.score))


def test_a_stream_with_a_restart_equals_the_batch_loop(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x, start = values(), dt.datetime(2024, 1, 1)
    schema = "entity_id string, pos bigint, x double, ts timestamp"
    row = lambda p: ("a", int(p), float(x[p]), start + dt.timedelta(minutes=int(p)))
    n = 0

    def put(rows):
        nonlocal n
        n += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:02}"))

    def go():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = stateful.watch_ordered(stream, "ts", late="1 day", batch=20, history=100, kind="cusum", policy=POLICY, patience_ms=60_000)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(150)
        q.stop()

    order = np.random.default_rng(1).permutation(130)
    put([row(p) for p in order[:90]])  # out of order
    go()
    put([row(p) for p in order[90:]] + [row(5), row(7)])  # two that have come before
    go()  # a new query on the same checkpoint
    put([row(p) for p in range(130, 240) if p != 205])  # 205 never comes in time
    put([("b", 0, 1.0, start + dt.timedelta(days=3))])  # moves the watermark past the gap
    put([("b", 1, 1.0, start + dt.timedelta(days=3))])
    go()
    got = sorted((r.step, r.drift_detected, round(r.drift_score, 9), r.retrain, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).where("entity_id = 'a'").collect())
    # without 205 there are 239 values: six batches of 20 after the history, and 19 that wait
    assert got == batches(np.delete(x[:240], 205), "cusum") and len(got) == 6
    assert max(r.late for r in spark.read.parquet(str(tmp_path / "out")).collect()) == 2
