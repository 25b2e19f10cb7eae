"""The store of runs: written and read as a data source, filters that choose folders, commits, and questions to it."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import experiment
from tidewatch.operators.rolling import Layout
from tidewatch.sources import run_store as S

STAMP = dt.datetime(2024, 1, 2, 3, 4, 5)
RUNS = [(d, s, m) for d in ("brent", "wti") for s in ("no_retrain", "fixed_retrain") for m in ("naive", "rf")]


def windows(spark, rows):
    return spark.createDataFrame(rows, "dataset string, strategy string, model string, entity_id string, window_id bigint, step bigint, timestamp timestamp, mae double, extra string")


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path / "runs")
    S.write_runs(spark.createDataFrame([(*r, float(i), 10 + i) for i, r in enumerate(RUNS)], "dataset string, strategy string, model string, mae double, n_windows bigint"), root)
    S.write_runs(windows(spark, [(*r, f'e,"{k % 2}"', k, k, STAMP, 0.1 * k if k else None, "gone") for r in RUNS for k in range(5)]).repartition(7), root, "window_metrics")
    return root


def test_what_is_written_is_read(spark, store):
    got = S.read_runs(spark, store).orderBy("mae").collect()
    assert [(r.dataset, r.strategy, r.model) for r in got] == RUNS and [r.n_windows for r in got] == list(range(10, 18)) and got[0].rmse is None
    w = S.read_runs(spark, store, "window_metrics")
    assert w.count() == 40 and "extra" not in w.columns and w.where("mae is null").count() == 8
    one = w.where("dataset = 'wti' and strategy = 'no_retrain' and model = 'rf' and step = 3").first()
    assert (one.entity_id, one.timestamp, one.mae, one.mape) == ('e,"1"', STAMP, 0.1 * 3, None)
    assert w.rdd.getNumPartitions() == 8
    assert S.read_runs(spark, store, "drift_log").count() == 0 and S.read_runs(spark, store + "-none").count() == 0
    with pytest.raises(Exception, match="no table"):
        S.read_runs(spark, store, "nonsense").count()


def test_names_choose_folders(spark, store):
    r = S._Reader(store, "metrics", {"dataset": ["wti"], "model": ["rf", "lstm"]})
    assert [p.key() for p in r.partitions()] == [("wti", "fixed_retrain", "rf"), ("wti", "no_retrain", "rf")]
    found = S.read_runs(spark, store, dataset="wti", model=["rf", "x"])
    assert found.where("mae > 6.5").count() == 1 and found.count() == 2 and found.rdd.getNumPartitions() == 2
    assert S.single_run(spark, store, "brent", "fixed_retrain", "rf").collect()[0].mae == 3.0
    assert S.single_run(spark, store, "brent", "x", "rf").count() == 0
    whole = S.read_runs(spark, store)
    assert [whole.where("dataset = 'wti'").count(), whole.count(), whole.where("model = 'rf'").count()] == [4, 8, 4]
    with pytest.raises(ValueError, match="no names"):
        S.read_runs(spark, store, entity="a")


def test_commits_are_whole(spark, store, tmp_path):
    new = spark.createDataFrame([("brent", "no_retrain", "naive", 99.0)], "dataset string, strategy string, model string, mae double")
    with pytest.raises(Exception, match="there already"):
        S.write_runs(new, store, overwrite=False)
    S.write_runs(new, store)
    assert S.single_run(spark, store, "brent", "no_retrain", "naive").first().mae == 99.0 and S.read_runs(spark, store).count() == 8  # others stay
    bad = spark.createDataFrame([("ok", "s", "m", 1.0), ("../up", "s", "m", 1.0)], new.schema)
    with pytest.raises(Exception, match="names of a run"):
        S.write_runs(bad, store)
    split = spark.createDataFrame([("d", "s", "m", 1.0), ("d", "s", "m", 2.0)], new.schema).repartition(2)
    with pytest.raises(Exception, match="several pieces"):
        split.write.format("runs").mode("append").save(store)
    names = {p.name for p in (tmp_path / "runs").iterdir()}
    assert names == {"brent", "wti"}  # neither half of a failed job nor staging is left
    writer = S._Writer(store, "metrics", ["dataset", "strategy", "model", "mae"], True)
    lost, kept = writer.write(iter([("a", "b", "c", 1.0)])), writer.write(iter([("a", "b", "c", 2.0)]))  # an attempt that was lost, and its repetition
    writer.commit([kept])
    assert lost.files and json.loads((tmp_path / "runs/a/b/c/metrics.json").read_text()) == {"mae": 2.0} and not list((tmp_path / "runs").glob("_staging*"))


def test_questions(spark, store):
    drift = [(*RUNS[0], STAMP, k, "e", k % 2 == 0) for k in range(5)]
    S.write_runs(spark.createDataFrame(drift, "dataset string, strategy string, model string, timestamp timestamp, step bigint, entity_id string, drift_detected boolean"), store, "drift_log")
    fits = [(*RUNS[0], 0, "initial_training"), (*RUNS[0], 3, "drift_score_0.7"), (*RUNS[0], 4, None)]
    S.write_runs(spark.createDataFrame(fits, "dataset string, strategy string, model string, step bigint, reason string"), store, "retraining_log")
    counts = {(r.dataset, r.strategy, r.model): (r.drift_count, r.retrain_entries, r.retrain_count) for r in S.log_counts(spark, store).collect()}
    assert counts.pop(RUNS[0]) == (3, 3, 2) and set(counts.values()) == {(0, 0, 0)} and len(counts) == 7
    line = S.timeline(spark, store, "wti").collect()
    assert len(line) == 20 and [r.run for r in line[:5]] == ["fixed_retrain_naive"] * 5 and {r.strategy for r in line} == {"fixed_retrain", "no_retrain"}


def test_an_experiment_is_stored(spark, tmp_path):
    rows = [("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 24 + (40 if i > 150 else 0))) for i in range(300)]
    series = spark.createDataFrame(rows, "entity_id string, pos bigint, timestamp timestamp, target double")
    c = experiment.Config("toy", "naive", "adaptive_retrain", Layout(48, 12, 12), detector="cusum", detector_params={"threshold": 60.0, "drift": 2.0}, policy={"kind": "drift_triggered", "gap": 1, "consecutive": 1, "threshold": 0.1, "decay": 0.5})
    out, root = experiment.run(series, c), str(tmp_path)
    named = lambda df: df.withColumns({"dataset": F.lit("toy"), "strategy": F.lit("adaptive_retrain"), "model": F.lit("naive")})
    S.write_runs(named(out["overall"]), root)
    for t in ("window_metrics", "drift_log", "retraining_log"):
        S.write_runs(named(out[t]), root, t)
    count = S.log_counts(spark, root).first()
    assert count.drift_count == out["drift_log"].where("drift_detected").count() > 0 and count.retrain_entries == out["retraining_log"].count() > 0
    assert S.timeline(spark, root, "toy").count() == out["window_metrics"].count()
