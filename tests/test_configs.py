"""Configuration files take effect as a whole, and what fails in a grid is a row."""

import datetime as dt
import json
import sys

import numpy as np
import pytest
import yaml

from tidewatch.operators import experiment
from tidewatch.operators.rolling import Layout

ADAPTIVE = """
dataset: {name: brent, downsample_freq: h, sample_entities: 1}
drift: {detector: cusum, detector_params: {threshold: 60.0, drift: 2.0}, enabled: true, 'on': residual}
metrics: [mae, smape]
model: {name: rf, params: {n_estimators: 2, max_depth: 3, random_state: 7}}
retraining: {policy: drift_triggered, enabled: true, min_steps_between_retrain: 1, require_consecutive: 1, drift_threshold: 0.1, decay_consecutive: true, consecutive_decay_rate: 0.25}
simulation: {forecast_horizon_hours: 12, history_window_days: 2, step_size_hours: 12}
"""


def series(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(e, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 24 + (80 if i > n // 2 else 0) + rng.normal())) for e in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, pos bigint, timestamp timestamp, target double")


def test_a_tree_becomes_a_configuration():
    c = experiment.config_of(yaml.safe_load(ADAPTIVE))
    assert (c.dataset, c.model, c.strategy, c.layout, c.seed, c.sample_entities, c.downsample, c.metrics) == ("brent", "rf", "adaptive_retrain", Layout(48, 12, 12), 7, 1, None, ("mae", "smape"))
    assert c.params == {"n_estimators": 2, "max_depth": 3} and c.policy == {"kind": "drift_triggered", "gap": 1, "consecutive": 1, "threshold": 0.1, "decay": 0.25}
    assert experiment.config_of({**yaml.safe_load(ADAPTIVE), "seed": 5}).seed == 5 and experiment.config_of(yaml.safe_load(ADAPTIVE), 6).seed == 6
    fixed = experiment.config_of({"dataset": "wti", "model": "naive", "retraining": {"policy": "fixed_schedule", "retrain_every_n_steps": 4}})
    assert (fixed.strategy, fixed.every, fixed.layout) == ("fixed_retrain", 4, experiment.LAYOUTS["wti"])
    assert experiment.config_of({"retraining": {"policy": "no_retraining"}}).strategy == "no_retrain"
    assert experiment.config_of({"model": {"name": "tsmixer", "params": {"input_len": 96, "hidden_size": 8, "alpha": 2.0}}}).params == {"alpha": 2.0}
    for bad in ({"dataset": {"name": "x", "downsample_freq": "q"}}, {"metrics": ["mase"]}):
        with pytest.raises(ValueError, match="unknown"):
            experiment.config_of(bad)


def test_all_of_it_takes_effect(spark):
    s, tree = series(spark), yaml.safe_load(ADAPTIVE)
    out = experiment.run(s, experiment.config_of(tree))
    assert out["overall"].columns == ["mae", "smape", "n_predictions"]
    names = {r.entity_id for r in out["window_metrics"].select("entity_id").distinct().collect()}
    assert len(names) == 1 and out["predictions"].count() == (300 - 60) // 12 * 12 + 12
    base = out["drift_log"].where("retrain_triggered").count()
    quiet = experiment.run(s, experiment.config_of({**tree, "drift": {**tree["drift"], "detector_params": {"threshold": 1e9}}}))["drift_log"]
    assert base > 0 == quiet.where("retrain_triggered").count()
    target = experiment.run(s, experiment.config_of({**tree, "drift": {**tree["drift"], "on": "target"}}))["drift_log"].toPandas()
    assert list(target.drift_score) != list(out["drift_log"].toPandas().drift_score)
    deep = experiment.run(s, experiment.config_of({**tree, "model": {"name": "rf", "params": {"n_estimators": 2, "max_depth": 1}}}))["overall"].first().mae
    assert deep != out["overall"].first().mae
    daily = experiment.run(s, experiment.config_of({**tree, "model": "naive", "dataset": {"name": "brent", "downsample_freq": "d"}, "simulation": {"history_window_days": 0.125, "forecast_horizon_hours": 2, "step_size_hours": 2}}))
    assert daily["predictions"].groupBy("entity_id").count().first()["count"] == 2 * ((13 - 5) // 2 + 1)


def test_failures_of_a_grid_are_rows(spark):
    s, at = series(spark), Layout(48, 12, 12)
    configs = [experiment.Config("toy", m, "no_retrain", at) for m in ("naive", "nonsense")] + [experiment.Config("absent", "naive", "no_retrain", at)]
    got = {(r.dataset, r.model): r for r in experiment.run_grid({"toy": s}, configs).collect()}
    assert got["toy", "naive"].mae > 0 and got["toy", "naive"].error is None
    assert "unknown model" in got["toy", "nonsense"].error and got["toy", "nonsense"].mae is None and "no series" in got["absent", "naive"].error
    assert experiment.run_grid({"toy": s}, configs[1:]).count() == 2 and experiment.run_grid({"toy": s}, configs[:1]).count() == 1


def test_command_line_writes_a_store(spark, tmp_path, monkeypatch):
    from tidewatch import session
    from tidewatch.sources import run_store
    from tidewatch.sources import series as sources

    tree = {**yaml.safe_load(ADAPTIVE), "dataset": {"name": "toy"}, "model": "naive"}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(tree))
    monkeypatch.setattr(session, "local", lambda *a, **k: spark)
    monkeypatch.setitem(sources.DATASETS, "toy", lambda sp, *a, **k: series(sp))
    experiment.main(["--config", str(tmp_path / "c.yaml"), "--output", str(tmp_path / "out"), "--data", "unused"])
    assert set(json.loads((tmp_path / "out/toy/adaptive_retrain/naive/metrics.json").read_text())) == {"mae", "smape", "n_predictions"}
    count = run_store.log_counts(spark, str(tmp_path / "out")).first()
    assert count.retrain_entries > 0 and run_store.timeline(spark, str(tmp_path / "out"), "toy").count() == 42
    assert "tidewatch" in sys.modules
