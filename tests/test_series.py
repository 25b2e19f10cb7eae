"""Series operators: hand-made cases, invariants, and queries against their SQL."""

import dataclasses
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewatch.functions import stats
from tidewatch.operators import adaptive, compare, drift, experiment, inject, models
from tidewatch.operators import rolling as R
from tidewatch.sources import series as src
from tidewatch.streaming import online

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(str(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize(
    "name",
    ["rolling_features", "ewm_features", "entity_ref_features", "naive_rolling_metrics", "shared_scope_metrics", "ks_score", "psi_score", "cusum", "drift_triggered_trace", "inject_seasonal_phase_shift", "false_positive", "adaptive_vs_fixed", "adaptive_loop", "adaptive_loop_metrics", "adaptive_policy_metrics", "all_runs", "all_features", "drift_benchmark", "fill_backward_fill", "detection_delay"],
)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(con.execute(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def _series(spark, **entities):
    r = [(k, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(v)) for k, vs in entities.items() for i, v in enumerate(vs)]
    return src.with_position(spark.createDataFrame(r, "entity_id string, timestamp timestamp, target double"))


def test_window_counts_at_the_edges(spark):
    s = _series(spark, a=range(11), b=range(12), c=range(16))
    found = {r.entity_id: r["count"] for r in R.windows(s, R.Layout(8, 4, 4)).groupBy("entity_id").count().collect()}
    assert found == {"b": 1, "c": 2}


def test_row_order_and_partitions_change_nothing(spark):
    s = src.events_series(spark, SF)
    at = R.Layout(48, 12, 12)
    a = R.predictions(s, at).toPandas()
    b = R.predictions(s.repartition(7, "target"), at).toPandas()
    assert rows(a) == rows(b)


def test_distances_of_shifted_samples(spark):
    r = [("k", s, float(x)) for s, xs in (("ref", (1, 2, 3, 4)), ("cur", (3, 4, 5, 6))) for x in xs]
    df = spark.createDataFrame(r, "k string, side string, x double")
    assert drift.ks(df, "k").first().ks_d == 0.5
    assert drift.wasserstein(df, "k").first().w1 == pytest.approx(2.0)


def test_ks_p_value_counts_paths():
    # all orders of 3 + 3 values: D = 1 for 2 of the 20, D >= 2/3 for 12
    assert stats.ks_p_value(1.0, 3, 3) == pytest.approx(2 / 20)
    assert stats.ks_p_value(2 / 3, 3, 3) == pytest.approx(12 / 20)
    assert stats.kolmogorov_tail(1.36) == pytest.approx(0.0494, abs=5e-4)


def test_drift_policy_reset_and_decay():
    p = drift.create_policy("drift", gap=1, consecutive=2, decay=0.5)
    s = p.start()
    out = [p.decide(s, i, f, 0.9, 0.0)[0] for i, f in enumerate([True, True, False, True, True])]
    assert out == [False, True, False, False, True]
    q = drift.create_policy("drift", gap=3, consecutive=2)
    s = q.start()
    assert [i for i in range(12) if q.decide(s, i, True, 0.9, 0.0)[0]] == [3, 7, 11]


def test_error_threshold_policy():
    p = drift.create_policy("error_threshold", gap=11)  # past the first ten errors, which make the baseline
    s = p.start()
    fired = [i for i, e in enumerate([1.0] * 11 + [1.2] * 2) if p.decide(s, i, False, 0.0, e)[0]]
    assert fired == [12]


def test_unknown_names_raise(spark):
    for f in (lambda: drift.create_detector("ddm"), lambda: drift.create_policy("x"), lambda: models.get_model("x"), lambda: src.get_dataset(spark, "x"), lambda: inject.Drift("x")):
        with pytest.raises(ValueError):
            f()
    assert models.is_model_available("tsmixer") and models.resolve("tsmixer") == "ridge_features"


@pytest.mark.parametrize("kind", sorted(drift.DETECTORS))
def test_detectors_see_a_shift_and_not_a_constant(kind):
    rng = np.random.default_rng(1)
    d = drift.create_detector(kind).fit(rng.normal(0, 1, 200))
    assert any(d.detect(rng.normal(8, 1, 50)).drift for _ in range(8))
    flat = drift.create_detector(kind).fit(np.ones(200))
    assert not any(flat.detect(np.ones(50)).drift for _ in range(3))


def test_delay_and_false_positives(spark):
    t = spark.createDataFrame([("k", 10), ("k", 50)], "k string, step bigint")
    f = spark.createDataFrame([("k", 12), ("k", 30), ("k", 49)], "k string, step bigint")
    r = compare.detection_delay(t, f, "k").first()
    assert (r.n_true, r.n_detected, r.mean_delay_steps) == (2, 1, 2.0)
    assert compare.false_positives(t, f, 100, "k", window=5).first().false_positives == 1


def test_ridge_learns_a_line(spark):
    s = _series(spark, a=[i * 0.5 + math.sin(i / 4) for i in range(300)])
    p = models.get_model("ridge_features")(s, R.Layout(200, 24, 24)).toPandas()
    assert (p.y_true - p.y_pred).abs().mean() < 5


@pytest.mark.parametrize(("query", "size"), [("random_forest_metrics", (100, 10, 1024)), ("boosted_trees_metrics", (100, 5, 31))])
def test_tree_queries_fit_models_of_the_published_size(spark, monkeypatch, query, size):
    made, prepared = [], models.prepared

    def small(*args, **params):
        framed, make = prepared(*args, **params)
        one = make(np.zeros((1, 1)), np.zeros(1), 0)
        made.append((one.n, one.depth, one.leaves))
        return prepared(*args, **params | {"n_estimators": 2, "max_depth": 2})

    monkeypatch.setattr(models, "prepared", small)
    assert __spark_entry__.queries()[query](spark, SF).count() > 0
    assert made == [size]


def test_bootstrap_query_takes_all_resamples(spark, monkeypatch):
    seen, run = [], compare.bootstrap
    monkeypatch.setattr(compare, "bootstrap", lambda pairs, n=1000, *a: seen.append(n) or run(pairs, n, *a))
    assert __spark_entry__.queries()["bootstrap"](spark, SF).count() > 0
    assert seen == [1000]


def test_seeds_reach_the_forest_and_others_run_once(spark, monkeypatch):
    s = _series(spark, a=[i % 17 + math.sin(i) * 5 for i in range(150)])
    grow = models.trees
    monkeypatch.setattr(models, "trees", lambda *a, **kw: grow(*a, n_estimators=3, max_depth=3, **kw))
    c = experiment.Config(model="rf", strategy="no_retrain", layout=R.Layout(96, 12, 12))
    forest = {r.metric: r for r in experiment.multi_seed(s, c, (1, 2)).collect()}
    assert forest["mae"].n == 2 and forest["mae"].std > 0
    naive = {r.metric: r for r in experiment.multi_seed(s, dataclasses.replace(c, model="naive"), (1, 2)).collect()}
    assert naive["mae"].n == 1 and naive["mae"].std == 0


def test_streaming_watch_equals_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 1, 160), rng.normal(6, 1, 80)))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "entity_id string, pos bigint, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.watch(stream, batch=20, history=100, kind="cusum").writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("watched").orderBy("step").toPandas()
    d = drift.create_detector("cusum").fit(x[:100])
    assert list(got.drift_detected) == [d.detect(x[i : i + 20]).drift for i in range(100, 240, 20)]


def test_trees_with_many_entities_overlapping_windows_and_policies(spark):
    at = R.Layout(48, 12, 6)
    series = _series(spark, **{f"e{i:02}": np.arange(72) % 7 + i for i in range(40)})
    want = R.test_rows(series, at).count()
    first = {}
    for kind in ("rf", "gbt"):
        for policy in ("no_retrain", "fixed_retrain"):
            got = models.trees(series, at, kind, policy, every=1, n_estimators=2, max_depth=3).toPandas()
            assert len(got) == want and got.y_pred.notna().all()
            first[policy] = got.sort_values(["entity_id", "window_id", "h"]).y_pred.to_numpy()
        assert not np.allclose(first["no_retrain"], first["fixed_retrain"])  # a refit from the second window on


def test_adaptive_loop_retrains_on_a_shift(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=72 * 4)
    y[144:] += 30
    series = _series(spark, calm=rng.normal(size=72 * 4), shifted=y)
    at = R.Layout(48, 12, 12)
    policy = {"kind": "drift_triggered", "gap": 1, "consecutive": 1, "threshold": 0.5, "decay": 0.5}
    got = adaptive.loop(series, at, "naive", "cusum", policy, threshold=150.0, drift=3.0).toPandas().sort_values("window_id")
    calm, shifted = (got[got.entity_id == k] for k in ("calm", "shifted"))
    assert not calm.retrain.any() and (calm.v_window == 0).all()
    assert shifted[shifted.retrain].window_id.min() == (144 - 48) // 12 and shifted.v_window.max() >= 8
    p = adaptive.predictions(series, at, adaptive.loop(series, at, "naive", "cusum", policy, threshold=150.0, drift=3.0)).toPandas()
    late = p[(p.entity_id == "shifted") & (p.window_id >= 15)]
    assert len(p) == R.test_rows(series, at).count() and (late.y_true - late.y_pred).abs().mean() < 5
    shared = adaptive.loop(series, at, "seasonal_naive", "page_hinkley", policy, "shared", m=12).toPandas()
    assert len(shared) == len(got) and set(shared[shared.entity_id == "calm"].v_entity) == {"calm"}
    assert adaptive.loop(series.limit(5), at).count() == 0


def _shifted(spark):
    rng = np.random.default_rng(5)
    return _series(spark, a=np.concatenate([rng.normal(10, 1, 150), rng.normal(40, 1, 150)]), b=rng.normal(20, 1, 200))


RULES = {"kind": "drift_triggered", "gap": 1, "consecutive": 1, "threshold": 0.1, "decay": 0.5}


def test_run_table_agrees_with_predictions_of_each_policy(spark):
    series, at = _shifted(spark), R.Layout(48, 12, 6)  # overlapping windows
    decided = {m: adaptive.loop(series, at, m, "cusum", RULES, threshold=100.0, drift=2.0) for m in ("naive", "seasonal_naive")}
    got = {(r.dataset, r.strategy, r.model): r for r in adaptive.run_table(series, at, decided, every=4).collect()}
    assert len(got) == 12
    for (entity, policy, model), r in got.items():
        p = models.get_model(model)(series, at, policy=policy, every=4, **({"decided": decided[model]} if policy == "adaptive_retrain" else {})).where(f"entity_id = '{entity}'").toPandas()
        assert math.isclose(r.mae, (p.y_true - p.y_pred).abs().mean(), rel_tol=1e-9) and r.n_windows == p.window_id.nunique()
    a, n = got["a", "adaptive_retrain", "naive"], got["a", "no_retrain", "naive"]
    assert n.retrain_total == 1 < a.retrain_total and a.mae < n.mae  # the shift is found, and refitting pays


@pytest.mark.parametrize("model", ["naive", "ridge_features"])
def test_logs_of_an_experiment_follow_its_strategy(spark, model):
    series = _shifted(spark)
    total = {}
    for strategy in experiment.STRATEGIES:
        c = experiment.Config(model=model, strategy=strategy, layout=R.Layout(48, 12, 12), every=5, detector="cusum", detector_params={"threshold": 100.0, "drift": 2.0}, policy=RULES)
        out = experiment.run(series, c)
        log = out["drift_log"].toPandas().sort_values(["entity_id", "step"])
        total[strategy] = log.retrain_triggered.sum()
        assert len(out["retraining_log"].toPandas()) == total[strategy] and out["predictions"].count() == 12 * len(log)
        if strategy == "fixed_retrain":
            at = log.groupby("entity_id").cumcount()
            assert (log.retrain_triggered == (at % 5 == 0)).all()
    assert total["no_retrain"] == 2 and total["adaptive_retrain"] > 0


def test_learned_models_refit_where_the_loop_says(spark):
    series, at = _shifted(spark), R.Layout(48, 12, 12)
    decided = adaptive.loop(series, at, "naive", "cusum", RULES, threshold=100.0, drift=2.0)
    error = {p: models.get_model("ridge_features")(series, at, policy=p, n_lags=3, decided=decided).where("entity_id = 'a'").selectExpr("avg(abs(y_true - y_pred))").first()[0] for p in ("no_retrain", "adaptive_retrain")}
    assert error["adaptive_retrain"] < error["no_retrain"]


def test_extended_metrics_without_a_key_cross_the_seams(spark):
    from tidewatch.functions import metrics as M

    p = R.predictions(_shifted(spark), R.Layout(48, 12, 12))
    a, b = M.extended(p).first(), M.extended(p.drop("step")).first()
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True))


def test_means_behind_a_season_are_not_joined_by_entity_alone(spark):
    """seasonal_fallback_metrics: a row names the windows that it lies in."""
    s = R.predictions(events_of(spark, 400), R.Layout(20, 4, 8), "seasonal_naive", m=30)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ">=" in line]
    p, y = s.toPandas(), events_of(spark, 400).orderBy("pos").toPandas().target
    for r in p.itertuples():
        at = r.window_id * 8 + 20 - 30 + r.h
        assert r.y_pred == pytest.approx(y[r.window_id * 8 : r.window_id * 8 + 20].mean() if r.h < 10 else y[at])


def events_of(spark, n):
    return spark.range(n).select(F.lit("a").alias("entity_id"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), (F.col("id") * 37 % 101).cast("double").alias("target"), F.col("id").alias("pos"))


def test_detectors_and_loops_hold_a_batch_and_not_an_entity(spark):
    s, at = events_of(spark, 900), R.Layout(120, 24, 24)
    s = s.unionByName(s.withColumn("entity_id", F.lit("b")).withColumn("target", F.col("target") + F.col("pos")))
    p, ref = R.predictions(s, at), s.where("pos < 120").select("entity_id", "pos", F.col("target").alias("x"))
    trace = drift.detect_windows(p, ref, "cusum").selectExpr("entity_id", "window_id as step", "drift_detected", "drift_score", "drift_score as error")
    found = [drift.detect_windows(p, ref, k, on="target") for k in ("psi", "adwin", "wasserstein")] + [drift.policy_trace(trace, drift.create_policy("drift"))]
    found += [adaptive.loop(s, at, m, "cusum", None, scope, threshold=100.0, drift=2.0) for m in ("naive", "seasonal_naive") for scope in ("entity", "shared")]
    for f in found:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan  # a fold of groups is given whole entities
    whole = [f.toPandas() for f in found]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for f, w in zip(found, whole, strict=True):
            keys = list(w.columns[:2])
            assert len(w) and f.toPandas().sort_values(keys, ignore_index=True).equals(w.sort_values(keys, ignore_index=True))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
