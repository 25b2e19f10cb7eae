"""Learners against refits, finite differences and exhaustive search; learned models under every policy."""

import datetime as dt
import itertools

import numpy as np
import pytest

from tidewatch.operators import adaptive, drift, experiment, learned, learners, models
from tidewatch.operators import rolling as R

RULES = {"kind": "drift_triggered", "gap": 1, "consecutive": 1, "threshold": 0.1, "decay": 0.5}
AT = R.Layout(48, 12, 12)


def series(spark, **values):
    rows = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "entity_id string, pos bigint, timestamp timestamp, target double")


def shifted(spark, n=300):
    rng = np.random.default_rng(5)
    wave = 5 * np.sin(np.arange(n) / 4)
    return series(spark, a=np.where(np.arange(n) < n // 2, 10, 60) + wave * np.where(np.arange(n) < n // 2, 1, 6) + rng.normal(0, 1, n), b=20 + wave[: n // 2] + rng.normal(0, 1, n // 2))


def refit(x, y, alpha):
    mean, sd = np.nan_to_num(np.nanmean(x, axis=0)), np.nan_to_num(np.nanstd(x, axis=0))
    sd = np.where(sd < 1e-10, 1, sd)
    z, ok = np.nan_to_num((x - mean) / sd), ~np.isnan(y)
    z, y = z[ok], y[ok]
    return mean, sd, y.mean(), np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))


@pytest.mark.parametrize("level", [0.0, 1e5])
def test_moved_ridge_equals_a_refit(level):
    rng = np.random.default_rng(1)
    x = rng.normal(level, 5, (2000, 9))
    x[:, 2] = level + 3  # a constant
    x[:, 5] = x[:, 1] * 2
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.nan_to_num(x)[:, 0] * 2 + rng.normal(0, 1, 2000)
    y[::17] = np.nan
    ridge = learners.RollingRidge(x, y, 1.0)
    for start in [*range(0, 1500, 3), 100, 1700]:  # small moves, and jumps back and on
        got, (mean, sd, centre, w) = ridge.fit(start, start + 120), refit(x[start : start + 120], y[start : start + 120], 1.0)
        ahead = x[start + 120 : start + 140]
        assert np.allclose(got.predict(ahead), np.nan_to_num((ahead - mean) / sd) @ w + centre, rtol=1e-9, atol=1e-6)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    net, x, y = learners.Network(2, 4, 2, rng), rng.normal(0, 1, (2, 5, 6)), rng.normal(0, 1, (2, 5))
    drop = [(rng.random((1, 5, 6, 4)) < 0.8) / 0.8]
    loss = lambda: ((net.forward(x, drop)[0] - y) ** 2).sum()
    out, memory = net.forward(x, drop)
    grad = net.backward(2 * (out - y), memory)
    for k, p in net.p.items():
        for _ in range(8):
            i = tuple(rng.integers(0, n) for n in p.shape)
            old, p[i] = p[i], p[i] + 1e-6
            up = loss()
            p[i] = old - 1e-6
            down, p[i] = loss(), old
            assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-5 * (1 + abs(grad[k][i]))


def test_network_beats_naive_and_does_not_depend_on_its_neighbours():
    t = np.arange(400)
    y = 50 + 10 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(3).normal(0, 0.3, 400)
    x = np.array([[y[i - 12 + j] if i + j >= 12 else np.nan for j in range(12)] for i in t])
    net = learners.RecurrentLearner(x, y, epochs=20)
    both = net.fit_all([(0, 300), (24, 324)])
    error = np.abs(both[0].predict(x[300:]) - y[300:]).mean()
    assert error < 0.5 * np.abs(y[299] - y[300:]).mean() and error < np.abs(np.diff(y[299:])).mean()
    assert np.allclose(net.fit(24, 324).predict(x[330:340]), both[1].predict(x[330:340]))
    assert np.isfinite(learners.RecurrentLearner(x * np.nan, y * np.nan, epochs=1).fit(0, 300).predict(x[:3])).all()


def brute_split(x, y, w, least):
    """The best fall of the squared error over all features and values."""
    sse = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() if w[m].sum() else 0.0
    whole, best = sse(np.ones(len(y), bool)), 0.0
    for j in range(x.shape[1]):
        for v in np.unique(x[:, j])[:-1]:
            m = x[:, j] <= v
            if min(w[m].sum(), w[~m].sum()) >= least:
                best = max(best, whole - sse(m) - sse(~m))
    return best


def test_splits_equal_exhaustive_search():
    rng = np.random.default_rng(4)
    for n, least in itertools.product((2, 7, 60), (1, 3)):
        x, y, w = rng.integers(0, 12, (n, 4)).astype(float), rng.normal(0, 5, n), rng.integers(0, 3, n).astype(float)
        w[:2] = 1
        b, rows = learners.Binned(x), np.flatnonzero(w > 0)
        gain, f, cut = learners.best_split(b, rows, y, w, least)
        want = brute_split(x[rows], y[rows], w[rows], least)
        assert np.isclose(max(gain, 0), want)
        if want > 1e-9:
            m = x[rows, f] <= b.cuts[f][cut]
            sse = lambda s: (w[rows][s] * (y[rows][s] - np.average(y[rows][s], weights=w[rows][s])) ** 2).sum()  # noqa: B023, E731
            assert np.isclose(sse(np.ones(len(rows), bool)) - sse(m) - sse(~m), want)


def test_trees_grow_best_leaf_first_within_their_limits():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, 3))
    y = np.where(x[:, 0] > 0, 10, 0) + x[:, 1]
    b, w = learners.Binned(x, 32), np.ones(500)
    for depth, leaves in ((1, 9), (9, 2), (3, 8), (9, 5)):
        t = learners.grow(b, y, w, depth, leaves, 1)
        assert (t.feature < 0).sum() <= min(leaves, 1 << depth) and t.feature[0] == 0
    errors = [((learners.grow(b, y, w, 9, k, 1).predict(x) - y) ** 2).sum() for k in (1, 2, 4, 16)]
    assert errors == sorted(errors, reverse=True) and errors[3] < errors[0] / 20
    one = learners.TreeLearner(x[:1], y[:1], "gbt", 3).fit(0, 1)
    assert np.allclose(one.predict(x[:4]), y[0]) and learners.TreeLearner(x, y * np.nan).fit(0, 9).predict(x[:2]).tolist() == [0, 0]


@pytest.mark.parametrize(("name", "params"), [("ridge_features", {"n_lags": 3}), ("rf", {"n_estimators": 3, "max_depth": 3}), ("lgbm", {"n_estimators": 3, "max_depth": 3}), ("lstm", {"epochs": 1, "hidden": 4, "steps": 6})])
def test_forecasts_do_not_depend_on_blocks(spark, monkeypatch, name, params):
    s = shifted(spark)
    want = R.test_rows(s, AT).count()
    out = {}
    for block, share in ((2048, 64), (24, 2)):
        monkeypatch.setattr(learned, "SHARE", share)
        framed, make = models.prepared(s, name, **params)
        for policy in ("no_retrain", "fixed_retrain", "each"):
            served = models._served(s, AT, policy, 3)
            got = learned.forecasts(framed, AT, served, learned.fits(framed, AT, served, make, block)).toPandas().sort_values(["entity_id", "window_id", "h"])
            assert len(got) == want and got.y_pred.notna().all()
            out[block, policy] = got.y_pred.to_numpy()
    for policy in ("no_retrain", "fixed_retrain", "each"):
        assert np.allclose(out[2048, policy], out[24, policy], rtol=1e-6)
    assert not np.allclose(out[24, "no_retrain"], out[24, "each"])


def test_ridge_follows_its_own_residuals(spark):
    """The loop equals one that refits from scratch at each retrain, and decides otherwise than that of naive forecasts."""
    s = shifted(spark)
    framed, make = models.prepared(s, "ridge_features", n_lags=3)
    got = adaptive.loop(framed, AT, detector="cusum", policy=RULES, make=make, threshold=60.0, drift=2.0)
    pdf, rows = framed.toPandas(), got.toPandas()
    for name, g in pdf.groupby("entity_id"):
        g, policy = g.sort_values("pos"), drift.create_policy(**RULES)
        x, y, state = learned.matrix(g.x), g.target.to_numpy(float), policy.start()
        says = lambda m, a, b: np.nan_to_num((x[a:b] - m[0]) / m[1]) @ m[3] + m[2]  # noqa: B023, E731
        model, v, errors = refit(x[:48], y[:48], 1.0), 0, []
        found = drift.create_detector("cusum", threshold=60.0, drift=2.0).fit(y[:48] - says(model, 0, 48))
        mine = rows[rows.entity_id == name].sort_values("window_id")
        assert len(mine) == (len(y) - 60) // 12 + 1
        for k, r in enumerate(mine.itertuples()):
            a = k * 12 + 48
            pred = says(model, a, a + 12)
            assert np.allclose(r.y_pred, pred, atol=1e-6) and r.v_window == v
            seen = found.detect(y[a : a + 12] - pred)
            go, _ = policy.decide(state, k, seen.drift, seen.score, float(np.mean(errors[-5:])) if errors else 0.0)
            errors.append(float(np.abs(y[a : a + 12] - pred).mean()))
            assert bool(go) == r.retrain
            if go:
                v, model = k, refit(x[k * 12 : k * 12 + 48], y[k * 12 : k * 12 + 48], 1.0)
    naive = adaptive.loop(s, AT, "naive", "cusum", RULES, threshold=60.0, drift=2.0).toPandas()
    both = rows.merge(naive, on=["entity_id", "window_id"])
    assert rows.retrain.any() and (both.retrain_x != both.retrain_y).any()
    p = adaptive.predictions(s, AT, got)
    assert p.count() == R.test_rows(s, AT).count() and p.where("y_pred is null").count() == 0


@pytest.mark.parametrize(("name", "params"), [("rf", {"n_estimators": 3, "max_depth": 3}), ("lgbm", {"n_estimators": 3, "max_depth": 3}), ("lstm", {"epochs": 2, "hidden": 4, "steps": 6})])
def test_every_learned_model_has_a_loop(spark, name, params):
    s = shifted(spark)
    own = models.get_model(name)(s, AT, policy="adaptive_retrain", **params).toPandas()
    assert len(own) == R.test_rows(s, AT).count() and own.y_pred.notna().all()
    assert list(own.columns) == ["entity_id", "window_id", "h", "timestamp", "y_true", "y_pred"]


def test_an_experiment_runs_the_models_own_loop(spark):
    s = shifted(spark)
    c = experiment.Config(model="tsmixer", strategy="adaptive_retrain", layout=AT, detector="cusum", detector_params={"threshold": 60.0, "drift": 2.0}, policy=RULES)
    framed, make = models.prepared(s, "ridge_features")
    loop = adaptive.loop(framed, AT, detector="cusum", policy=RULES, make=make, threshold=60.0, drift=2.0)
    log = experiment.run(s, c)["drift_log"].toPandas()
    assert log.retrain_triggered.sum() == loop.where("retrain").count() > 0


def test_gaps_and_short_series(spark):
    y = [None if i % 9 == 0 else float(i % 24) for i in range(150)]
    s = series(spark, gaps=y, short=[1.0] * 20, none=[None] * 100)
    for name, params in (("ridge_features", {"n_lags": 3}), ("rf", {"n_estimators": 2}), ("lgbm", {"n_estimators": 2}), ("lstm", {"epochs": 1, "hidden": 4})):
        got = models.get_model(name)(s, AT, policy="fixed_retrain", **params).toPandas()
        assert len(got) == R.test_rows(s, AT).count() and got.y_pred.notna().all() and "short" not in set(got.entity_id)
    assert models.get_model("lstm")(s.limit(0), AT).count() == 0


def test_ridge_on_features_that_stop_moving_equals_a_refit():
    """Dense rows: the hour stays in a window for long, and what the moved sums keep of it is rounding."""
    rng, n = np.random.default_rng(8), 6000
    hour = np.repeat(np.arange(n // 200) % 24, 200)
    x = np.column_stack((hour, np.sin(2 * np.pi * hour / 24), np.cos(2 * np.pi * hour / 24), rng.normal(0, 300, (n, 4))))
    y = x[:, 3] + rng.normal(0, 5, n)
    ridge = learners.RollingRidge(x, y, 1.0)
    for start in range(0, n - 144, 24):
        got, (mean, sd, centre, w) = ridge.fit(start, start + 120), refit(x[start : start + 120], y[start : start + 120], 1.0)
        ahead = x[start + 120 : start + 144]
        assert np.allclose(got.predict(ahead), np.nan_to_num((ahead - mean) / sd) @ w + centre, rtol=1e-9, atol=1e-6)
        assert np.allclose(got.sd, sd, rtol=1e-6)


def test_inference_equals_forward():
    rng = np.random.default_rng(3)
    net, x = learners.Network(1, 8, 2, rng), rng.normal(0, 3, (600, 7))
    assert np.allclose(net.infer(x), net.forward(x[None])[0][0], rtol=0, atol=1e-13)
