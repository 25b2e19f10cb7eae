"""Distances to a reference that is sorted once equal those of drift.py, which copies it for each window."""

import numpy as np
import pytest

from tidewatch.operators import drift, sliding


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(11)
    ref, cur = [], []
    for e, ties in (("smooth", None), ("ties", 0), ("few", 1)):
        r = rng.normal(50, 10, 3 if e == "few" else 200)
        r = np.round(r, ties) if ties is not None else r
        ref += [(e, float(v)) for v in r] + [(e, None), (e, float("nan"))]
        for k in range(12):
            c = rng.normal(50 + 8 * (k % 4), 1 + 5 * (k % 3), 24)
            c = np.round(c, ties) if ties is not None else c
            if k == 10:
                c = r[:10]  # values of the reference itself
            if k == 11:
                c = np.array([r.max() + 5, r.min() - 5, r.max(), r.min()])
            cur += [(e, k, float(v)) for v in c] + [(e, k, None)]
        cur += [(e, 50, None), (e, 51, 49.5)]
    cur += [("no reference", 0, 1.0), ("no reference", 0, 2.0)]
    return spark.createDataFrame(ref, "entity_id string, x double"), spark.createDataFrame(cur, "entity_id string, window_id bigint, x double")


def copied(ref, cur):
    ids = cur.select("entity_id", "window_id").distinct()
    return ids.join(ref, "entity_id").selectExpr("entity_id", "window_id", "'ref' side", "x").unionByName(cur.selectExpr("entity_id", "window_id", "'cur' side", "x"))


@pytest.mark.parametrize("name", ["ks", "wasserstein", "psi"])
def test_distances(spark, sides, name):
    got = {(r.entity_id, r.window_id): r for r in getattr(sliding, name)(*sides).collect()}
    want = {(r.entity_id, r.window_id): r for r in getattr(drift, name)(copied(*sides), "entity_id", "window_id").collect()}
    assert len(got) == 43 and set(want) <= set(got)
    for k, r in got.items():
        if k[0] == "no reference" or k[1] == 50:
            assert r[2] == 0
        else:
            for a, b in zip(r[2:], want[k][2:], strict=True):
                assert a == b if isinstance(b, str | int) else abs(a - b) < 1e-9 * (1 + abs(b)), (k, r, want[k])


def test_the_reference_is_not_copied_for_windows(spark, sides):
    ref, cur = sides
    rows = sliding.ranked(ref, cur)
    assert rows.count() == cur.where("x is not null and entity_id <> 'no reference'").count()
    plan = sliding.ks(ref, cur)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
