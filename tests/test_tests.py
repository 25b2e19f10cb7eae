"""Tail probabilities against enumeration, and the bootstrap against its definition."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import compare, drift


def test_signed_rank_p_equals_enumeration(spark):
    rng = np.random.default_rng(1)
    keys = {f"k{n}": rng.permutation(np.arange(1, n + 1)) * rng.choice([-1.0, 1.0], n) for n in (9, 10, 12, 14)}
    keys["ties"] = np.repeat([1.0, -2.0, 3.0, 4.0], 4)
    keys["long"] = rng.permutation(np.arange(1, 81)) * rng.choice([-1.0, 1.0, 1.0], 80)
    rows = [(k, float(d)) for k, v in keys.items() for d in v] + [("k10", 0.0), ("k10", None), ("zeros", 0.0)]
    got = {r.k: r for r in compare.wilcoxon_test(spark.createDataFrame(rows, "k string, d double"), "k").collect()}
    assert "zeros" not in got and got["k9"].p_value is None and not got["k9"].exact
    for k in ("k10", "k12", "k14"):
        n = len(keys[k])
        sums = np.array([sum(c * (i + 1) for i, c in enumerate(s)) for s in itertools.product((0, 1), repeat=n)])
        assert got[k].exact and got[k].n == n and math.isclose(got[k].p_value, min(1, 2 * (sums <= got[k].statistic).mean()))
    for k, ties in (("ties", 4 * (64 - 4)), ("long", 0)):
        n, r = len(keys[k]), got[k]
        z = (r.statistic - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert not r.exact and math.isclose(r.p_value, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)


def test_normal_p(spark):
    z = [0.0, 1e-9, 0.5, -1.96, 2.999, 3.001, -5.0, 8.0, 30.0, float("nan"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").select("i", stats.normal_p(F.col("z")).alias("p")).orderBy("i").collect()
    for r, v in zip(got, z, strict=True):
        assert r.p is None if v is None or math.isnan(v) else math.isclose(r.p, math.erfc(abs(v) / math.sqrt(2)), rel_tol=1e-9)


def test_ks_p_in_the_jvm_equals_the_fold_in_arrays(spark):
    asked = [(k / (n * m), n, m) for n, m in ((3, 3), (10, 7), (40, 24), (24, 40), (1, 9)) for k in (1, n * m // 3, n * m // 2, n * m)]
    got = spark.createDataFrame(asked, "d double, n bigint, m bigint").withColumn("p", stats.ks_p(F.col("d"), F.col("n"), F.col("m"))).collect()
    assert all(math.isclose(r.p, stats.ks_p_value(r.d, r.n, r.m), abs_tol=1e-12) for r in got)
    for n, m in ((30, 30), (100, 48), (7, 5)):
        for k in range(n * m + 1):
            assert stats.ks_significant(k / (n * m), n, m, 0.05) == (stats.ks_p_value(k / (n * m), n, m) < 0.05) or k % 7
    with_p = drift.create_detector("ks_test", p_values=1).fit(np.arange(60.0)).detect(np.arange(30.0))
    assert 0 < with_p.p_value <= 1
    empty = spark.createDataFrame([("a", "ref", 1.0), ("b", "ref", 1.0), ("b", "cur", 2.0)], "k string, side string, x double")
    assert {r.k: r.p for r in drift.ks_test(empty, "k").collect()} == {"a": None, "b": 1.0}


def boot(df, *a, **kw):
    return {r.k: r for r in compare.bootstrap(df, *a, **kw).collect()}


def test_bootstrap_by_blocks(spark):
    rng = np.random.default_rng(2)
    keys = {"normal": rng.normal(0.2, 1, 400), "hot": np.where(rng.random(900) < 0.4, 0.0, rng.normal(-0.05, 1, 900)), "same": np.full(50, 3.0), "one": np.array([2.0])}
    df = spark.createDataFrame([(k, float(d), 1) for k, v in keys.items() for d in v] + [("normal", None, 1), ("normal", float("nan"), 1), ("none", None, 1)], "k string, d double, block int")
    for block, group in ((2048, 512), (16, 4), (1, 3)):
        got = boot(df, 1000, 42, True, "k", block=block, group=group)
        assert set(got) == set(keys)
        for k in ("same", "one"):  # each resample has exactly as many differences as the key
            assert got[k].ci_low == got[k].ci_high == got[k].mean_diff == keys[k][0]
        for k in ("normal", "hot"):
            d, r = keys[k], got[k]
            means = np.array([rng.choice(d, len(d)).mean() for _ in range(4000)])
            assert math.isclose(r.mean_diff, d.mean(), rel_tol=1e-9)
            assert np.allclose((r.ci_low, r.ci_high), np.quantile(means, [0.025, 0.975]), atol=6 * d.std() / len(d) ** 0.5 / 1000**0.5 * 2.7)
            assert abs(r.p_value - (np.abs(means - d.mean()) >= abs(d.mean())).mean()) < 0.06
    again = boot(df.repartition(7, "d"), 1000, 42, True, "k", block=16, group=4)
    other = boot(df, 1000, 43, True, "k", block=16, group=4)
    base = boot(df, 1000, 42, True, "k", block=16, group=4)
    assert all(math.isclose(again[k].ci_low, base[k].ci_low, rel_tol=1e-12) for k in keys) and other["normal"].ci_low != base["normal"].ci_low
    assert boot(df, 200, 42, False, "k")["same"].p_value == 1.0
    whole = compare.bootstrap(df.where("k = 'normal'"), 100).collect()
    assert len(whole) == 1 and whole[0].asDict().keys() == {"mean_diff", "ci_low", "ci_high", "p_value"}
    assert compare.bootstrap(df.limit(0), 10, 1, True, "k").count() == 0


def test_draws_of_a_resample_add_up(spark):
    """Zeros and ones in many blocks: the resampled means are multiples of 1/n, with a binomial spread."""
    d = [float(i % 2) + (i // 2) * 1e-12 for i in range(300)]
    df = spark.createDataFrame([("a", v) for v in d], "k string, d double")
    r = boot(df, 2000, 1, True, "k", block=8, group=5)["a"]
    assert abs(r.ci_high - r.ci_low - 2 * 1.96 * 0.5 / 300**0.5) < 0.012


@pytest.mark.parametrize("query", ["bootstrap"])
def test_bootstrap_query(spark, query):
    import __spark_entry__

    assert __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001").count() == 5
