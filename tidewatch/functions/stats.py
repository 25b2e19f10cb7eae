"""Tail probabilities that Spark has no function for: as columns (folds in the JVM), and on single values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def kolmogorov_tail(x: float) -> float:
    """P(K > x) of the limiting distribution."""
    if x < 1e-3:
        return 1.0
    if x < 1.18:  # the series that converges fast for small x
        t = math.exp(-(math.pi**2) / (8 * x * x))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * (t + t**9 + t**25 + t**49)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 30))))


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate((a, b))
    return float(np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max())


def ks_p_value(d: float, n: int, m: int, exact_upto: int = 4_000_000) -> float:
    """Two-sided p of the two-sample statistic: exact by counting lattice paths for small n * m, else asymptotic."""
    if n * m > exact_upto:
        return kolmogorov_tail(d * math.sqrt(n * m / (n + m)))
    if n < m:
        n, m = m, n
    limit = d - 1e-12
    # row[i]: share of paths to (i, s - i) that stayed where |i/n - j/m| < d; one diagonal s of cells at a time
    at = np.arange(n + 1)
    row = np.zeros(n + 1)
    row[0] = 1.0
    for s in range(1, n + m + 1):
        j = s - at
        from_left = np.append(0.0, row[:-1]) * at / s
        row = np.where((j >= 0) & (j <= m) & (np.abs(at / n - j / m) < limit), from_left + row * np.maximum(j, 0) / s, 0.0)
    return float(min(1.0, max(0.0, 1 - row[n])))


@lru_cache(maxsize=4096)
def ks_critical(n: int, m: int, alpha: float) -> float:
    """The least value of the two-sample statistic with p < alpha (2 if there is none). Values are multiples of 1 / (n m), so it is found by halving."""
    low, high = 0, n * m + 1
    while low < high:
        k = (low + high) // 2
        if k > n * m or ks_p_value(k / (n * m), n, m) < alpha:
            high = k
        else:
            low = k + 1
    return low / (n * m) if low <= n * m else 2.0


def ks_significant(d: float, n: int, m: int, alpha: float) -> bool:
    """Whether p < alpha, by a critical value that is kept for each pair of sizes."""
    return d > ks_critical(n, m, alpha) - 0.5 / (n * m)


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """The exact two-sided p in the JVM: a fold over the diagonals of the n by m lattice of the shares of paths that stay where |i/n - j/m| < d.

    Work is n (n + m) for each row, so distinct (d, n, m) should be asked once.
    """
    long, short = F.greatest(n, m).cast("int"), F.least(n, m).cast("int")
    at = F.sequence(F.lit(0), long)
    first = F.transform(at, lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def diagonal(row: Column, s: Column) -> Column:
        def cell(i: Column) -> Column:
            j = s - i
            inside = (j >= 0) & (j <= short) & (F.abs(i / long - j / short) < d - 1e-12)
            return F.when(inside, F.when(i > 0, F.get(row, i - 1) * i / s).otherwise(0.0) + F.get(row, i) * j / s).otherwise(0.0)

        return F.transform(at, cell)

    stayed = F.aggregate(F.sequence(F.lit(1), long + short), first, diagonal)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.get(stayed, long)))


def normal_p(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal Z, in the JVM: the power series of erf up to 3, beyond it the continued fraction of erfc. Null and NaN stay without p."""
    x = F.abs(z) / math.sqrt(2)
    terms = F.sequence(F.lit(0), F.lit(60))
    # the k-th term is the one before it times -x^2 / k
    series = F.aggregate(
        terms, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("power")),
        lambda s, k: F.struct((s["sum"] + s["power"] * x / (2 * k + 1)).alias("sum"), (-s["power"] * x * x / (k + 1)).alias("power")), lambda s: s["sum"],
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, k: 1 + k / (2 * x * x) / f)
    tail = F.exp(-x * x) / (x * math.sqrt(math.pi) * fraction)
    return F.when(z.isNull() | F.isnan(z), F.lit(None)).when(F.abs(z) <= 3, F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * series)).otherwise(tail)


def signed_rank_p(w: Column, n: Column) -> Column:
    """Two-sided p of the smaller signed-rank sum w of n untied differences, exactly: a fold over the ranks counts the subsets of each sum. Work is n^3 / 2."""
    at = F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int"))
    none = F.transform(at, lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    shares = F.aggregate(F.sequence(F.lit(1), n.cast("int")), none, lambda c, k: F.transform(at, lambda i: (F.get(c, i) + F.when(i >= k, F.get(c, i - k)).otherwise(0.0)) / 2))
    return F.least(F.lit(1.0), 2 * F.aggregate(F.slice(shares, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda a, v: a + v))
