"""Distribution distances as ordered sums, and detectors and policies as pure steps folded over ordered groups."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .ordered import fold


# ---- distances between two samples, by key; rows: key columns, side ('ref' or 'cur'), x ----------------------------------------


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    """Per key and distinct value: cumulated shares of both sides, next value, and sizes."""
    clean = rows.where(F.col("x").isNotNull() & ~F.isnan("x"))
    points = clean.groupBy(*by, "x").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    w, whole = Window.partitionBy(*by).orderBy("x"), Window.partitionBy(*by)
    return points.select(
        *by, "x", F.lead("x").over(w).alias("next"), F.sum("r").over(w).alias("cr"), F.sum("c").over(w).alias("cc"), F.sum("r").over(whole).alias("nr"), F.sum("c").over(whole).alias("nc")
    )


def ks(rows: DataFrame, *by: str) -> DataFrame:
    """ks_d, ref_size and cur_size of each key; 0 where a side is empty."""
    gap = F.abs(F.try_divide(F.col("cr"), F.col("nr")) - F.try_divide(F.col("cc"), F.col("nc")))
    return _merged(rows, *by).groupBy(*by).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks_d"), F.first("nr").alias("ref_size"), F.first("nc").alias("cur_size"))


def with_ks_p(found: DataFrame) -> DataFrame:
    """Rows of ks with p, the exact two-sided p; it is computed once for each distinct distance and pair of sizes (null where a side is empty)."""
    asked = found.where("ref_size > 0 and cur_size > 0").select("ks_d", "ref_size", "cur_size").distinct()
    p = asked.withColumn("p", stats.ks_p(F.col("ks_d"), F.col("ref_size"), F.col("cur_size")))
    return found.join(p, ["ks_d", "ref_size", "cur_size"], "left").select(*found.columns, "p")


def ks_test(rows: DataFrame, *by: str) -> DataFrame:
    """ks with p."""
    return with_ks_p(ks(rows, *by))


def wasserstein(rows: DataFrame, *by: str) -> DataFrame:
    """w1, and w1 over the reference's deviation (its floor is 1e-10)."""
    area = F.abs(F.try_divide(F.col("cr"), F.col("nr")) - F.try_divide(F.col("cc"), F.col("nc"))) * (F.col("next") - F.col("x"))
    w1 = _merged(rows, *by).groupBy(*by).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("w1"))
    sd = rows.where("side = 'ref'").groupBy(*by).agg(F.stddev_pop(F.nanvl("x", F.lit(None))).alias("sd"))
    return w1.join(sd, list(by), "left").select(*by, "w1", (F.col("w1") / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-10))).alias("w1_normalised"))


def psi(rows: DataFrame, *by: str, buckets: int = 10) -> DataFrame:
    """Population stability index over quantile bins of the reference; empty bins count 1e-4.

    The last edge is moved up by 1. Values beyond the edges are in no bin, but count in the sizes.
    """
    clean = rows.where(F.col("x").isNotNull() & ~F.isnan("x"))
    steps = [k / buckets for k in range(buckets + 1)]
    edges = clean.where("side = 'ref'").groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, steps))).alias("q"))
    edges = edges.withColumn("q", F.concat(F.slice("q", 1, buckets), F.array(F.element_at("q", buckets + 1) + 1)))
    inside = lambda k: (F.col("x") >= F.col("q")[k]) & ((F.col("x") < F.col("q")[k + 1]) if k + 1 < buckets else (F.col("x") <= F.col("q")[k + 1]))
    agg = [F.count_if((F.col("side") == s) & inside(k)).alias(f"{s}{k}") for k in range(buckets) for s in ("ref", "cur")]
    sizes = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("ref", "cur")]
    counts = clean.join(edges, list(by)).groupBy(*by).agg(*agg, *sizes)
    share = lambda s, k: F.when(F.col(f"{s}{k}") == 0, 1e-4).otherwise(F.try_divide(F.col(f"{s}{k}"), F.col(f"n_{s}")))
    total = sum((share("cur", k) - share("ref", k)) * F.log(share("cur", k) / share("ref", k)) for k in range(buckets))
    value = F.when((F.col("n_ref") < 2) | (F.col("n_cur") < 2), 0.0).otherwise(total)
    category = F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.2, "moderate").otherwise("significant")
    return counts.select(*by, value.alias("psi")).withColumn("category", category)


def split_effect(rows: DataFrame, *by: str) -> DataFrame:
    """Effect size between the halves of an ordered sample (columns key, i from 0, x): |m2 - m1| over the pooled deviation."""
    n = F.count("*").over(Window.partitionBy(*by))
    half = rows.withColumn("__n", n).withColumn("__a", F.col("i") < F.expr("__n div 2"))
    m = half.groupBy(*by).agg(
        F.avg(F.when(F.col("__a"), F.col("x"))).alias("m1"), F.avg(F.when(~F.col("__a"), F.col("x"))).alias("m2"),
        F.var_samp(F.when(F.col("__a"), F.col("x"))).alias("v1"), F.var_samp(F.when(~F.col("__a"), F.col("x"))).alias("v2"),
    )
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return m.select(*by, F.when(pooled > 1e-10, F.abs(F.col("m2") - F.col("m1")) / pooled).otherwise(0.0).alias("effect"))


def histogram(rows: DataFrame, breaks: list[float], *by: str) -> DataFrame:
    """Counts by breakpoints, the last bin closed."""
    last = len(breaks) - 2
    inside = [(F.col("x") >= breaks[k]) & ((F.col("x") < breaks[k + 1]) if k < last else (F.col("x") <= breaks[k + 1])) for k in range(last + 1)]
    wide = rows.groupBy(*by).agg(*[F.count_if(c).alias(f"bin_{k}") for k, c in enumerate(inside)])
    return wide


def window_sides(series: DataFrame, history: int, forecast: int, step: int) -> DataFrame:
    """For each window, the entity's first `history` rows as reference against the window's test rows (entity_id, window_id, side, x)."""
    from .rolling import Layout, test_rows, windows

    at = Layout(history, forecast, step)
    cur = test_rows(series, at).select("entity_id", "window_id", F.lit("cur").alias("side"), F.col("y_true").alias("x"))
    ids = windows(series, at).select("entity_id", "window_id")
    ref = ids.join(series.where(F.col("pos") < history), "entity_id").select("entity_id", "window_id", F.lit("ref").alias("side"), F.col("target").alias("x"))
    return ref.unionByName(cur)


# ---- detectors -------------------------------------------------------------------------------------------------------------


@dataclass
class Result:
    drift: bool
    score: float
    p_value: float | None = None
    ref_size: int = 0
    cur_size: int = 0


def _finite(x: Iterable[float]) -> np.ndarray:
    x = np.asarray(list(x), float)
    return x[~np.isnan(x)]


class Detector:
    """fit(reference), then detect(batch) for each batch in order; history has all results."""

    name = "detector"

    def __init__(self, **params: float) -> None:
        self.params, self.history, self.score = params, [], 0.0

    def fit(self, ref: Iterable[float]) -> Detector:
        self.ref = _finite(ref)
        self.history, self.score = [], 0.0
        self.start()
        return self

    def start(self) -> None: ...

    def step(self, x: np.ndarray) -> Result:
        raise NotImplementedError

    def observe(self, batch: Iterable[float]) -> Result:
        """detect() for long series: the result isn't kept."""
        r = self.step(_finite(batch))
        self.score = r.score
        return r

    def detect(self, batch: Iterable[float]) -> Result:
        r = self.observe(batch)
        self.history.append(r)
        return r

    def reset(self) -> None:
        self.fit(self.ref)

    def get(self, key: str, default: float) -> float:
        return self.params.get(key, default)


class SplitWindow(Detector):
    """Effect size between the halves of a bounded window; drift drops the older half."""

    name = "adwin"

    def start(self) -> None:
        self.window: deque[float] = deque(self.ref, maxlen=int(self.get("max_window", 1000)))

    def step(self, x: np.ndarray) -> Result:
        self.window.extend(x)
        least, n = int(self.get("min_window", 30)), len(self.window)
        if n < 2 * least:
            return Result(False, 0.0, 1.0, n // 2, n - n // 2)
        w = np.array(self.window)
        a, b = w[: n // 2], w[n // 2 :]
        pooled = math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
        d = abs(b.mean() - a.mean()) / pooled if pooled > 1e-10 else 0.0
        drift = d > self.get("effect_size", 0.5)
        if drift:
            for _ in range(n // 2):
                self.window.popleft()
        return Result(drift, d, 1 - min(1.0, d / 2), n // 2, n - n // 2)


class PageHinkley(Detector):
    name = "page_hinkley"

    def start(self) -> None:
        self.mean, self.c, self.n = float(self.ref.mean()) if len(self.ref) else 0.0, 0.0, len(self.ref)

    def step(self, x: np.ndarray) -> Result:
        a, delta, limit = self.get("alpha", 0.005), self.get("delta", 0.005), self.get("threshold", 50.0)
        drift = False
        for v in x:
            self.n += 1
            self.c = (1 - a) * (self.c + v - self.mean - delta)
            if abs(self.c) > limit:
                drift = True
                break
        return Result(drift, abs(self.c) / max(1, self.n), None, len(self.ref), len(x))


class Cusum(Detector):
    name = "cusum"

    def start(self) -> None:
        self.mean, self.up, self.down = float(self.ref.mean()) if len(self.ref) else 0.0, 0.0, 0.0

    def step(self, x: np.ndarray) -> Result:
        k, limit = self.get("drift", 0.1), self.get("threshold", 5.0)
        for v in x:
            self.up, self.down = max(0.0, self.up + v - self.mean - k), max(0.0, self.down - (v - self.mean) - k)
            if self.up > limit or self.down > limit:
                score = max(self.up, self.down)
                self.up = self.down = 0.0
                return Result(True, score, None, len(self.ref), len(x))
        return Result(False, max(self.up, self.down), None, len(self.ref), len(x))


def _effect(a: np.ndarray, b: np.ndarray) -> float:
    pooled = math.sqrt((a.var() + b.var()) / 2)
    return abs(b.mean() - a.mean()) / pooled if pooled > 1e-10 else 0.0


class ResidualKS(Detector):
    """p < alpha is decided by a critical value; with p_values=1 the p itself is computed, too."""

    name = "residual_ks"

    def start(self) -> None:
        size = int(self.get("window", 100))
        self.old: deque[float] = deque(self.ref, maxlen=size)
        self.new: deque[float] = deque(maxlen=size)

    def step(self, x: np.ndarray) -> Result:
        self.new.extend(x)
        a, b, least = np.array(self.old), np.array(self.new), self.get("min_ref", 30)
        if min(len(a), len(b)) < least:
            return Result(False, 0.0, 1.0, len(a), len(b))
        d = stats.ks_statistic(a, b)
        p = stats.ks_p_value(d, len(a), len(b)) if self.get("p_values", 0) else None
        drift = stats.ks_significant(d, len(a), len(b), self.get("alpha", 0.05)) or _effect(a, b) > self.get("effect_size", 0.5)
        if drift:
            self.old.clear()
            self.old.extend(b)
            self.new.clear()
        return Result(drift, d, p, len(a), len(b))


class Wasserstein(Detector):
    name = "wasserstein"

    def start(self) -> None:
        self.old, self.new = self.ref, deque(maxlen=int(self.get("window", 100)))

    def step(self, x: np.ndarray) -> Result:
        self.new.extend(x)
        b = np.array(self.new)
        if len(b) < self.get("min_window", 30) or not len(self.old):
            return Result(False, 0.0, None, len(self.old), len(b))
        both = np.sort(np.concatenate((self.old, b)))
        a_, b_ = np.sort(self.old), np.sort(b)
        gap = np.abs(np.searchsorted(a_, both[:-1], "right") / len(a_) - np.searchsorted(b_, both[:-1], "right") / len(b_))
        w1 = float((gap * np.diff(both)).sum())
        score = w1 / max(float(self.old.std()), 1e-10) if self.get("normalise", 1) else w1
        drift = score > self.get("threshold", 0.1)
        if drift:
            self.old = b
            self.new.clear()
        return Result(drift, score, None, len(a_), len(b))


class KSTest(Detector):
    """p < alpha is decided by a critical value; with p_values=1 the p itself is computed, too."""

    name = "ks_test"

    def start(self) -> None:
        self.old = list(self.ref)
        self.window: deque[float] = deque(self.ref, maxlen=int(self.get("window", 200)))

    def step(self, x: np.ndarray) -> Result:
        self.window.extend(x)
        a, b = np.array(self.old), np.array(self.window)
        if len(b) < 50 or not len(a):
            return Result(False, 0.0, 1.0, len(a), len(b))
        d = stats.ks_statistic(a, b)
        p = stats.ks_p_value(d, len(a), len(b)) if self.get("p_values", 0) else None
        drift = stats.ks_significant(d, len(a), len(b), self.get("alpha", 0.05)) or _effect(a, b) > self.get("effect_size", 0.5)
        if not drift and len(x):
            self.old = [*self.old[1:], float(x[-1])]
        return Result(drift, d, p, len(a), len(b))


class PSI(Detector):
    name = "psi"

    def start(self) -> None:
        if len(self.ref) < self.get("min_ref", 100):
            raise ValueError("the reference is too small")
        self.new: deque[float] = deque(maxlen=int(self.get("window", 1000)))
        self.renew(self.ref)

    def renew(self, old: np.ndarray) -> None:
        """Another reference: its tenths, and its shares of them."""
        self.old, self.edges = old, np.quantile(old, np.linspace(0, 1, 11))
        self.edges[-1] += 1
        self.shares = self.share(old)

    def share(self, v: np.ndarray) -> np.ndarray:
        """Shares of the bins, each closed below, the last one on both sides."""
        k = np.searchsorted(self.edges, v, "right") - 1
        k[v == self.edges[-1]] = 9
        return np.bincount(k[(k >= 0) & (k < 10)], minlength=10) / len(v)

    def step(self, x: np.ndarray) -> Result:
        self.new.extend(x)
        b = np.array(self.new)
        if len(b) < 2:
            return Result(False, 0.0, None, len(self.old), len(b))
        e, a = (np.where(c == 0, 1e-4, c) for c in (self.shares, self.share(b)))
        score = float(((a - e) * np.log(a / e)).sum())
        drift = score > self.get("threshold", 0.2)
        n = len(self.old)
        if drift:
            self.renew(b)
            self.new.clear()
        return Result(drift, score, None, n, len(b))


DETECTORS: dict[str, Callable[..., Detector]] = {d.name: d for d in (SplitWindow, PageHinkley, Cusum, ResidualKS, Wasserstein, KSTest, PSI)}


def create_detector(kind: str, **params: float) -> Detector:
    key = kind.lower().replace("-", "_")
    if key not in DETECTORS:
        raise ValueError(f"unknown detector {kind!r}; there are {', '.join(DETECTORS)}")
    return DETECTORS[key](**params)


def detect_windows(predictions: DataFrame, reference: DataFrame, kind: str = "ks_test", on: str = "residual", **params: float) -> DataFrame:
    """entity_id, window_id, drift_detected, drift_score: a detector for each entity, fed its windows in order.

    reference: entity_id, x, and pos where its order matters. An entity's detector is sequential, so one task folds one entity; entities run side by side.
    The task holds the reference, the detector's own windows and a batch of rows.
    """
    x = F.col("y_true") - F.col("y_pred") if on == "residual" else F.col("y_true")
    rows = predictions.select("entity_id", "window_id", F.col("h").cast("bigint").alias("h"), x.cast("double").alias("x"))
    place = F.col("pos").cast("bigint") if "pos" in reference.columns else F.lit(0).cast("bigint")
    ref = reference.select("entity_id", F.lit(-1).cast("bigint").alias("window_id"), place.alias("h"), F.col("x").cast("double").alias("x"))

    def each(name: object, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, at, held = None, -1, []

        def close() -> list[tuple]:
            """The window whose rows have all been seen; the one numbered -1 is the reference."""
            nonlocal d
            batch = np.concatenate(held) if held else np.empty(0)
            if at < 0:
                d = create_detector(kind, **params).fit(batch)
                return []
            r = d.observe(batch)
            return [(name, at, bool(r.drift), float(r.score))]

        for part in parts:
            ids, values, out = part.window_id.to_numpy(), part.x.to_numpy(float), []
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if ids[a] != at:
                    out += close()
                    at, held = int(ids[a]), []
                held.append(values[a:b])
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(close(), columns=columns)

    columns = ["entity_id", "window_id", "drift_detected", "drift_score"]
    return fold(rows.unionByName(ref), "entity_id", ("window_id", "h"), each, "entity_id string, window_id bigint, drift_detected boolean, drift_score double")


# ---- retraining policies ---------------------------------------------------------------------------------------------------


@dataclass
class State:
    last: int = -1
    scores: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    count: float = 0.0
    budget: float = 4.0
    baseline: float | None = None


@dataclass(frozen=True)
class Policy:
    """decide(state, step, drift, score, error) -> (retrain, reason); a retrain moves state.last."""

    kind: str = "no_retraining"
    interval: int = 1
    gap: int = 5
    consecutive: int = 2
    threshold: float = 0.5
    decay: float = 0.5
    budget: float = 4.0
    window: int = 10
    relative: float = 0.1
    exceed: int = 2

    def start(self) -> State:
        return State(budget=self.budget)

    def decide(self, s: State, step: int, drift: bool, score: float, error: float) -> tuple[bool, str]:
        if score > 0:
            s.scores = [*s.scores, score][-100:]
        if error > 0:
            s.errors = [*s.errors, error][-100:]
        go, reason = getattr(self, f"_{self.kind}")(s, step, drift)
        if go:
            s.last = step
        return go, reason

    def _cooling(self, s: State, step: int, gap: int | None = None) -> bool:
        return step - s.last < (self.gap if gap is None else gap)

    def _no_retraining(self, s: State, step: int, drift: bool) -> tuple[bool, str]:
        return (True, "initial_training") if step == 0 and s.last < 0 else (False, "no_retraining")

    def _fixed_schedule(self, s: State, step: int, drift: bool) -> tuple[bool, str]:
        if self._cooling(s, step, min(self.gap, 1)):
            return False, "cooldown"
        return (True, f"scheduled_every_{self.interval}") if step % self.interval == 0 else (False, "not_scheduled")

    def _drift_triggered(self, s: State, step: int, drift: bool) -> tuple[bool, str]:
        if self._cooling(s, step):
            return False, "cooldown"
        s.count = s.count + 1 if drift else max(0.0, s.count - self.decay)
        last = s.scores[-1] if s.scores else 0.0
        if last > self.threshold and s.count >= self.consecutive:
            s.count = 0.0
            return True, f"drift_score_{last:.3f}"
        return False, "no_drift"

    def _budget_aware(self, s: State, step: int, drift: bool) -> tuple[bool, str]:
        if self._cooling(s, step):
            return False, "cooldown"
        if s.budget < 1:
            return False, "budget_exhausted"
        if not drift:
            return False, "no_drift"
        s.budget -= 1
        return True, f"budget_left_{s.budget:.0f}"

    def _error_threshold_based(self, s: State, step: int, drift: bool) -> tuple[bool, str]:
        if s.baseline is None and len(s.errors) >= self.window:
            s.baseline = float(np.mean(s.errors[: self.window]))
        limit = s.baseline * (1 + self.relative) if s.baseline is not None else self.relative
        if self._cooling(s, step):
            return False, "cooldown"
        over = sum(e > limit for e in s.errors[-self.window :])
        if over >= self.exceed:
            s.errors = []
            return True, f"errors_over_{limit:.3f}"
        return False, "errors_normal"


ALIASES = {"none": "no_retraining", "fixed": "fixed_schedule", "drift": "drift_triggered", "budget": "budget_aware", "error_threshold": "error_threshold_based"}
KINDS = ("no_retraining", "fixed_schedule", "drift_triggered", "budget_aware", "error_threshold_based")


def create_policy(kind: str, **params) -> Policy:
    kind = ALIASES.get(kind, kind)
    if kind not in KINDS:
        raise ValueError(f"unknown policy: {kind}")
    return Policy(kind, **params)


def policy_trace(observed: DataFrame, policy: Policy, scope: str = "entity") -> DataFrame:
    """Rows (entity_id, step, drift_detected, drift_score, error) with retrain, reason and total_retrains, in the order of steps.

    scope `entity` folds each entity by itself; `shared` is one sequence over all entities, in one task, as its meaning demands.
    """
    rows = observed.select("entity_id", "step", "drift_detected", "drift_score", "error")

    def each(name: object, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, total, first = policy.start(), 0, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if first is None:
                    first = int(r.step) if scope == "entity" else 0
                go, reason = policy.decide(s, int(r.step) - first, bool(r.drift_detected), float(r.drift_score), float(r.error))
                total += go
                out.append((r.entity_id, int(r.step), bool(go), reason, total))
            yield pd.DataFrame(out, columns=["entity_id", "step", "retrain", "reason", "total_retrains"])

    rows = rows.withColumn("key", F.col("entity_id") if scope == "entity" else F.lit("all"))
    return fold(rows, "key", ("step",), each, "entity_id string, step bigint, retrain boolean, reason string, total_retrains bigint")


def retraining_statistics(log: DataFrame) -> DataFrame:
    """Per entity, of log rows (entity_id, step, timestamp, retrain, drift_detected): totals, rate, and hours between retrains."""
    gap = (F.unix_timestamp("timestamp") - F.lag(F.unix_timestamp("timestamp")).over(Window.partitionBy("entity_id").orderBy("step"))) / 3600.0
    gaps = log.where("retrain").withColumn("gap", gap).groupBy("entity_id").agg(F.avg("gap").alias("mean_hours"), F.percentile("gap", F.lit(0.5)).alias("median_hours"))
    totals = log.groupBy("entity_id").agg(
        F.count_if("retrain").alias("total_retrains"), F.count_if(F.col("retrain") & F.col("drift_detected")).alias("drift_triggered"), F.count("*").alias("steps")
    )
    return totals.join(gaps, "entity_id", "left").withColumn("retrain_rate", F.try_divide(F.col("total_retrains"), F.col("steps")))
