"""Detection on streams with typed state: rows out of order, late rows and gaps have a defined result, and a restart goes on from the checkpoint.

An entity's rows are taken in the order of their positions. A row that is early waits in a list state; one whose position has been passed is late: it is
counted, never used. A gap is waited for until the watermark has passed the waiting rows by `patience`; then a timer closes it, and the positions that never came
are left out. State is bounded by the detector's windows, the batch and what waits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.drift import Detector, State, create_detector, create_policy

OUT = "entity_id string, step bigint, drift_detected boolean, drift_score double, retrain boolean, reason string, late bigint"
#: What a loop has come to: the next position, batches done, rows that came late, the detector's and the policy's numbers and lists by name.
LOOP = "next bigint, step bigint, late bigint, fitted boolean, numbers map<string,double>, lists map<string,array<double>>"
WAITING = "pos bigint, x double, at bigint"
_POLICY = ("last", "count", "budget", "baseline")


def dump(d: Detector | None, s: State) -> tuple[dict[str, float], dict[str, list[float]]]:
    """The numbers and lists that a detector and a policy's state consist of, by name."""
    numbers = {f"policy.{k}": float(getattr(s, k)) for k in _POLICY if getattr(s, k) is not None}
    lists = {"policy.scores": list(map(float, s.scores)), "policy.errors": list(map(float, s.errors))}
    for k, v in vars(d).items() if d is not None else ():
        if k in ("params", "history"):
            continue
        if isinstance(v, deque | list | np.ndarray):
            lists[k] = list(map(float, v))
        else:
            numbers[k] = float(v)
    return numbers, lists


def restore(kind: str, params: dict, numbers: dict[str, float], lists: dict[str, list[float]], s: State) -> Detector:
    """A detector as it was dumped; the policy's state is filled in."""
    for k in _POLICY:
        if f"policy.{k}" in numbers:
            setattr(s, k, int(numbers[f"policy.{k}"]) if k == "last" else numbers[f"policy.{k}"])
    s.scores, s.errors = list(lists["policy.scores"]), list(lists["policy.errors"])
    d = create_detector(kind, **params)
    if "ref" not in lists:
        return d
    d.fit(lists["ref"])
    for k, v in lists.items():
        if hasattr(d, k):
            now = getattr(d, k)
            setattr(d, k, deque(v, maxlen=now.maxlen) if isinstance(now, deque) else np.array(v) if isinstance(now, np.ndarray) else list(v))
    for k, v in numbers.items():
        if hasattr(d, k):
            setattr(d, k, type(getattr(d, k))(v))
    return d


class Watcher(StatefulProcessor):
    def __init__(self, batch: int, history: int, kind: str, policy: dict, params: dict, patience: int) -> None:
        self.batch, self.least, self.kind, self.policy, self.params, self.patience = batch, history, kind, policy, params, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = handle.getValueState("loop", LOOP)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(p), None if x is None or pd.isna(x) else float(x), int(a)) for f in rows for p, x, a in zip(f.pos, f.x, f.at_ms, strict=True)]
        yield self._run(key, came, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...

    def _run(self, key, came: list[tuple], passed: int | None) -> pd.DataFrame:
        """Takes in rows; with `passed`, a watermark, gaps before rows older than it by patience are closed."""
        rules = create_policy(**self.policy)
        memory, out = rules.start(), []
        if self.loop.exists():
            nxt, step, late, fitted, numbers, lists = self.loop.get()
            detector = restore(self.kind, self.params, dict(numbers), {k: list(v) for k, v in lists.items()}, memory)
        else:
            nxt, step, late, fitted, detector = 0, 0, 0, False, create_detector(self.kind, **self.params)
        held: dict[int, tuple] = {int(p): (x, a) for p, x, a in self.waiting.get()} if self.waiting.exists() else {}
        for p, x, a in sorted(came, key=lambda r: r[0]):
            if p < nxt or p in held:  # passed, or there already
                late += 1
            else:
                held[p] = (x, a)
        while True:
            need = self.batch if fitted else self.least
            ready, at = [], nxt
            for p in sorted(held):
                if p != at and not (passed is not None and held[p][1] + self.patience <= passed):
                    break
                ready.append(p)
                at = p + 1
                if len(ready) == need:
                    break
            if len(ready) < need:
                break
            values = [np.nan if held[p][0] is None else held[p][0] for p in ready]
            for p in ready:
                del held[p]
            nxt = ready[-1] + 1
            if not fitted:
                detector.fit(values)
                fitted = True
                continue
            r = detector.detect(values)
            detector.history.clear()
            go, reason = rules.decide(memory, step, bool(r.drift), float(r.score), 0.0)
            out.append((key[0], step, bool(r.drift), float(r.score), bool(go), reason, late))
            step += 1
        numbers, lists = dump(detector if fitted else None, memory)
        self.loop.update((nxt, step, late, fitted, numbers, lists))
        if held:
            self.waiting.put([(p, x, a) for p, (x, a) in sorted(held.items())])
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held and sorted(held) != list(range(nxt, nxt + len(held))):  # something is missing before or between the rows that wait
            due = max(a for _, a in held.values()) + self.patience
            if passed is None or due > passed:
                self.handle.registerTimer(due)
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def watch_ordered(
    residuals: DataFrame, ts: str, batch: int = 24, history: int = 120, kind: str = "ks_test", policy: dict | None = None, late: str = "0 seconds", patience_ms: int = 3_600_000, **params: float
) -> DataFrame:
    """A row (OUT) for each `batch` residuals (entity_id, pos from 0, x and an event time) of an entity, in the order of positions; the first `history` are the reference.

    late is the delay of the watermark, behind which Spark drops rows before they are seen here; patience_ms how long after it a gap is waited for. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). Nulls count as positions that came, and are not shown to the detector.
    """
    rows = residuals.withWatermark(ts, late).select("entity_id", "pos", F.col("x").cast("double").alias("x"), F.unix_millis(F.col(ts)).alias("at_ms"), ts)
    watcher = Watcher(batch, history, kind, dict(policy or {"kind": "drift_triggered", "gap": 3}), params, patience_ms)
    return rows.groupBy("entity_id").transformWithStateInPandas(watcher, OUT, "append", "eventTime")
