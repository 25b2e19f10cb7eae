"""Compression of vectors to codes of bytes: product codebooks learned by Lloyd's rounds over bound-ordered heaps (Heap Lloyd).

Components become integers; a vector is cut into equal parts, and each part position has a codebook of its own. The first assignment compares
each part with every entry and keeps its slack: the distance to the second nearest entry (lower bound of all others) less that to its own
(upper bound). A block of vectors has one heap for each part position and entry, keyed by slack plus the entry's drift so far. When entries move, an
entry's cumulative drift grows by its own move and the largest move of the others; only parts whose key is not above it can have changed
entry. They are popped and compared with every entry exactly; the others are not touched, and a heap whose root is safe isn't even opened.

All distances are exact integers: float64 products where they stay below 2^53, int64 otherwise. Bounds are float64 with a margin, keys are
stored as float32 rounded down, so rounding can only cause one more exact comparison.

Scale: a block is one row of a table in the shared folder, which is written anew each round, so a lost executor repeats one block's work. Blocks
report what their moves change in the sums of the entries; a task adds its blocks up, and parts * entries * (length + 1) numbers reach the driver.
No row is dealt by a key but in the totals by label, which are added up before the shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_arrow, materialize, release

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
#: Components in a block at most (one vector makes a block of its own if it has more), and vectors, whose numbers are two bytes.
BLOCK, BLOCK_ROWS = 1 << 20, 1 << 14
#: A table of totals by label is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
STATE = "heap_key binary, heap_row binary, starts binary, entry binary, values binary, width int, n int, delta binary, rescanned bigint"


@dataclass
class Coded:
    """rows: id, label, code and error of each kept vector; codebooks[part, entry, position]; rescanned: parts compared again in each later assignment."""

    rows: DataFrame
    codebooks: np.ndarray
    rescanned: list[int]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c (float64 where all are below 2^53, int64 otherwise)."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2.0**53:
        x, c = x.astype(float), c.astype(float)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    out = np.empty((len(x), len(c)), np.int64)
    for j, e in enumerate(c.astype(np.int64)):
        gap = x.astype(np.int64) - e
        out[:, j] = (gap * gap).sum(1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower index) and its slack, rounded down."""
    d = distances(x, c)
    own = d.argmin(1)
    first = np.sqrt(d[np.arange(len(d)), own].astype(float))
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float)) if d.shape[1] > 1 else np.full(len(d), np.inf)
    return own, np.where(np.isinf(second), np.inf, second - first - 1e-9 * (second + first + 1))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Heaps:
    """The heaps of one block and one part position: entry e's are key[starts[e]:starts[e + 1]], in heap order."""

    def __init__(self, key: np.ndarray, row: np.ndarray, starts: np.ndarray) -> None:
        self.key, self.row, self.starts, self.open = key, row, starts, {}

    @classmethod
    def build(cls, own: np.ndarray, key: np.ndarray, entries: int) -> Heaps:
        """From all parts at once: sorted runs, which are heaps."""
        at = np.lexsort((key, own))
        return cls(key[at], at.astype(np.uint16), np.searchsorted(own[at], np.arange(entries + 1)).astype(np.int32))

    def of(self, e: int) -> list[tuple[float, int]]:
        if e not in self.open:
            s = slice(self.starts[e], self.starts[e + 1])
            self.open[e] = list(zip(self.key[s].tolist(), self.row[s].tolist(), strict=True))
        return self.open[e]

    def pop_violated(self, drifted: np.ndarray) -> list[int]:
        """Removes and returns the rows whose key the cumulative drift of their entry has reached."""
        out = []
        for e, limit in enumerate(drifted.tolist()):
            s, t = self.starts[e], self.starts[e + 1]
            if s < t and self.key[s] <= limit:
                heap = self.of(e)
                while heap and heap[0][0] <= limit:
                    out.append(heapq.heappop(heap)[1])
        return out

    def push(self, e: int, key: float, row: int) -> None:
        heapq.heappush(self.of(e), (key, row))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.open:
            return self.key, self.row, self.starts
        keys, rows, starts = [], [], [0]
        for e in range(len(self.starts) - 1):
            if e in self.open:
                keys.append(np.array([k for k, _ in self.open[e]], np.float32))
                rows.append(np.array([r for _, r in self.open[e]], np.uint16))
            else:
                s = slice(self.starts[e], self.starts[e + 1])
                keys.append(self.key[s])
                rows.append(self.row[s])
            starts.append(starts[-1] + len(keys[-1]))
        return np.concatenate(keys), np.concatenate(rows), np.array(starts, np.int32)


def _sums(x: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """For each entry, the sum of the rows assigned to it and, last, their number."""
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    order = np.argsort(own, kind="stable")
    found, first = np.unique(own[order], return_index=True)
    if len(found):
        out[found, :-1] = np.add.reduceat(x[order].astype(np.int64), first, axis=0)
        out[:, -1] = np.bincount(own, minlength=entries)
    return out


def _cut(values: np.ndarray, parts: int) -> np.ndarray:
    """n x D as parts x n x D / parts."""
    return values.reshape(len(values), parts, -1).transpose(1, 0, 2)


def _state(values, entry, heaps, delta, rescanned) -> list[pa.Array]:
    """A block's row, without what it carries."""
    key, row, starts = (np.concatenate(x) for x in zip(*heaps, strict=True))
    blob = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return [
        blob(key), blob(row), blob(starts), blob(entry), blob(values), pa.array([values.dtype.itemsize], pa.int32()), pa.array([len(values)], pa.int32()), blob(delta), pa.array([rescanned], pa.int64())
    ]


def _integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long lists, in the narrowest signed type that holds them."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale).reshape(len(vectors), -1)
    top = np.abs(x).max(initial=0)
    if 4 * x.shape[1] * top * top >= 2.0**63:
        raise ValueError(f"a component of {top / scale:g} makes squared distances of more than 63 bits")
    for t in (np.int16, np.int32):
        if top < np.iinfo(t).max:
            return x.astype(t)
    return x.astype(np.int64)


def _first(kept: DataFrame, books: np.ndarray, scale: int, carried: list[str]) -> DataFrame:
    """Blocks with every part assigned by comparison with all entries."""
    parts, entries, size = books.shape
    types = dict(kept.dtypes)
    schema = ", ".join([f"`{c}` array<{types[c]}>" for c in carried] + [STATE])
    step = max(1, min(BLOCK_ROWS, BLOCK // (parts * size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                values = _integers(batch.column(len(carried)), scale)
                entry, heaps, delta = np.empty((parts, len(values)), np.uint8 if entries <= 256 else np.uint16), [], []
                for p, x in enumerate(_cut(values, parts)):
                    own, slack = nearest(x, books[p])
                    entry[p] = own
                    heaps.append(Heaps.build(own, _down(slack), entries).arrays())
                    delta.append(_sums(x, own, entries))
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(i)])) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*lists, *_state(values, entry, heaps, np.array(delta), 0)], [*carried, *[c.split()[0] for c in STATE.split(", ")]])

    return arrow(kept, run, schema)


def _load(row: dict, parts: int, entries: int) -> tuple[np.ndarray, np.ndarray, list[Heaps]]:
    n = row["n"]
    values = np.frombuffer(row["values"], {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]).reshape(n, -1)
    entry = np.frombuffer(row["entry"], np.uint8 if entries <= 256 else np.uint16).reshape(parts, n).copy()
    key, at = np.frombuffer(row["heap_key"], np.float32).reshape(parts, n), np.frombuffer(row["heap_row"], np.uint16).reshape(parts, n)
    starts = np.frombuffer(row["starts"], np.int32).reshape(parts, entries + 1)
    return values, entry, [Heaps(key[p], at[p], starts[p]) for p in range(parts)]


def _next(blocks: DataFrame, books: np.ndarray, drifted: np.ndarray, carried: list[str]) -> DataFrame:
    """Blocks with the parts reassigned whose bounds the drift has violated; delta has what that changed."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                row = {c: batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("n", "values", "width", "entry", "heap_key", "heap_row", "starts")}
                values, entry, heaps = _load(row, parts, entries)
                delta, again = np.zeros((parts, entries, size + 1), np.int64), 0
                for p, x in enumerate(_cut(values, parts)):
                    popped = np.array(heaps[p].pop_violated(drifted[p]), np.int64)
                    if not len(popped):
                        continue
                    again += len(popped)
                    own, slack = nearest(x[popped], books[p])
                    for e, k, r in zip(own.tolist(), _down(slack + drifted[p][own]).tolist(), popped.tolist(), strict=True):
                        heaps[p].push(e, k, r)
                    delta[p] = _sums(x[popped], own, entries) - _sums(x[popped], entry[p][popped].astype(np.int64), entries)
                    entry[p][popped] = own
                lists = [batch.column(batch.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*lists, *_state(values, entry, [h.arrays() for h in heaps], delta, again)], batch.schema.names)

    return arrow(blocks, run, ", ".join(f"`{n}` {t}" for n, t in blocks.dtypes))


def _changes(blocks: DataFrame, shape: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The blocks' deltas added up: in a task first, so that one row a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, again = np.zeros(shape, np.int64), 0
        for batch in batches:
            for d, r in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(d.as_py(), np.int64).reshape(shape)
                again += r
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([again], pa.int64())], ["delta", "rescanned"])

    total, again = np.zeros(shape, np.int64), 0
    for r in arrow(blocks.select("delta", "rescanned"), run, "delta binary, rescanned bigint").toLocalIterator():
        total += np.frombuffer(r.delta, np.int64).reshape(shape)
        again += r.rescanned
    return total, again


def encode(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS
) -> Coded:
    """Codes of the vectors and the codebooks that they refer to.

    Vectors that are null or hold null or non-finite components are dropped. Of the rest those are kept whose length is the commonest one (ties to the longer)
    among the lengths above 0 that divide into `parts`; others have no equal parts and are dropped too. The codebooks start from the first `entries` kept rows by id
    (nulls last, ties by vector), all of them if there are fewer. Repeated rows are rows like any other. Other columns of the table,
    whatever they are called, take no part. Components so large that a squared distance passes 63 bits are an error. An empty table gives no rows and no codebooks.
    """
    if entries > 1 << 16 or entries < 1:
        raise ValueError("there can be 1 to 65536 entries")
    v = F.col(vector).cast("array<double>")
    kept = rows.select(F.col(id_col), F.col(label), v.alias("vector")).where(
        F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    )
    common = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    types = dict(kept.dtypes)
    schema = f"`{id_col}` {types[id_col]}, `{label}` {types[label]}, code string, error bigint"
    if common is None:
        return Coded(rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64), [])
    kept = kept.where(F.size("vector") == common.d)
    start = kept.select(id_col, "vector").orderBy(F.asc_nulls_last(id_col), "vector").limit(entries).collect()  # `entries` rows
    books = _cut(_integers(pa.array([r.vector for r in start]), scale).astype(np.int64), parts).copy()
    n_books, carried = books.shape[1], [id_col, label]

    blocks = materialize(_first(kept, books, scale, carried), "lloyd-first")
    sums, drifted, rescanned = np.zeros((parts, n_books, books.shape[2] + 1), np.int64), np.zeros((parts, n_books)), []
    for k in range(rounds):
        change, again = _changes(blocks, sums.shape)
        sums += change
        if k:
            rescanned.append(again)
        used = sums[..., -1] > 0
        moved = np.where(used[..., None], np.floor_divide(sums[..., :-1], np.maximum(sums[..., -1:], 1)), books)
        gap = np.sqrt(((moved - books).astype(float) ** 2).sum(-1)) * (1 + 1e-9)
        top = np.sort(gap, axis=1)[:, ::-1]
        others = np.where((gap == top[:, :1]) & (np.arange(n_books) == gap.argmax(1)[:, None]), top[:, 1:2] if n_books > 1 else 0.0, top[:, :1])
        drifted, books = (drifted + gap + others) * (1 + 1e-9), moved
        before, blocks = blocks, materialize(_next(blocks, books, drifted, carried), "lloyd-round")
        release(before)
    if rounds:
        rescanned.append(_changes(blocks, sums.shape)[1])

    digits = 2 if n_books <= 256 else 4

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("n", "values", "width", "entry", "heap_key", "heap_row", "starts")}
                values, entry, _ = _load(row, parts, n_books)
                error = np.zeros(len(values), np.int64)
                for p, x in enumerate(_cut(values, parts)):
                    gap = x.astype(np.int64) - books[p][entry[p]]
                    error += (gap * gap).sum(1)
                codes = np.ascontiguousarray(entry.T.astype(">u1" if digits == 2 else ">u2")).tobytes().hex()
                wide = digits * parts
                out.append(pa.RecordBatch.from_arrays([*[batch.column(j)[i].values for j in range(2)], pa.array([codes[s : s + wide] for s in range(0, len(codes), wide)], pa.string()), pa.array(error)], [id_col, label, "code", "error"]))
            return pa.concat_batches(out)

        return each

    return Coded(map_arrow(blocks, make, schema), books, rescanned)


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components as decimal integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(rows: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256 of each kept vector."""
    found = encode(rows, **options)
    coded = materialize(found.rows, "lloyd-codes")
    id_col, label = coded.columns[:2]
    totals = materialize(coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")), "lloyd-labels")
    small = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    return coded.join(small, F.col(label).eqNullSafe(F.col("__label"))).select(id_col, "code", "error", "label_error", F.lit(codebooks_sha256(found.codebooks)).alias("codebooks_sha256"))
