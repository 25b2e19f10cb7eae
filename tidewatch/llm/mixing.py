"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of (source, lang, topic). The cells' token counts are raked until their marginals over sources,
languages and topics meet the targets; a document's probability is its cell's raked weight over its observed
one, scaled so that the largest is 1, and a seeded hash of doc_id draws it. Probabilities are never clipped,
so that the expected token shares are the targets in every marginal.

Default targets favour small groups, within a bound: each group gets the gain (largest group / group) ** (1 - power) over its axis' largest
group, `GAINS` at most, a cell the product of its groups' gains, and the targets are the marginals of the cells so weighted. They can
thus be met, whatever groups occur together, by weights in which no token counts more than the product of `GAINS` (4) against any
other (up to what MAX_ROUNDS of raking leave open): the draw keeps at least a quarter of the tokens, however rare a group is. Given targets are met as they are, without a bound.
Targets that no weights meet (groups that never occur apart, say) leave a rest after MAX_ROUNDS, which is reported as a warning.

Topics are learned from all documents: clusters of hashed words, weighted by inverse document frequency; every document joins the cluster whose
centre it is closest to by cosine. Frequencies, the draws of first centres and the sums of each round are jobs over a table of the documents'
word bins; products and sums are of integers, so that centres and topics are the same whatever the batches and tasks.

Scale: the centres have a fixed size; a task adds a row a topic and bin to a round. One pass over the texts gives each document's bins and tokens, a table that
the rounds, the narrow table of topics and the draw are made from. Cells are counted with map-side combination (a source with a third of the rows adds one row a task) and the draw is made
from. The table of cells is small, but that is checked: up to `MAX_CELLS` the raking runs on the driver and the weights are
broadcast; beyond, the same loop runs over tables.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import alnum_words, arrow, blank_words, map_arrow, materialize, release, seeded

AXES = ("source", "lang", "topic")
N_TOPICS = 8
#: Bins of words; rounds of clustering; documents whose products a task makes at once.
BINS = 1 << 12
CLUSTER_ROUNDS = 10
SLICE = 512
#: Default targets weight groups by their tokens to this power: under 1, small groups gain, but at most by the factor in GAINS.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
GAINS = {"source": 2.0, "lang": 2**0.5, "topic": 2**0.5}
SEED = 11
MAX_CELLS = 500_000
TOLERANCE = 1e-10
MAX_ROUNDS = 200
#: Differences of shares from their targets that are reported.
REPORTED = 1e-3


def word_bins(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the text's words, and of each the bit length of its count."""
    # hashing each word again is faster than counting words first
    counts = np.bincount(np.fromiter(map(zlib.crc32, alnum_words(text)), np.int64) & (BINS - 1), minlength=BINS)
    at = np.flatnonzero(counts)
    return at, np.frexp(counts[at])[1].astype(np.int64)


class Part:
    """Some documents with words: a hash of each, and their bins and bit lengths end to end."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, bins: np.ndarray, tf: np.ndarray) -> None:
        self.hashes, self.sizes = np.asarray(hashes, np.int64), np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bins, self.tf = bins.astype(np.int64), tf.astype(np.int64)

    def products(self, weights: np.ndarray) -> np.ndarray:
        """A row a document, a column for each column of weights."""
        return np.stack([np.add.reduceat(self.tf * w[self.bins], self.starts) for w in weights.T], axis=1) if weights.shape[1] else np.zeros((len(self.sizes), 0), np.int64)

    def norms(self, idf: np.ndarray) -> np.ndarray:
        return np.sqrt(np.add.reduceat(self.tf * self.tf * np.rint(idf**2 * 1e6).astype(np.int64)[self.bins], self.starts) / 1e6)

    def drawn(self, idf: np.ndarray, weights: np.ndarray, seed: int) -> tuple[float, int]:
        """The document that comes first in a race, in which one far from all centres is fast; and its time (infinite: none runs)."""
        norms = self.norms(idf)
        with np.errstate(divide="ignore", invalid="ignore"):
            near = (self.products(weights) / (1e6 * norms[:, None])).max(axis=1, initial=0.0)
            far = np.where(norms > 0, np.maximum(1 - near, 0.0).round(9) ** 2, 0.0)
            mixed = (self.hashes.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            u = (((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(12)) / 2.0**52
            time = np.where(far > 0, -np.log1p(-u) / far, np.inf)
        k = int(time.argmin())
        return float(time[k]), k

    def totals(self, idf: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of the documents of unit length, in parts of 2**20, by nearest centre and bin."""
        own, norms = np.repeat(self.products(weights).argmax(axis=1), self.sizes), np.repeat(np.maximum(self.norms(idf), 1e-12), self.sizes)
        value = np.rint(self.tf * idf[self.bins] / norms * 2**20)
        return np.bincount(own * BINS + self.bins, value, weights.shape[1] * BINS).astype(np.int64).reshape(-1, BINS)


def learned(n: int, frequency: np.ndarray, first: Callable, totals: Callable, n_topics: int, seed: int) -> np.ndarray:
    """Centres times inverse document frequencies, as integers. first(idf, weights, seed) is the next centre's document (bins, tf) or None, totals(idf, weights) the sums of a round."""
    idf = np.log((1 + n) / (1 + frequency))
    weighted = lambda c: np.rint(c.T * idf[:, None] * 1e6).astype(np.int64)
    centres = np.zeros((0, BINS))
    while n and len(centres) < n_topics and (found := first(idf, weighted(centres), seed + len(centres))) is not None:
        x = np.zeros(BINS)
        x[found[0]] = found[1] * idf[found[0]]
        centres = np.vstack((centres, x / np.linalg.norm(x)))
    for _ in range(CLUSTER_ROUNDS if len(centres) else 0):
        total = totals(idf, weighted(centres)).astype(float)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        moved = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
        if np.array_equal(weighted(moved), weighted(centres)):
            break
        centres = moved
    return weighted(centres)


class Topics:
    """Cluster centres, times inverse document frequencies, as integers: a row a bin, a column a topic. Learned from documents at hand, or given."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], n_topics: int = N_TOPICS, seed: int = SEED, weights: np.ndarray | None = None) -> None:
        if weights is None:
            bins, tf = zip(*docs, strict=True) if docs else ((), ())
            part = Part([zlib.crc32(b"%d" % k) for k in range(len(docs))], [len(b) for b in bins], np.concatenate(bins), np.concatenate(tf)) if docs else None

            def first(idf: np.ndarray, near: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
                time, k = part.drawn(idf, near, seed)
                return docs[k] if time < np.inf else None

            seen = np.bincount(part.bins, minlength=BINS) if docs else np.zeros(BINS)
            weights = learned(len(docs), seen, first, part.totals if docs else None, n_topics, seed)
        self.weights = weights

    def of(self, text: str | None) -> int:
        """-1 for texts without words; of equally close centres the first."""
        return self.of_bins(*word_bins(text))

    def of_bins(self, bins: np.ndarray, tf: np.ndarray) -> int:
        if not len(bins):
            return -1
        return int((tf @ self.weights[bins]).argmax()) if self.weights.shape[1] else 0


def binned(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokens, a hash, bins (2 bytes each) and bit lengths (1 byte each) of each row, as a table."""
    keep = ["doc_id", "source", "lang", "hash"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            found = [word_bins(t) for t in texts]
            more = [
                pa.array([len(blank_words(t)) for t in texts], pa.int64()), pa.array([b.astype(np.uint16).tobytes() for b, _ in found], pa.binary()), pa.array([t.astype(np.uint8).tobytes() for _, t in found], pa.binary())
            ]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *more], [*keep, "tokens", "bins", "tf"])

        return each

    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep[:3])
    rows = docs.select("doc_id", "source", "lang", seeded("doc_id", seed=SEED).alias("hash"), "text")
    return materialize(map_arrow(rows, make, f"{columns}, hash bigint, tokens bigint, bins binary, tf binary"), "binned")


def _laid(column: pa.Array, of: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls end to end, as numbers, and how many each has."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(of)
    return values, np.diff(at) // values.itemsize


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            cut = batch.slice(lo, SLICE)
            bins, sizes = _laid(cut.column("bins"), np.uint16)
            yield Part(cut.column("hash").to_numpy(), sizes, bins, _laid(cut.column("tf"), np.uint8)[0])


def learn_topics(table: DataFrame, n_topics: int = N_TOPICS) -> Topics:
    """Topics of all rows of binned(); the driver gets a row a bin or a topic and bin."""
    rows = table.where(F.length("bins") > 0).select("hash", "bins", "tf")

    def summed(make: Callable[[Part], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for part in _parts(batches):
                total += make(part).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

        out = np.zeros(size, np.int64)
        for r in arrow(rows, run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out

    def first(idf: np.ndarray, near: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for part in _parts(batches):
                time, k = part.drawn(idf, near, seed)
                a, b = part.starts[k], part.starts[k] + part.sizes[k]
                row = (time, part.bins[a:b].tolist(), part.tf[a:b].tolist())
                if time < np.inf and (best is None or row < best):
                    best = row
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.list_(pa.int64())), pa.array([best[2]], pa.list_(pa.int64()))], ["time", "bins", "tf"])

        found = arrow(rows, run, "time double, bins array<bigint>, tf array<bigint>").orderBy("time", "bins", "tf").first()
        return (np.array(found.bins, np.int64), np.array(found.tf, np.int64)) if found else None

    def totals(idf: np.ndarray, near: np.ndarray) -> np.ndarray:
        return summed(lambda part: part.totals(idf, near), near.shape[1] * BINS).reshape(-1, BINS)

    frequency = summed(lambda part: np.bincount(part.bins, minlength=BINS), BINS)
    return Topics([], weights=learned(rows.count(), frequency, first, totals, n_topics, SEED))


def uniform(seed: int) -> Column:
    """A number in [0, 1) that the seed and doc_id decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def described(docs: DataFrame, topics, keep: list[str]) -> DataFrame:
    """The columns to keep of each row, and __topic and __tokens (runs without white space; 0 for null)."""

    def make():
        learnt = topics.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            more = [pa.array([learnt.of(t) for t in texts], pa.int32()), pa.array([len(blank_words(t)) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *more], [*keep, "__topic", "__tokens"])

        return each

    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*keep, *({"text"} - set(keep))), make, f"{columns}, __topic int, __tokens bigint")


def _narrow(table: DataFrame, topics) -> DataFrame:
    """doc_id, source, lang, tokens and topic of each row of binned(), as a table; null groups are groups of their own."""
    keep = ["doc_id", "source", "lang", "tokens"]

    def make():
        learnt = topics.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = zip(batch.column("bins").to_pylist(), batch.column("tf").to_pylist(), strict=True)
            found = pa.array([learnt.of_bins(np.frombuffer(b, np.uint16), np.frombuffer(t, np.uint8).astype(np.int64)) for b, t in pairs], pa.int32())
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, "topic"])

        return each

    columns = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)
    return materialize(map_arrow(table.select(*keep, "bins", "tf"), make, f"{columns}, topic int"), "described")


def targets(cells: pd.DataFrame, given: Mapping[str, Mapping] | None = None) -> dict[str, pd.Series]:
    """Shares of each axis' groups: the given ones, else observed shares flattened by POWERS within GAINS."""
    flat = cells["tokens"].astype(float)
    for axis in AXES:
        seen = cells.groupby(axis, dropna=False)["tokens"].transform("sum")
        flat = flat * (seen.max() / seen.clip(lower=1)).pow(1 - POWERS[axis]).clip(1.0, GAINS[axis])
    out = {}
    for axis in AXES:
        seen = cells.assign(flat=flat).groupby(axis, dropna=False)["flat"].sum()
        want = seen if not given or axis not in given else pd.Series([float(given[axis].get(None if pd.isna(k) else k, 0.0)) for k in seen.index], seen.index, float)
        out[axis] = want / want.sum() if want.sum() else want
    return out


def rake(cells: pd.DataFrame, want: Mapping[str, pd.Series]) -> np.ndarray:
    """The cells' raked token weights, with sum 1; cells without tokens keep 0."""
    w = cells["tokens"].to_numpy(float)
    w = w / w.sum() if w.sum() else w
    codes = {}
    for axis in AXES:
        index = {(None if pd.isna(k) else k): i for i, k in enumerate(want[axis].index)}
        codes[axis] = np.array([index[None if pd.isna(k) else k] for k in cells[axis]], int)
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for axis in AXES:
            goal = want[axis].to_numpy(float)
            have = np.bincount(codes[axis], w, len(goal))
            worst = max(worst, float(np.abs(have - goal).max(initial=0)))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[codes[axis]]
        if worst < TOLERANCE:
            break
    _report(worst)
    return w


def _report(worst: float) -> None:
    if worst > REPORTED:
        warnings.warn(f"raking leaves shares {worst:.2g} off their targets, which may exclude each other", stacklevel=3)


def _rake_tables(cells: DataFrame, given: Mapping[str, Mapping] | None = None) -> DataFrame:
    """rake() for more cells than the driver should hold: each round is three sums, joined back by group.

    Lineage is cut after each round; the weights of a group are summed with map-side combination.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    flat = cells.withColumn("flat", F.col("tokens").cast("double"))
    for axis in AXES:
        seen = materialize(cells.groupBy(F.col(axis).alias("h")).agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("n")), "seen")
        gain = F.least(F.pow(F.lit(seen.agg(F.max("n")).first()[0] or 1) / F.col("n"), F.lit(1 - POWERS[axis])), F.lit(GAINS[axis]))
        flat = flat.join(seen, F.col(axis).eqNullSafe(F.col("h"))).withColumn("flat", F.col("flat") * gain).drop("h", "n")
    flat = materialize(flat, "flat")
    goals = {}
    for axis in AXES:
        seen = flat.groupBy(axis).agg(F.sum("flat").alias("g"))
        if given and axis in given:
            schema = StructType([StructField("k", cells.schema[axis].dataType), StructField("g", DoubleType())])
            asked = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given[axis].items()], schema)
            seen = seen.select(axis).join(asked, F.col(axis).eqNullSafe(F.col("k")), "left").select(axis, F.coalesce("g", F.lit(0.0)).alias("g"))
        whole = seen.agg(F.sum("g")).first()[0] or 1.0
        goals[axis] = materialize(seen.select(F.col(axis).alias("k"), (F.col("g") / whole).alias("goal")), f"goal-{axis}")
    state = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for axis in AXES:
            have = state.groupBy(F.col(axis).alias("h")).agg(F.sum("w").alias("have"))
            ratio = have.join(goals[axis], F.col("h").eqNullSafe(F.col("k"))).select("h", F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("r"), F.abs(F.col("goal") - F.col("have")).alias("d"))
            ratio = materialize(ratio, "ratio")
            worst = max(worst, ratio.agg(F.max("d")).first()[0] or 0.0)
            state = state.join(ratio.select("h", "r"), F.col(axis).eqNullSafe(F.col("h"))).withColumn("w", F.col("w") * F.col("r")).drop("h", "r")
        state = materialize(state, "raked")
        if worst < TOLERANCE:
            break
    _report(worst)
    return state


def probabilities(rows: DataFrame, given: Mapping[str, Mapping] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """For each cell: source, lang, topic, tokens, weight (raked share) and p (probability of its documents)."""
    spark = rows.sparkSession
    cells = rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    if cells.limit(max_cells + 1).count() > max_cells:
        raked = _rake_tables(cells, given)
    else:
        held = cells.toPandas().sort_values(list(AXES), na_position="first", ignore_index=True)
        weights = rake(held, targets(held, given)) if len(held) else np.zeros(0)
        schema = StructType([*cells.schema.fields, StructField("w", DoubleType())])
        lists = [[None if pd.isna(v) else v for v in held[c].tolist()] for c in cells.columns]
        raked = spark.createDataFrame(list(zip(*lists, map(float, weights), strict=True)), schema)
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0))
    top = raked.agg(F.max(ratio)).first()[0] or 0.0
    # a document without tokens weighs nothing; drawing it for sure keeps it
    p = F.when(F.col("tokens") > 0, F.round(ratio / F.lit(top or 1.0), 12)).otherwise(F.lit(1.0))
    return raked.select(*AXES, F.col("w").alias("weight"), p.alias("p"))


def draw(docs: DataFrame, given: Mapping[str, Mapping] | None = None, seed: int = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """Each row's doc_id, source, lang, topic, tokens, cell weight, probability p and sampled (boolean).

    Null sources or languages and texts without words (topic -1) form groups of their own. Rows with the same doc_id in one cell are drawn
    together, as the draw is a hash of doc_id (null hashes like any other value); of rows at one place in the draw of first centres, the one with
    the smaller bins comes first. Documents without tokens are kept. A very long text is counted whole, in
    its task. An empty table gives an empty result. Other columns take no part, whatever their names.
    """
    table = binned(docs)
    rows = _narrow(table, docs.sparkSession.sparkContext.broadcast(learn_topics(table)))
    release(table)
    cells = probabilities(rows, given, max_cells)
    keyed = cells.select(*[F.col(a).alias(f"__{a}") for a in AXES], "weight", "p")
    on = [F.col(a).eqNullSafe(F.col(f"__{a}")) for a in AXES]
    small = cells.limit(max_cells + 1).count() <= max_cells
    joined = rows.join(F.broadcast(keyed) if small else keyed, on)
    joined = joined.withColumn("p", F.when(F.col("tokens") > 0, F.col("p")).otherwise(F.lit(1.0)))
    return joined.select("doc_id", *AXES, "tokens", "weight", "p", (uniform(seed) < F.col("p")).alias("sampled"))


def mix(docs: DataFrame, given: Mapping[str, Mapping] | None = None, seed: int = SEED) -> DataFrame:
    """docs, in their own columns, thinned to the target mixture: the rows that draw() samples.

    Nulls, empty texts and repeated rows are as in draw(); an empty table stays empty. Columns may not start with two underscores.
    """
    table = binned(docs)
    topics = docs.sparkSession.sparkContext.broadcast(learn_topics(table))
    cells = probabilities(_narrow(table, topics), given).select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("p").alias("__p"))
    small = cells.limit(MAX_CELLS + 1).count() <= MAX_CELLS
    on = F.col("source").eqNullSafe(F.col("__s")) & F.col("lang").eqNullSafe(F.col("__l")) & (F.col("__topic") == F.col("__t"))
    rows = described(docs, topics, docs.columns).withColumn("__u", uniform(seed))
    return rows.join(F.broadcast(cells) if small else cells, on).where((F.col("__u") < F.col("__p")) | (F.col("__tokens") == 0)).select(docs.columns)
