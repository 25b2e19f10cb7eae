"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's terms are its words (hashed, A-Z lower-cased), the trigrams of its character classes (what prose, tables, shouting, link lists
and noise look like) and banded measures of its words (repeats, variety, lengths). Term weights (logarithmic, times inverse document frequency)
are projected to a few dimensions by a truncated singular value decomposition. The labelled vectors are broadcast;
every document is compared with all of them, block by block, by exact cosines, and its nearest neighbours vote, weighted by similarity
and by how common their label is. Cosines count to six digits; of equal ones, the labelled document that comes first in the sample votes.

Scale: the model is fitted on at most `SAMPLE` labelled documents, half of either label, chosen by a hash of doc_id; their vectors
are the only broadcast and have that bound. Scoring maps the documents in place: no shuffle, no text leaves its task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, map_arrow, seeded

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 8.0
BLOCK = 512
FOLDS, HELD_OUT = 4, 2
GOOD = 0.7


def _classes() -> np.ndarray:
    """Sixteen classes of bytes."""
    c = np.zeros(256, np.uint16)
    for k, chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b"!?", b"|", b"*#%$&~^", b"@/\\", b"()[]{}<>", b"-_'\"", b":;=+"), 1):
        c[list(chars)] = k
    c[128:] = 15
    return c


CLASSES = _classes()
N_SHAPES = 16**3
N_BANDS, BANDS = 6, 16
#: Bins of the words, and their weight beside the trigrams.
N_WORDS, WORD_WEIGHT = 1 << 11, 0.5
WORDS_AT = N_SHAPES + N_BANDS * BANDS
N_TERMS = WORDS_AT + N_WORDS


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's terms and their weights before idf; none for null and empty texts."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    data = CLASSES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    at, weights = [], []

    def add(first: int, counts: np.ndarray, scale: float, weight: float = 1.0) -> None:
        bins = np.flatnonzero(counts)
        at.append(bins + first)
        weights.append(weight * np.log1p(counts[bins] * scale))

    if len(data) > 2:
        add(0, np.bincount((data[:-2] << 8) | (data[1:-1] << 4) | data[2:], minlength=N_SHAPES), 1000.0 / len(data))
    words = blank_words(text)
    if words:
        n = len(words)
        counts = Counter(words)
        lengths = np.fromiter(map(len, words), np.int32, n)
        repeats = sum(map(bytes.__eq__, words, words[1:])) / n
        by_class = np.bincount(data, minlength=16) / len(data)
        for k, v in enumerate((
            repeats**0.5, len(counts) / n**0.9, lengths.mean() / 12, by_class[3] ** 0.5, (by_class[8:12].sum()) ** 0.5, (by_class[4] + by_class[11]) ** 0.5,
        )):
            band = min(BANDS - 1, max(0, int(v * BANDS)))
            here = [band - 1, band] if band else [band]
            at.append(np.array(here) + N_SHAPES + k * BANDS)
            weights.append(np.array([1.0, 2.0][-len(here) :]))
        bins = np.fromiter((zlib.crc32(w) & (N_WORDS - 1) for w in counts), np.int64, len(counts))
        add(WORDS_AT, np.bincount(bins, np.fromiter(counts.values(), float, len(counts))), 100.0 / n, WORD_WEIGHT)
    return (np.concatenate(at), np.concatenate(weights).astype(np.float32)) if at else terms(None)


class Model:
    """Term weights, projection, labelled vectors and their votes; `prior` where there is nothing to compare with."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> None:
        self.prior = prior
        n = len(sample)
        x = np.zeros((n, N_TERMS), np.float32)
        for k, (bins, weights) in enumerate(sample):
            x[k, bins] = weights
        self.idf = np.log((1 + n) / (1 + np.count_nonzero(x, axis=0))) + 0.1
        x *= self.idf.astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rng = np.random.default_rng(3)
        d = max(1, min(DIMENSIONS, n, N_TERMS))
        q = rng.standard_normal((N_TERMS, d + 8)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0] if n else q
        u, s, vt = np.linalg.svd(x @ q, full_matrices=False) if n else (None, None, np.eye(d + 8, dtype=np.float32))
        self.projection = np.ascontiguousarray((q @ vt.T)[:, :d], np.float64) * self.idf[:, None]
        self.vectors = np.stack([self.place(t) for t in sample]) if n else np.zeros((0, d))
        share = labels.mean() if n else 0.5
        good = prior / share if share else 0.0
        bad = (1 - prior) / (1 - share) if share < 1 else 0.0
        self.labels = labels.astype(np.float32)
        self.votes = np.where(labels > 0, good, bad).astype(np.float32)

    def place(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The unit vector of a text's terms, by itself, so that its block has no say; zero without terms."""
        z = found[1].astype(np.float64) @ self.projection[found[0]]
        return z / max(float(np.linalg.norm(z)), 1e-12)

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        n = len(self.vectors)
        if not n:
            return np.full(len(texts), self.prior)
        near = np.rint(np.stack([self.place(t) for t in texts]) @ self.vectors.T * 1e6).astype(np.int64)
        k = min(NEIGHBOURS, n)
        # no two keys are equal: ties in similarity go to the earlier vector
        top = np.sort(np.argpartition(near * n - np.arange(n), n - k, axis=1)[:, -k:], axis=1)
        weight = (np.maximum(np.take_along_axis(near, top, axis=1), 0) / 1e6) ** SHARPNESS * self.votes[top]
        total = weight.sum(axis=1)
        voted = (weight * self.labels[top]).sum(axis=1)
        return np.where((total > 0) & [len(t[0]) > 0 for t in texts], voted / np.where(total > 0, total, 1), self.prior)


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside the held-out fold; a doc_id with both labels counts as neither."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", "q")
    counts = {r.q: r.n for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    ids = known.where("q = 0").orderBy(seeded("doc_id", seed=4), "doc_id").limit(sample // 2).unionByName(
        known.where("q = 1").orderBy(seeded("doc_id", seed=4), "doc_id").limit(sample // 2)
    )

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [terms(t.as_py()) for t in batch.column("text")]
            sent = [pa.array([x[k].astype(t).tobytes() for x in rows], pa.binary()) for k, t in enumerate((np.uint16, np.float16))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("q"), *sent], ["doc_id", "q", "terms", "weights"])

        return each

    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", F.col("q").cast("int").alias("q"), "text")
    fitted = map_arrow(picked, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, q int, terms binary, weights binary")
    held = fitted.orderBy(seeded("doc_id", seed=4), "doc_id").limit(sample).toPandas()  # the bound holds even where ids repeat
    found = [(np.frombuffer(t, np.uint16).astype(np.int64), np.frombuffer(w, np.float16).astype(np.float32)) for t, w in zip(held.terms, held.weights, strict=True)]
    return Model(found, held.q.to_numpy(float), prior)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each row's doc_id, held_out, score (probability of label 1, to 6 digits) and predicted (1 from GOOD up).

    Null and empty texts get the share of label 1 among the labelled rows. Without any labels that is 0.5, and it is every
    row's score. Repeated rows score alike; ties among neighbours are settled by the order of the sample, so a score does not depend on
    partitions or batches. A very long text is counted whole, in its task. Other columns take no part, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def make():
        m = model.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for at in range(0, batch.num_rows, BLOCK):
                out.append(m.score([terms(t.as_py()) for t in batch.column("text").slice(at, BLOCK)]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(np.concatenate(out), 6))], ["doc_id", "score"])

        return each

    scored = map_arrow(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
