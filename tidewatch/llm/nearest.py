"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of `BOOKS` codebooks; all codebooks span the full dimension, each trained on
what the ones before leave over. Encoding is a beam search over the sums, scored by tables of inner products. A
query's inner product with a coded vector is a sum of entries of one lookup table, corrected by a stored norm (that of the
vector over that of its code). That score is off by at most the query's norm times the stored norm of what the code leaves over. A first
shortlist gives a score that the nearest reach at least; every row that may reach it within its bound is compared exactly, in double precision,
so that no neighbour is lost, however many near copies share a code. Where codes are coarse for the data, the bound lets most rows through.

Scale: codebooks are trained on at most `SAMPLE` vectors chosen by a hash. The index is a table in the shared folder, every valid
row coded, in partitions of bounded size. Queries go out in blocks of bounded size; a partition
scans its codes for a block, reranks exactly beside the original vectors (so nothing is fetched by id; one matrix
product for 128 queries bounds the cost), and sends on its 20 best for each query, which are combined before and after the shuffle by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, materialize, seeded

NEAREST = 20
BOOKS, WORDS, BEAM = 8, 256, 4
SAMPLE = 6144
ROUNDS = 8
#: Rows of an index partition, of a block of queries, and the shortlist that a partition takes its first bound for a query from.
PART_ROWS, QUERY_ROWS, SHORTLIST = 16_384, 8192, 192


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: of the commonest length, finite, and neither null nor zero."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & ok)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (common.n if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Codebooks:
    """words: (books, words, dimension); cross: inner products of all words with all others."""

    def __init__(self, sample: np.ndarray) -> None:
        rng = np.random.default_rng(13)
        rest, k = sample.astype(np.float32), min(WORDS, len(sample))
        books = []
        for _ in range(BOOKS):
            words = rest[rng.choice(len(rest), k, replace=False)].copy()
            for _ in range(ROUNDS):
                near = (rest @ words.T - (words**2).sum(axis=1) / 2).argmax(axis=1)
                count = np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                sums = np.zeros_like(words)
                full = count > 0
                sums[full] = np.add.reduceat(rest[order], np.concatenate(([0], np.cumsum(count[full])[:-1])), axis=0)
                words[full] = sums[full] / count[full, None]
                words[~full] = rest[rng.choice(len(rest), (~full).sum())]
            rest = rest - words[(rest @ words.T - (words**2).sum(axis=1) / 2).argmax(axis=1)]
            books.append(words)
        self.words = np.stack(books)
        flat = self.words.reshape(-1, sample.shape[1])
        self.cross = (flat @ flat.T).astype(np.float32)
        self.half = np.diag(self.cross).reshape(BOOKS, k) / 2

    def encode(self, x: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Codes, (n, books) of uint8, by beam search."""
        return np.concatenate([self._encode(x[i : i + rows].astype(np.float32)) for i in range(0, len(x), rows)]) if len(x) else np.zeros((0, BOOKS), np.uint8)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n, k = len(x), self.words.shape[1]
        dots = (x @ self.words.reshape(-1, x.shape[1]).T).reshape(n, BOOKS, k)
        gain = np.zeros((n, 1), np.float32)  # x.s - |s|^2/2 for the sum s so far: half of what the error has lost
        codes = np.zeros((n, 1, 0), np.int64)
        for m in range(BOOKS):
            more = gain[:, :, None] + (dots[:, m] - self.half[m])[:, None, :]
            for j in range(m):
                more -= self.cross[j * k + codes[:, :, j], m * k : (m + 1) * k]
            flat = more.reshape(n, -1)
            b = min(BEAM if m + 1 < BOOKS else 1, flat.shape[1])
            top = np.argpartition(flat, flat.shape[1] - b, axis=1)[:, -b:]
            gain = np.take_along_axis(flat, top, axis=1)
            codes = np.concatenate((np.take_along_axis(codes, (top // k)[:, :, None], axis=1), (top % k)[:, :, None]), axis=2)
        return codes[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(BOOKS))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, books, words): inner products."""
        return (queries.astype(np.float32) @ self.words.reshape(-1, queries.shape[1]).T).reshape(len(queries), BOOKS, -1)


def build_index(rows: DataFrame, sample: int = SAMPLE) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks, and the index: vec_id, embedding (double), codes (binary), norm (double), rest (norm of what the scaled code leaves over), part."""
    spark = rows.sparkSession
    good = materialize(valid(rows), "vectors")
    picked = good.orderBy(seeded("vec_id", seed=8), "vec_id").limit(sample).toPandas()
    n = good.count()
    parts = max(1, -(-n // PART_ROWS))
    books = Codebooks(np.stack(picked.embedding)) if len(picked) else None
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("embedding"))
                codes = shared.value.encode(x)
                sums = shared.value.decode(codes).astype(np.float64)
                norms = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
                rest = np.linalg.norm(x - norms[:, None] * sums, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(rest)], [*b.schema.names, "codes", "norm", "rest"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    coded = arrow(
        good.withColumn("part", F.pmod(seeded("vec_id", seed=2), F.lit(parts)).cast("int")), code, f"vec_id {kind}, embedding array<double>, part int, codes binary, norm double, rest double"
    )
    return books, materialize(coded.repartition(min(parts, 4096), "part"), "index")


def _dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in one order of additions, so that equal vectors tie exactly wherever they are."""
    return np.einsum("ij,j->i", x, q, optimize=False)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores; of equal ones the first, so that the smaller ids win ties."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    sure = np.flatnonzero(scores > least)
    return np.concatenate((sure, np.flatnonzero(scores == least)[: k - len(sure)]))


def _floor(scores: np.ndarray, k: int) -> float:
    """The k-th largest score, which the k nearest reach at least; without k scores nothing is known."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def _scan(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, rest: np.ndarray, books: Codebooks, qids: np.ndarray, q: np.ndarray, nearest: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(ids, kind="stable")
    ids, x, codes, norms = ids[order], x[order], codes[order], norms[order]
    # rows that repeat an id are one candidate, so the nearest ids may take that many rows more
    k_rows = nearest + len(ids) - len(np.unique(ids))
    dims = x.shape[1] + BOOKS
    # how far single precision may be off in the sums of table entries, and double precision in the products below
    single = dims * 2.0**-22 * np.linalg.norm(books.words, axis=2).max(axis=1).sum()
    bound = rest[order] + single * norms
    double = dims * 2.0**-51 * np.linalg.norm(x, axis=1).max()
    norms = norms.astype(np.float32)
    for at in range(0, len(q), 128):
        block, own = q[at : at + 128], qids[at : at + 128]
        size = np.linalg.norm(block, axis=1)
        tables = books.tables(block)
        approx = np.zeros((len(tables), len(ids)), np.float32)
        for m in range(BOOKS):
            approx += tables[:, m, :][:, codes[:, m]]
        approx *= norms
        need = np.zeros(len(ids), bool)
        for k, row in enumerate(approx):
            first = _best(row, SHORTLIST)
            least = _floor(_dots(x[first[ids[first] != own[k]]], block[k]), k_rows)
            need |= ~(row + size[k] * bound < least - double * size[k])
        at_rows = np.flatnonzero(need)
        exact = block @ (x if need.all() else x[at_rows]).T
        out = []
        for k, row in enumerate(exact):
            cand = np.flatnonzero(ids[at_rows] != own[k])
            row = row[cand]
            cand = at_rows[cand[~(row < _floor(row, k_rows) - 2 * double * size[k])]]
            score = _dots(x[cand], block[k])
            by = np.lexsort((ids[cand], -score))
            cand, score = cand[by], score[by]
            top = np.sort(np.unique(ids[cand], return_index=True)[1])[:nearest]
            out.append((np.full(len(top), own[k]), ids[cand[top]], score[top]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's nearest rows by inner product, without itself.

    rows and queries have vec_id and embedding. Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part on either side, and neither do rows without vec_id. Ties go to the smaller vec_id. Rows
    that repeat a vec_id are one candidate (the one with the higher score), and so are repeated queries. Empty tables give no rows.
    """
    spark = rows.sparkSession
    books, index = build_index(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    if books is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = valid(queries).where(F.size("embedding") == books.words.shape[2]).dropDuplicates(["vec_id"])
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    books_ = spark.sparkContext.broadcast(books)
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(seeded("vec_id", seed=3), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        if not len(block):
            continue
        shared = spark.sparkContext.broadcast((block.vec_id.to_numpy(), np.stack(block.embedding).astype(np.float64)))

        def whole(part: list[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(part).combine_chunks()
            if table.num_rows:
                x = _matrix(table.column("embedding").chunk(0))
                codes = np.stack([np.frombuffer(c, np.uint8) for c in table.column("codes").to_pylist()])
                yield from _scan(table.column("vec_id").to_numpy(), x, codes, table.column("norm").to_numpy(), table.column("rest").to_numpy(), books_.value, *shared.value, nearest)

        def scan(batches: Iterator[pa.RecordBatch], whole=whole) -> Iterator[pa.RecordBatch]:
            part: list[pa.RecordBatch] = []
            for piece in batches:
                part.append(piece)
                if sum(p.num_rows for p in part) >= PART_ROWS:
                    yield from whole(part)
                    part = []
            if part:
                yield from whole(part)

        one = arrow(index, scan, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
