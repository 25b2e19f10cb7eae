"""Collocations: phrases of frequent words by merged count-min sketches and an exact second pass.

Pass 1: each task counts the n-grams of its texts, single words included, in a count-min sketch whose counters stop at the least count that matters. A
counter never shows less than it has met, and the sum of tasks' counters cannot either; so where a merged counter stays below that
count, none of its n-grams is frequent. Merged counters become one bit each. Pass 2: the texts are read again, and n-grams whose bits are all set
(and whose shorter parts have passed) are counted exactly, by their words: in a task first, then by phrase. The sketch only leaves out what can't be
frequent, so the result does not depend on its width.

Scale: a task holds DEPTH * cells bytes; what is shuffled in pass 1 is a sketch a task, and as many tasks run as there are cores. Cells grow
with the bytes of text up to MAX_CELLS (8 MB a row as bits, which is what is broadcast); beyond that the sketch lets more through and the exact pass takes
more of the work, with the same result. Texts are handled in chunks that end between pieces, so a long text is not one allocation.
Hot phrases are added up before the shuffle; the ranking of a language goes by salted shares first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, materialize, mixed, release

LEAST, WORDS, TOP, SUBSUMED = 30, 4, 2000, 80
SCALE = 2_000_000
DEPTH = 2
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 26
#: Bytes of text for one cell of a sketch row.
BYTES_PER_CELL = 12
#: Cells in one row of the table of sketches, and bytes of text in a chunk.
SLOT, CHUNK = 1 << 12, 1 << 22
SHARES = 32
#: A-Z lower-cased, characters that end a piece as line feeds, tabs as blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The plain text in runs of about CHUNK bytes that end between pieces."""
    while len(text) > CHUNK and (at := text.find(b"\n", CHUNK)) >= 0:
        yield text[:at]
        text = text[at + 1 :]
    yield text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], bytes, np.ndarray]]:
    """Languages, plain text and, for each stretch between the languages' changes, its start: pieces of rows (lang, text as bytes) joined by line feeds."""
    langs, held, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for piece in _pieces((text.as_py() or b"").translate(PLAIN)):
                langs.append(lang)
                held.append(piece)
                size += len(piece) + 1
                if size >= CHUNK:
                    yield langs, b"\n".join(held), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
                    langs, held, size = [], [], 0
    if held:
        yield langs, b"\n".join(held), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])


class Words:
    """The words of a chunk: language and word numbers, the piece each is in, and a hash of both."""

    def __init__(self, langs: list[str], text: bytes, starts: np.ndarray) -> None:
        data = np.frombuffer(b"\n" + text, np.uint8)
        gap = (data == 32) | (data == 10)
        at = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.piece = np.cumsum(data == 10)[at]
        coded = pa.array(text.split(), pa.binary()).dictionary_encode()
        self.word, self.names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], np.int64)[np.searchsorted(starts, at, "right") - 1]
        hashes = lambda xs: np.array([xxhash.xxh64_intdigest(x) for x in xs], np.uint64)
        seeds = mixed(hashes(x.encode() for x in self.langs))
        self.hash = mixed(hashes(self.names)[self.word] ^ seeds[self.lang]) if len(at) else np.empty(0, np.uint64)

    def longer(self, h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-grams at places, from those of their first k - 1 words."""
        with np.errstate(over="ignore"):
            return mixed(h * _ODD + self.hash[at + k - 1])

    def whole(self, at: np.ndarray, k: int) -> np.ndarray:
        """Those of the places at which k words of one piece stand."""
        at = at[at + k <= len(self.word)]
        return at[self.piece[at] == self.piece[at + k - 1]]


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h if row == 0 else mixed(h + np.uint64(row) * _ODD)) >> np.uint64(64 - bits)).astype(np.uint32)


def _counter(least: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32) if least <= np.iinfo(t).max)


def _sketch(texts: DataFrame, bits: int, least: int, longest: int, depth: int) -> DataFrame:
    """slot, counters: each task's sketch, without empty slots. A slot is SLOT cells, or a whole row where that is less."""
    kind, wide = _counter(least), min(SLOT, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(1 << bits, kind) for _ in range(depth)]
        for chunk in _chunks(batches):
            words = Words(*chunk)
            at, h, found = np.arange(len(words.word)), words.hash, [words.hash]
            for k in range(2, longest + 1):
                more = words.whole(at, k)
                h, at = words.longer(h[np.searchsorted(at, more)], more, k), more
                found.append(h)
            found = np.concatenate(found)
            for r, row in enumerate(rows):
                cells, counts = np.unique(_cells(found, r, bits), return_counts=True)
                row[cells] = np.minimum(row[cells].astype(np.int64) + counts, least)
        for r, row in enumerate(rows):
            for s, cells in enumerate(row.reshape(-1, wide)):
                if cells.any():
                    yield pa.RecordBatch.from_arrays([pa.array([(r << bits) // wide + s], pa.int64()), pa.array([cells.tobytes()], pa.binary())], ["slot", "counters"])

    return arrow(texts, run, "slot bigint, counters binary")


def _merged(sketches: DataFrame, bits: int, least: int, depth: int) -> list[np.ndarray]:
    """The sum of all sketches, as a bit a cell: set where the counter reaches the least count."""
    kind, slots = _counter(least), max(1, (depth << bits) // SLOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(raw.as_py(), kind).astype(np.int64)
                total[slot] = np.minimum(total.get(slot, 0) + cells, least)
        for slot, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([np.packbits(cells >= least).tobytes()], pa.binary())], ["slot", "bits"])

    out = np.zeros((depth << bits) // 8, np.uint8)
    wide = min(SLOT, 1 << bits) // 8
    for r in arrow(sketches.repartition(min(slots, 128), "slot"), run, "slot bigint, bits binary").toLocalIterator():
        out[r.slot * wide : r.slot * wide + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return list(out.reshape(depth, -1))


def _survivors(texts: DataFrame, passed, bits: int, longest: int) -> DataFrame:
    """lang, phrase, k and f: exact counts, chunk by chunk, of n-grams that the sketch lets through; all words of a language as k = 0."""

    def open_(h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for r, row in enumerate(passed.value):
            c = _cells(h, r, bits)
            ok &= (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            words = Words(*chunk)
            n = len(words.word)
            totals = np.bincount(words.lang, minlength=len(words.langs))
            out = [(words.langs, [b""] * len(totals), np.zeros(len(totals), np.int64), totals)]
            at, h, held = np.arange(n), words.hash, words.lang
            before = np.ones(n + 1, bool)
            for k in range(1, longest + 1):
                if k > 1:  # both of its shorter parts have passed
                    more = words.whole(at, k)
                    more = more[before[more + 1]]
                    i = np.searchsorted(at, more)
                    h, held, at = words.longer(h[i], more, k), held[i], more
                ok = open_(h)
                at, h, held = at[ok], h[ok], held[ok]
                before = np.zeros(n + 1, bool)
                before[at] = True
                # exact: numbers of the first k - 1 words, and of the last word
                _, first, held, f = np.unique(held << 32 | words.word[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                starts = at[first]
                ids = words.word[starts[:, None] + np.arange(k)].tolist()
                phrases = [b" ".join([words.names[i] for i in p]) for p in ids]
                out.append(([words.langs[i] for i in words.lang[starts].tolist()], phrases, np.full(len(f), k), f))
            langs, phrases, ks, fs = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(itertools.chain(*langs)), pa.string()), pa.array(list(itertools.chain(*phrases)), pa.binary()), pa.array(np.concatenate(ks).astype(np.int32)), pa.array(np.concatenate(fs).astype(np.int64))],
                ["lang", "phrase", "k", "f"],
            )

    return arrow(texts, run, "lang string, phrase binary, k int, f bigint")


def counts(docs: DataFrame, least: int = LEAST, longest: int = WORDS, depth: int = DEPTH, max_cells: int = MAX_CELLS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, k, f: exact counts of all n-grams of 1 to `longest` words that occur `least` times or more in a language; all its words together as k = 0."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = int(np.clip(size // BYTES_PER_CELL, min(MIN_CELLS, max_cells), max_cells) - 1).bit_length()
    bits = min(bits, max_cells.bit_length() - 1)
    spark = docs.sparkSession
    sketches = materialize(_sketch(rows.coalesce(spark.sparkContext.defaultParallelism), bits, least, longest, depth), "phrase-sketches")
    passed = spark.sparkContext.broadcast(_merged(sketches, bits, least, depth))
    release(sketches)
    exact = _survivors(rows, passed, bits, longest).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return exact.where((F.col("f") >= least) | (F.col("k") == 0)).withColumn("phrase", F.col("phrase").cast("string"))


def _decimal(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def mine(docs: DataFrame, least: int = LEAST, longest: int = WORDS, top: int = TOP, subsumed: int = SUBSUMED, **options) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language, by score: lang, rank, phrase, a, l, r, n and score.

    a is the phrase's count, l and r those of the two parts of its lowest-scoring cut (ties to the first), n the language's words, and
    score floor(2000000 a / (l + r)), in decimals. A phrase is dropped if a longer candidate that contains it has `subsumed` percent of its count.
    Languages are kept apart, a null one is `und`; a null text is empty. Repeated rows count again. Other columns take no part, whatever they are called.
    Texts without words add nothing; a language without candidates has no rows, nor has an empty table.
    """
    found = materialize(counts(docs, least, longest, **options), "phrase-counts")
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    candidates = found.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))

    def part(side: str) -> DataFrame:
        return found.where("k >= 1").select("lang", F.col("phrase").alias(f"{side}_part"), F.col("f").alias(side))

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("l_part", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ")).withColumn("r_part", F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    cuts = cuts.join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"])
    cuts = cuts.withColumn("up", F.lit(SCALE).cast("decimal(7,0)") * _decimal("a")).withColumn("down", _decimal(F.col("l") + F.col("r")))
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("up div down").alias("score"), "cut", "l", "r")).alias("c"))

    inner = candidates.where("k > 2").select(
        "lang", "a", F.explode(F.expr("array_distinct(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), p -> array_join(slice(w, p, m), ' ')))))")).alias("phrase")
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _decimal("longer") < subsumed * _decimal("a")))

    order = [F.desc("c.score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    kept = kept.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("bigint").alias("score"))
