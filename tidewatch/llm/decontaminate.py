"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' word sequences go into one automaton (Blumer et al.; suffix links give, for each state, the lengths of the
strings it stands for). A document's words are streamed through it once; after each word the automaton holds the longest
suffix of what was read that occurs in any item. Where that length reaches `window`, the last words are a hit, whatever
item they come from; an item shorter than `window` counts where it occurs whole.

Scale: the items are the only thing that is broadcast. Their size is measured first; beyond `block_words` words they are
dealt into blocks by hash, and each block takes a pass of its own over the documents. A pass ends in a table, so a task and
the driver hold one block's automaton at a time, however many items there are. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_arrow, materialize, own_columns, release

WINDOW = 10
#: Words of items in one automaton.
BLOCK_WORDS = 200_000
HITS = "__spans array<struct<first:int,last:int>>, __items array<string>"


class SuffixAutomaton:
    """A generalised suffix automaton over word ids, with what its states say about windows."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for k, words in items if words]
        for _, ids in known:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._mark(known)

    def _state(self, length: int, link: int, then: dict[int, int]) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of q that are no longer than p's longest and c."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _mark(self, known: list[tuple[str, list[int]]]) -> None:
        """found[s]: what is met when the automaton is in s, as (length, items) of windows that end here."""
        w = self.window
        self.shortest = min([w, *(len(ids) for _, ids in known)])
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # the state that holds the last w words, for each state that is long enough
        home = [0] * len(self.link)
        for s in by_length:
            if self.length[s] >= w:
                home[s] = s if self.length[self.link[s]] < w else home[self.link[s]]
        full: dict[int, set[str]] = {}
        short: dict[int, set[str]] = {}
        for key, ids in known:
            s = 0
            for n, c in enumerate(ids, 1):
                s = self.next[s][c]
                if n >= w:
                    full.setdefault(home[s], set()).add(key)
            if len(ids) < w:
                short.setdefault(s, set()).add((len(ids), key))
        found: list[tuple] = [()] * len(self.link)
        for s in by_length:
            own = tuple(sorted(short.get(s, ()), reverse=True))
            found[s] = own + found[self.link[s]] if own else found[self.link[s]]
        self.home, self.full, self.short = home, full, found

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [first, last) of hit words, and the items with windows among them."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, items
        then, link, length, home, short, w = self.next, self.link, self.length, self.home, self.short, self.window
        s = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words), 1):
            if c is None:
                s = n = 0
                continue
            while c not in then[s]:
                s = link[s]
                if s < 0:
                    break
                n = length[s]
            if s < 0:
                s = n = 0
                continue
            s = then[s][c]
            n += 1
            hit = 0
            if n >= w:
                hit = n
                items |= self.full[home[s]]
            if short[s]:
                for k, key in short[s]:
                    if k <= n:
                        hit = max(hit, k)
                        items.add(key)
            if hit:
                first = i - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))
        return spans, items


def item_blocks(items: DataFrame, block_words: int) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """How many blocks of bounded size the items make, and a function that collects one of them."""
    words = items.select(F.col("item_id").cast("string").alias("k"), "text").where("text is not null")
    total = words.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))  # a word and its blank take four characters at least on average

    def block(b: int) -> list[tuple[str, str]]:
        part = words.where(F.pmod(F.xxhash64("k", "text"), F.lit(n)) == b)
        return [(r.k if r.k is not None else "", r.text) for r in part.toLocalIterator()]

    return n, block


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of docs with __n_words, hit __spans (in words) and __items, the ids of the items hit, as strings in order.

    Null or empty text: no words. Null or wordless items are never hit; a null item_id counts as an empty string.
    Repeated rows each get their own result. An empty items table leaves every document clean. A very long text is streamed whole,
    in its task. Other columns pass through.
    """
    spark = docs.sparkSession
    n, block = item_blocks(items, block_words)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["__n_words bigint", HITS])
    found = docs
    for b in range(n):
        shared = spark.sparkContext.broadcast(SuffixAutomaton([(k, alnum_words(t)) for k, t in block(b)], window))
        before, found = found, _pass(found, shared, out, first=b == 0)
        if n > 1:  # passes in one stage would hold all their automata at the same time
            found = materialize(found, "hits")
            shared.unpersist()
            if b:
                release(before)
    return found


def _pass(docs: DataFrame, shared, out: str, first: bool) -> DataFrame:
    """One pass over the documents; a later one adds to what the ones before it found."""

    def make():
        automaton = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, spans, items = [], [], []
            before = None if first else (batch.column("__spans").to_pylist(), batch.column("__items").to_pylist())
            for i, text in enumerate(batch.column("text")):
                words = alnum_words(text.as_py())
                hit, keys = automaton.search(words)
                if before:
                    hit = _merged([*hit, *((x["first"], x["last"]) for x in before[0][i])])
                    keys |= set(before[1][i])
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in hit])
                items.append(sorted(keys))
            keep = batch.num_columns if first else batch.num_columns - 3
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                [*batch.schema.names[:keep], "__n_words", "__spans", "__items"],
            )

        return each

    return map_arrow(docs, make, out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(hits: DataFrame) -> DataFrame:
    """Counts of find_hits' rows: n_hit words, n_items, their ids' SHA-256, and whether any word is hit."""
    n_hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["last"] - x["first"]).cast("bigint"))
    return hits.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def _cutter() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)
        texts = [cut_spans(t, [(x["first"], x["last"]) for x in s]) if s else t for t, s in rows]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return each


@own_columns
def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, in their own columns, without benchmark passages.

    A document whose share of hit words exceeds max_coverage goes; from one within it, the hit spans are cut out
    (n_chars, where it is a column, follows the new text). Documents without hits stay as they are.
    """
    hits = find_hits(docs, items, window, block_words)
    share = F.aggregate("__spans", F.lit(0), lambda a, x: a + x["last"] - x["first"]) / F.greatest(F.col("__n_words"), F.lit(1))
    kept = hits.where((F.size("__spans") == 0) | (share <= max_coverage))
    if max_coverage > 0:
        kept = map_arrow(kept, _cutter, kept.schema)
        if "n_chars" in docs.columns:
            kept = kept.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)
