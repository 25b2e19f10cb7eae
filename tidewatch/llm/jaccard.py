"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct word shingles. Two documents link when their sets' Jaccard similarity reaches t; documents
with links between them form a component. The result is exact and never lists the pairs of a group of copies.

Method. Shingles are ordered by rarity (the count, over all documents, of the bucket a shingle hashes to, then its hash). The
token-group matrix is kept inverted, shingle -> group, and only for prefixes: if J(x, y) >= t, the first |x| - ceil(t|x|) + 1
shingles of x and those of y have one in common. The documents with a shingle in their prefixes, less those that lengths and positions
leave no partner there, are a group; shingles with the same documents share one group. So similar documents meet in a group, and
a group of copies is one group, or few, however large.

A document is compared with the pivot of each of its groups, once where groups have the same pivot; what links to the pivot is
done, and a group of which nothing else is left stays closed. In the others (in blocks, where they are large; all blocks
share the pivot) each document left is a query to the group: the group's token union bounds the overlap that it can
have with any member, and only where the bound reaches t is the group opened and are the members compared that it is not connected with yet.
Token sets are sent only of documents whose signature (1024 parities, so that differing bits bound differing shingles) leaves a link possible.
Components come from the links by large-star and small-star steps over tables.

Scale and skew: exact copies collapse before any join: their sets are counted with map-side combination, and the most common ones are a
broadcast list of fixed length (a set outside it has few copies). Rarity keeps passages that many documents share
out of prefixes. A task of the prefix join sees a hash range of shingles and emits (group, document), never pairs; shingles that are
common all the same become groups directly, and no task sees their documents together. Groups are cut into blocks of bounded size. Texts are never
shuffled: each pass reads them again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, arrow, map_arrow, materialize, mixed, own_columns, release, shingle_set

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Buckets of the shingle counts that rarity is read from, and pieces that the counts are added up in.
BUCKET_BITS, PIECES = 22, 64
#: The most common sets, of which only one document joins.
COMMON = 50_000
#: Shingles in buckets with larger counts become groups without a task that sees all their documents.
FREQUENT = 500_000
#: Documents in a block of a group.
BLOCK = 2000
#: Bits of a set's signature: the parities of the shingles on each.
SIGN_BITS = 1024
#: Bits of the filter that says which documents take part in a comparison.
FILTER_BITS = 1 << 26


def _name(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(s: np.ndarray) -> bytes:
    """Bits in which two signatures differ are at most the shingles that one set has and the other has not."""
    return np.packbits(np.bincount((s & np.uint64(SIGN_BITS - 1)).astype(np.int64), minlength=SIGN_BITS).astype(np.uint8) & 1).tobytes()


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, name (of the set) and sign of each row; the last two are null for an empty set."""

    def make():
        powers = Powers()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(t.as_py(), width, powers) for t in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()),
                    *[pa.array([f(s) if len(s) else None for s in found], pa.binary()) for f in (_name, _sign)],
                ],
                ["doc_id", "n_shingles", "name", "sign"],
            )

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id bigint, n_shingles bigint, name binary, sign binary")


def rarity(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Shingles in each bucket, over the sets of all rows.

    A task adds up its own counts and sends them in pieces, packed; each piece is summed where it arrives, one at a time.
    """
    size = (1 << BUCKET_BITS) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total, any_ = Powers(), np.zeros(1 << BUCKET_BITS, np.int32), False
        for b in batches:
            found = [_bucket(shingle_set(t.as_py(), width, powers)) for t in b.column("text")]
            if sum(map(len, found)):
                np.add.at(total, np.concatenate(found), np.int32(1))
                any_ = True
        if any_:
            packed = [zlib.compress(total[k * size : (k + 1) * size].tobytes(), 1) for k in range(PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(packed, pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column("piece").to_pylist(), b.column("counts"), strict=True):
                own = np.frombuffer(zlib.decompress(packed.as_py()), np.int32).astype(np.int64)
                total[k] = total[k] + own if k in total else own
        if total:
            packed = [zlib.compress(v.tobytes(), 1) for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["piece", "counts"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    schema = "piece int, counts binary"
    for r in arrow(arrow(docs.select("text"), count, schema).repartition("piece"), add, schema).toLocalIterator():
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's shingles, rarest first."""
    return s[np.argsort(counts[_bucket(s)], kind="stable")]


def _need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap that sets of n and m shingles need."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefixes(docs: DataFrame, shared, width: int) -> DataFrame:
    """doc_id, n, and the prefix of each row that joins: first its ordinary shingles, then the frequent ones."""

    def make():
        powers = Powers()
        counts, common = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, sizes, prefix, frequent = [], [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingle_set(text.as_py(), width, powers)
                if not len(s) or key is None or common.get(_name(s), key) != key:
                    continue
                n = len(s)
                order = _ordered(s, counts)[: n - -(-PERCENT * n // 100) + 1]
                cut = int(np.searchsorted(counts[_bucket(order)], FREQUENT, "right"))
                ids.append(key)
                sizes.append(n)
                prefix.append(order[:cut].view(np.int64))
                frequent.append(order[cut:].view(np.int64))
            if not ids:
                return None
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (prefix, frequent)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), *lists], ["doc_id", "n", "prefix", "frequent"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id bigint, n int, prefix array<bigint>, frequent array<bigint>")


def _partnered(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents of a shingle's have another one there that lengths and positions allow to be similar."""
    if len(n) > 4000:
        return np.ones(len(n), bool)
    ok = np.zeros(len(n), bool)
    for i in range(0, len(n), 512):
        q = slice(i, i + 512)
        fit = np.minimum(n[q, None] - at[q, None], n[None] - at[None]) >= _need(n[q, None], n[None])
        fit[np.arange(fit.shape[0]), np.arange(i, i + fit.shape[0])] = False
        ok[q] |= fit.any(axis=1)
        ok |= fit.any(axis=0)
    return ok


def matrix(prefix: DataFrame) -> DataFrame:
    """Rows (grp, doc_id): the groups of two documents or more that shingles of prefixes make."""
    rows = prefix.select("doc_id", "n", F.posexplode("prefix").alias("at", "w"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        doc, n, at, w = (np.concatenate(c).astype(np.int64) for c in zip(*held, strict=True))
        del held
        order = np.lexsort((doc, w))
        w = w[order]
        bounds = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
        seen, groups, members, size = set(), [], [], 0
        for i in np.flatnonzero(np.diff(bounds) > 1):
            run = order[bounds[i] : bounds[i + 1]]
            ids = doc[run[_partnered(n[run], at[run])]]
            if len(ids) < 2:
                continue
            key = int(mixed((mixed(ids.view(np.uint64)) * np.uint64(3)).sum(keepdims=True) + np.uint64(len(ids))).view(np.int64)[0])
            if key in seen:
                continue
            seen.add(key)
            groups.append(np.full(len(ids), key))
            members.append(ids)
            size += len(ids)
            if size >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(members))], ["grp", "doc_id"])
                groups, members, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(members))], ["grp", "doc_id"])

    frequent = prefix.select(F.explode("frequent").alias("grp"), "doc_id")
    return arrow(rows.repartition("w"), probe, "grp bigint, doc_id bigint").unionByName(frequent)


class Filter:
    """A Bloom filter of fixed size over document ids; what it lets through is joined exactly afterwards."""

    def __init__(self, size: int = FILTER_BITS) -> None:
        self.bits = np.zeros(size >> 3, np.uint8)

    def _at(self, ids: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h = (ids.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        top = np.uint64(len(self.bits) * 8 - 1)
        return [((h >> np.uint64(k)) & top).astype(np.int64) for k in (3, 33)]

    def add(self, ids: np.ndarray) -> None:
        for at in self._at(ids):
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in self._at(ids):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def _filter_of(ids: DataFrame) -> np.ndarray:
    """The filter's bytes: set by each task for its rows, sent as (byte, bits) and combined by byte before they meet."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter()
        for b in batches:
            own.add(b.column(0).to_numpy())
        at = np.flatnonzero(own.bits)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(own.bits[at[i : i + 50_000]].astype(np.int32))], ["at", "bits"])

    held = arrow(ids, build, "at bigint, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for b in held.toArrow().to_batches():
        out[b.column("at").to_numpy()] = b.column("bits").to_numpy()
    return out


def token_sets(docs: DataFrame, bits, width: int) -> DataFrame:
    """doc_id and tokens (the set, sorted, as bytes) of the rows that the filter lets through."""

    def make():
        powers, known = Powers(), Filter(8)
        known.bits = bits.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            batch = batch.filter(batch.column("doc_id").is_valid())
            if not batch.num_rows:
                return None
            batch = batch.filter(pa.array(known.holds(batch.column("doc_id").to_numpy())))
            tokens = [shingle_set(t.as_py(), width, powers).tobytes() for t in batch.column("text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.binary())], ["doc_id", "tokens"]) if tokens else None

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id bigint, tokens binary")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    both = np.searchsorted(b, a)
    common = int((b[np.minimum(both, m - 1)] == a).sum())
    return 100 * common >= PERCENT * (n + m - common)


def _open(keys: list[int], tokens: list[np.ndarray], query: list[bool], hub: int) -> list[tuple[int, int]]:
    """Links among the documents of one block of a group, as many as connect what is connected.

    query: documents that come from another block of the group; two of them need no comparison here. hub: the pivot's place, or -1.
    """
    links: list[tuple[int, int]] = []
    part = list(range(len(keys)))  # of each document, the root of what it is linked to

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    rest = []
    for i in range(len(keys)):
        if hub >= 0 and i != hub and _linked(tokens[i], tokens[hub]):
            part[i] = hub
            links.append((keys[i], keys[hub]))
        elif i != hub:
            rest.append(i)
    if not rest or (hub >= 0 and len(keys) == 2):
        return links
    union, uses = np.unique(np.concatenate(tokens), return_counts=True)
    sizes = np.array([len(t) for t in tokens])
    done = np.zeros(len(keys), bool)
    for i in rest:
        own, done[i] = tokens[i], True
        bound = int((uses[np.searchsorted(union, own)] > 1).sum())  # tokens of some other document
        if 100 * bound < PERCENT * len(own):
            continue  # the group stays closed to it
        for j in np.flatnonzero(~done & (100 * np.minimum(sizes, len(own)) >= PERCENT * np.maximum(sizes, len(own)))).tolist():
            if not (query[i] and query[j]) and root(i) != root(j) and _linked(own, tokens[j]):
                links.append((keys[i], keys[j]))
                part[root(i)] = root(j)
    return links


def open_groups(parts: DataFrame, signs: DataFrame, tokens: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) found in the groups, whose rows (grp, doc_id) parts has; signs and tokens give the signatures and sets of documents.

    Groups share many documents and pivots, so each document first meets each of its pivots once; only groups with a
    document that doesn't link to the pivot, and with another one to meet, are opened.
    """
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")
    sizes = parts.groupBy("grp").agg(F.count("*").alias("c"), F.min("doc_id").alias("pivot")).where("c > 1")
    members = materialize(parts.hint("merge").join(sizes, "grp").select("grp", "doc_id", "pivot", "c", blocks), "members")

    star = materialize(members.where("doc_id <> pivot").select("pivot", "doc_id").distinct(), "star")
    hubs = materialize(star.groupBy("pivot").agg(F.count("*").alias("c")).select("pivot", blocks), "pivots")
    spokes = star.join(hubs, "pivot").select(F.col("pivot").alias("grp"), "doc_id", "pivot", F.explode(own).alias("block"), F.lit(False).alias("query"))
    centres = hubs.select(F.col("pivot").alias("grp"), F.col("pivot").alias("doc_id"), "pivot", F.explode(every).alias("block"), F.lit(False).alias("query"))
    apart = signs.withColumn("part", F.col("doc_id"))
    dealt = materialize(_screened(spokes.unionByName(centres), apart, True), "star-blocks")
    release(star, hubs)
    met = materialize(_met(dealt, tokens(dealt.select("doc_id"))), "links")
    release(dealt)
    first = met.select("a", "b")

    near = met.where("sole").select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"))
    lone = materialize(members.where("c > 2 AND doc_id <> pivot").join(near, ["doc_id", "pivot"], "left_anti"), "lone")
    if not lone.limit(1).count():
        release(members, lone)
        return first
    opened = members.join(lone.select("grp").distinct(), "grp", "left_semi")
    home = opened.select("grp", "doc_id", "pivot", F.explode(F.when(F.col("doc_id") == F.col("pivot"), every).otherwise(own)).alias("block"), F.lit(False).alias("query"))
    # documents of large groups that do not link to the pivot meet the other blocks as queries
    queries = lone.where("blocks > 1").select("grp", "doc_id", "pivot", own[0].alias("home"), F.explode(every).alias("block"), F.lit(True).alias("query")).where("block <> home").drop("home")
    # documents that the links so far connect need no comparison
    known = signs.join(components(first), "doc_id", "left").select(*signs.columns, F.coalesce("component_id", "doc_id").alias("part"))
    again = materialize(_screened(home.unionByName(queries), known, False), "blocks")
    release(members, lone)
    more = materialize(_opened(again, tokens(again.select("doc_id"))), "more-links")
    release(again)
    return first.unionByName(more)


def _met(dealt: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) of documents to their pivot; sole if neither has a second text that other documents could link to."""

    def one(table: pa.Table) -> pa.Table:
        keys, pivot = table.column("doc_id").to_pylist(), table.column("pivot")[0].as_py()
        texts: dict[int, list[np.ndarray]] = {}
        for key, t in zip(keys, table.column("tokens"), strict=True):
            texts.setdefault(key, []).append(np.frombuffer(t.as_py(), np.uint64))
        hubs = texts.pop(pivot, [])
        near = [key for key, own in texts.items() if any(_linked(x, hub) for x in own for hub in hubs)]
        sole = [len(hubs) == len(texts[key]) == 1 for key in near]
        return pa.table({"a": pa.array(near, pa.int64()), "b": pa.array([pivot] * len(near), pa.int64()), "sole": pa.array(sole, pa.bool_())})

    return _rows(dealt, tokens).groupBy("grp", "block").applyInArrow(one, "a bigint, b bigint, sole boolean")


def _screened(dealt: DataFrame, signs: DataFrame, to_pivot: bool) -> DataFrame:
    """The rows of dealt whose sizes and signatures leave a link possible that joins two parts, to the block's pivot or to any document of the block.

    So token sets are sent only of documents that the groups are opened for.
    """

    def one(table: pa.Table) -> pa.Table:
        keys, n, query, part = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n_shingles", "query", "part"))
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint64).reshape(len(keys), -1)
        pivot = keys == table.column("pivot")[0].as_py()
        keep = np.zeros(len(keys), bool)
        for i in np.flatnonzero(pivot) if to_pivot else range(len(keys)):
            far = n[i] + n - 2 * _need(n[i], n)
            near = (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])) & (part != part[i]) & ~(query & query[i])
            near[near] = np.bitwise_count(sign[near] ^ sign[i]).sum(axis=1) <= far[near]
            if near.any():
                keep |= near
                keep[i] = True
        return table.select(columns).filter(pa.array(keep))

    columns = dealt.columns
    rows = dealt.hint("merge").join(signs, "doc_id").select(*dealt.columns, "n_shingles", "sign", "part")
    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    return rows.groupBy("grp", "block").applyInArrow(one, schema).distinct()


def _rows(dealt: DataFrame, tokens: DataFrame) -> DataFrame:
    # the same plan at every size: a broadcast of the small side would end where it outgrows its bound
    return dealt.hint("merge").join(tokens, "doc_id").select("grp", "block", "doc_id", "query", "pivot", "tokens")


def _opened(dealt: DataFrame, tokens: DataFrame) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        keys, pivot = table.column("doc_id").to_pylist(), table.column("pivot")[0].as_py()
        sets_ = [np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")]
        links = _open(keys, sets_, table.column("query").to_pylist(), keys.index(pivot) if pivot in keys else -1)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return _rows(dealt, tokens).groupBy("grp", "block").applyInArrow(one, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest id) of all ids in links, by large-star and small-star steps until nothing changes."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # large star: larger neighbours of u move to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        release(edges)
        # small star: u and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "small-star")
        release(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(roots)


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id (the smallest doc_id that links lead to).

    Null and wordless texts have 0 shingles and are their own component; so is a row with a null doc_id, whose component is null. A text
    with fewer words than a shingle has one, the whole sequence. Rows that repeat a doc_id are one document in links: each of their texts links it.
    Other columns take no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = materialize(sets(docs, width), "sets")
    same = materialize(
        named.where("name is not null and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"),
        "set-copies",
    )
    common = {bytes(r.name): r["first"] for r in same.orderBy(F.desc("copies"), "name").limit(COMMON).toLocalIterator()}
    shared = spark.sparkContext.broadcast((rarity(docs, width), common))
    parts = materialize(matrix(prefixes(docs, shared, width)).distinct(), "matrix")
    signs = named.where("name is not null and doc_id is not null").select("doc_id", "n_shingles", "sign").dropDuplicates()
    links = open_groups(parts, signs, lambda ids: token_sets(docs, spark.sparkContext.broadcast(_filter_of(ids)), width))
    # copies link to the first of their set
    joined = named.where("name is not null").select("name", "doc_id").join(same.select("name", "first"), "name").where("doc_id <> first")
    copies = joined.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(links.unionByName(copies))
    component = F.coalesce("component_id", "doc_id")
    return named.join(found, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"))


@own_columns
def keep_first(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, in their own columns, with the smallest doc_id of each component; of rows that repeat both doc_id and text, one.

    A row without doc_id has no links, so it stays, once for each text.
    """
    found = classes(docs, width)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = materialize(docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("c")).where("c > 1").select("__id"), "repeated")
    again = F.col("doc_id").eqNullSafe(F.col("__id"))
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
