"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's set: its distinct words (runs without white space, lower-cased), as 64-bit hashes; two words of one hash would count as
one. A line goes if a line before it (by doc_id, then line number) has a Jaccard similarity of `threshold` or more with it. Whether that
earlier line goes too makes no difference, so one witness a line is enough, and the result does not depend on the order of work.
Lines without words always stay.

Copies: a line whose set came before goes; that is found by counts that are combined before the shuffle.

First witnesses: each line has four keys, hashes of its first and last three words by two orders of hashes; lines of similar sets have
one in common more often than not. A line is compared with the first line of each of its keys, and goes if one is similar. In a group of near copies
nearly all lines find their witness here, at one pair a key.

Join: the other lines are joined with all lines before them. Words are ordered by rarity: by the count, over all texts, of the
bucket that a word hashes to, then by hash. (Any total order is exact; bucket counts are a table of fixed size, so that they can be
broadcast at every scale.) With sets x and y, |x| >= |y|, at `threshold` t, the first |x| - ceil(t|x|) + 1 words of x and the first
|y| - ceil(2t/(1+t)|y|) + 1 words of y have a word in common (prefix filter; the shorter set needs the shorter prefix).
Candidates also pass a length filter, a positional filter and a bitmap filter (each bit of a signature is the parity of
the words that fall on it, so the bits in which two signatures differ bound the symmetric difference from below, and long
lines don't fill theirs) inside the join, so that what the join puts out is close to the true pairs; then the full word
sets are compared.

Scale and skew: of sets with many copies only the first line joins: the most common sets are a list of fixed length, which is
broadcast. Rare words come first, so a word of a third of all lines is in a prefix only where a line has nothing else.
The joins deal with plain exchanges on both sides, which adaptive execution splits when one is hot; the self-join shuffles its rows
once. Tables go when nothing reads them any more.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_columns, release

THRESHOLD = 0.8
#: Buckets of the word counts that rarity is read from.
BUCKETS = 1 << 19
#: Words beyond which a line's signature has 128 bits instead of 64.
LONG = 64
#: Columns of the signature.
BITS = ("bits", "more")
#: The most common sets of words, of which only the first line joins.
COMMON = 50_000
#: Words in a key.
KEY_WORDS = 3


def _ceil(x: Column) -> Column:
    return F.ceil(x - F.lit(1e-9)).cast("int")


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line of each line of each text; a null text has none."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def with_words(lines: DataFrame) -> DataFrame:
    """`words`, the line's distinct words as hashes, in place of `line`; most lines without words go."""
    odd = reduce(Column.__or__, [F.col("line").contains(c) for c in "\t\r\x0b\f"])
    # splitting by one character takes no regular expression
    words = F.when(odd, F.split(F.lower("line"), r"[ \t\r\x0B\f]+")).otherwise(F.split(F.lower("line"), " "))
    hashed = F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # a filter on the words would hash every line twice
    return lines.where(F.trim("line") != "").select("doc_id", "line_no", hashed.alias("words"))


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(docs: DataFrame) -> bytes:
    """For each bucket a byte under 128: the logarithm of its words' count over all texts, in steps of a quarter of a doubling; 1 for a count of one."""
    text = F.lower("text")
    for c in "\n\t\r\x0b\f":
        text = F.when(F.col("text").contains(c), F.replace(text, F.lit(c), F.lit(" "))).otherwise(text) if c != "\n" else F.replace(text, F.lit(c), F.lit(" "))
    words = docs.select(F.explode(F.split(text, " ")).alias("w")).where("w != ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    levels = counts.select("b", F.least(F.lit(127), F.floor(F.log2("count") * 4) + 1).cast("int").alias("level")).toPandas()
    out = np.zeros(BUCKETS, np.uint8)
    out[levels.b.to_numpy()] = levels.level.to_numpy()
    return out.tobytes()


def _signature(words: Column, n: Column) -> list[Column]:
    """bits: the parities of the words on each of 64 bits; more: the same of every other word by hash, for lines of more than LONG words (else 0)."""
    place = lambda w: w.bitwiseAND(F.lit(63)).cast("int")
    left, zero = (lambda x, k: F.call_function("shiftleft", x, k)), F.lit(0).cast("bigint")
    bits = F.aggregate(words, zero, lambda a, w: a.bitwiseXOR(left(F.lit(1).cast("bigint"), place(w))))
    more = F.aggregate(words, zero, lambda a, w: a.bitwiseXOR(left(F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(1)), place(w))))
    return [bits.alias("bits"), F.when(n > LONG, more).otherwise(zero).alias("more")]


def _keys(hashes: Column, n: Column) -> Column:
    """Hashes of the KEY_WORDS first and last words by hash, and by the hash with its halves swapped."""
    last = F.greatest(n - KEY_WORDS + 1, F.lit(1))
    turned = F.transform(hashes, lambda w: F.call_function("shiftleft", w, F.lit(32)).bitwiseOR(F.shiftrightunsigned(w, 32)))
    ends = [F.slice(F.sort_array(x), at, KEY_WORDS) for x in (hashes, turned) for at in (F.lit(1), last)]
    return F.array(*[F.xxhash64(F.lit(k), e) for k, e in enumerate(ends)])


def line_table(docs: DataFrame, threshold: float) -> DataFrame:
    """A row for each line with words: its place, size n, signature, name of its set (s1, s2), keys, and prefix, rarest first.

    A word in the prefix is its rarity in the first byte, and 56 bits of its hash.
    """
    docs = docs.select("doc_id", "text")
    levels = F.lit(rarity(docs))
    level = lambda h: F.ascii(F.substring(levels, _bucket(h) + 1, F.lit(1)).cast("string")).cast("bigint")
    ranked = F.transform("words", lambda w: F.call_function("shiftleft", level(w), F.lit(56)).bitwiseOR(F.shiftrightunsigned(w, 8)))
    n = F.size("words")
    rows = with_words(split_lines(docs)).withColumn("keys", _keys(F.col("words"), n)).withColumn("words", F.sort_array(ranked))
    return materialize(
        rows.select(
            F.struct("doc_id", "line_no").alias("at"), n.alias("n"), *_signature(F.col("words"), n), F.xxhash64("words").alias("s1"), F.xxhash64(F.lit(7), "words").alias("s2"),
            "keys", F.slice("words", F.lit(1), n - _ceil(n * threshold) + 1).alias("prefix"),
        ),
        "lines",
    )


def _near(a: str, b: str, t: float) -> tuple[Column, Column]:
    """The overlap that lines a and b need, and whether lengths and signatures leave it possible."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = _ceil((n_a + n_b) * (t / (1 + t)))
    far = n_a + n_b - 2 * need
    folded = F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))
    half = F.col(f"{a}.more").bitwiseXOR(F.col(f"{b}.more"))
    apart = F.bit_count(half) + F.bit_count(half.bitwiseXOR(folded))
    return need, (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * t - 1e-9) & (F.bit_count(folded) <= far) & ((F.least(n_a, n_b) <= LONG) | (apart <= far))


def first_witnesses(joining: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """Places (at) of lines that are similar to the first line of one of their keys."""
    keyed = joining.select(F.explode("keys").alias("k"), "at", "n", *BITS)
    first = keyed.groupBy("k").agg(F.min(F.struct("at", "n", *BITS)).alias("f"), F.count("*").alias("c")).where("c > 1").select("k", "f.*")
    pairs = keyed.alias("a").hint("merge").join(first.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.at") > F.col("b.at")) & _near("a", "b", t)[1])
    pairs = materialize(pairs.select(F.col("a.at").alias("x"), F.col("b.at").alias("y")).distinct(), "first-pairs")
    return _verified(docs, pairs, t, many=True)


def left_open(joining: DataFrame, found: DataFrame) -> DataFrame:
    """The lines that join, as a table without keys; open: not found yet."""
    rows = joining.select("at", "n", *BITS, "prefix").hint("merge").join(found.select("at", F.lit(True).alias("found")), "at", "left")
    return materialize(rows.select("at.*", "n", *BITS, F.col("found").isNull().alias("open"), "prefix"), "open-lines")


def other_witnesses(rows: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """Places (at) of open lines of left_open() that are similar to some line before them."""
    n, i = F.col("n"), F.col("i")
    # left: the words from this one on; negative beyond the prefix that is enough among sets of this size or more, which the smaller set of a pair needs
    short = i <= n - _ceil(n * (2 * t / (1 + t)))
    prefix = rows.select("doc_id", "line_no", "n", *BITS, "open", F.posexplode("prefix").alias("i", "w"))
    prefix = prefix.where(F.shiftright("w", 56) != 1)  # a word that is there once has no partner
    prefix = prefix.select("w", "doc_id", "line_no", "n", *BITS, "open", F.when(short, n - i).otherwise(i - n).alias("left"))
    a, b = prefix.alias("a"), prefix.alias("b")
    n_a, n_b, line = F.col("a.n"), F.col("b.n"), F.col("a.line_no") > F.col("b.line_no")
    # a null doc_id comes before all others
    after = F.when(F.col("b.doc_id").isNull(), F.col("a.doc_id").isNotNull() | line).when(F.col("a.doc_id").isNull(), False)
    after = after.otherwise((F.col("a.doc_id") > F.col("b.doc_id")) | ((F.col("a.doc_id") == F.col("b.doc_id")) & line))
    need, near = _near("a", "b", t)
    # conditions on one side alone are tied to the other, so that both sides stay the same rows, which are shuffled once; most rows of a word differ
    # too much in length, so that comes first
    pairs = a.hint("merge").join(
        b,
        (F.col("a.w") == F.col("b.w"))
        & F.when(n_a >= n_b, F.col("b.left") > 0).otherwise(False)
        & (n_a * t <= n_b + 1e-9)
        # the words before these aren't in common, or an earlier one was met elsewhere
        & (F.least(F.abs("a.left"), F.col("b.left")) >= need)
        & near
        & ((n_a > n_b) | after)
        & F.when(after, F.col("a.open")).otherwise(F.col("b.open")),
    )
    place = lambda k: F.struct(f"{k}.doc_id", f"{k}.line_no")
    pairs = pairs.select(F.greatest(place("a"), place("b")).alias("x"), F.least(place("a"), place("b")).alias("y"))
    pairs = materialize(pairs.distinct(), "line-pairs")
    return _verified(docs, pairs, t)


def find_similar(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of each line that has a similar one before it.

    Rows with a null doc_id come before all others. Repeated rows of one doc_id count as one place: neither removes
    the other's lines.
    """
    stored = line_table(docs, threshold)
    table = stored.where("n > 0")  # the others have no words
    same = table.groupBy("s1", "s2").agg(F.min("at").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    same = materialize(same, "line-copies")
    copies = materialize(table.select("s1", "s2", "at").hint("merge").join(same.select("s1", "s2", "first"), ["s1", "s2"]).where("at > first").select("at"), "later-copies")

    common = same.orderBy(F.desc("copies"), "s1", "s2").limit(COMMON).select("s1", "s2", "first")
    joining = table.join(F.broadcast(common), ["s1", "s2"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("at")))
    first = first_witnesses(joining, docs, threshold)
    rows = left_open(joining, first)
    release(stored, same)
    rest = other_witnesses(rows, docs, threshold)
    out = materialize(copies.unionByName(first).unionByName(rest).distinct().select("at.*"), "similar-lines")
    release(rows, copies, first, rest)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float, many: bool = False) -> DataFrame:
    """Places (at) of lines x whose full sets are similar enough to that of some y. Only the lines named in pairs are read into sets again; many: most texts hold some."""
    # a line in many pairs is one place before the two sides meet
    places = pairs.select(F.col("x").alias("at")).distinct().union(pairs.select(F.col("y").alias("at")).distinct())
    ids = materialize(places.groupBy(F.col("at.doc_id").alias("id")).agg(F.collect_set("at.line_no").alias("wanted")), "line-docs")
    texts = docs.select("doc_id", "text").where("text is not null")
    # the same plan at every size
    few = (texts.hint("merge") if many else texts).join(ids, F.col("doc_id").eqNullSafe(F.col("id")))
    # a text is split once (as the variable of a lambda), and only what is wanted of it becomes rows
    chosen = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.get(lines, i).alias("line"))))
    split = few.select("doc_id", F.inline(F.get(chosen, F.lit(0)))).where("line is not null")
    # rows that share a doc_id may have different lines at one place: each of them is verified
    lines = materialize(with_words(split).select(F.struct("doc_id", "line_no").alias("at"), "words").distinct(), "line-words")
    x, y = (lines.select(F.col("at").alias(k), F.col("words").alias(f"w{k}")) for k in "xy")
    common = F.size(F.array_intersect("wx", "wy"))
    # the same plan at every size
    similar = pairs.hint("merge").join(x, "x").hint("merge").join(y, "y").where(common >= (F.size("wx") + F.size("wy") - common) * threshold - 1e-9)
    out = materialize(similar.select(F.col("x").alias("at")).distinct(), "similar")
    release(pairs, ids, lines)
    return out


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's doc_id, n_lines, n_removed, and removed: the numbers of the lines that go, comma-joined.

    Null texts have no lines, empty texts one without words. An empty table gives an empty result; other columns take
    no part. A line goes by its place, so rows that repeat a doc_id get the same answer. Rows whose doc_id is null
    share one place as well.
    """
    gone = find_similar(docs, threshold).groupBy(F.col("doc_id").alias("gone_id")).agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("gone", lambda i: i.cast("string")), ","), F.lit("")).alias("removed"),
    )


@own_columns
def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, in their own columns (of any names), with the later ones of similar lines taken out of the texts.

    Rows that share a doc_id lose the same lines, whatever their order: those at which any of the rows has a similar line.
    """
    gone = find_similar(docs, threshold).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.transform(
        F.array(F.split("text", "\n")),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)), "\n"),
    )
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(kept, F.lit(0)))).select(docs.columns)
