"""BPE encoding and decoding with a lexicon of frequent words, compiled into a minimal acyclic transducer.

The words of all texts are counted, and the frequent ones are merged once, on the driver. Their ids are the outputs of an automaton over UTF-8
bytes: states with equal futures are one state (shared suffixes), and an output stands at the earliest edge that settles it. The automaton, the merges and the
tokens are one file of flat arrays, which Spark hands to every executor and whose tasks map it into memory. A task walks
the distinct words of a chunk of texts through the automaton together; words that it doesn't know are merged exactly, pair by pair in the order of rank.

The vocabulary is a public tokenizer's file (lower case, white space dropped, marked word ends), read by the driver only. Parameters: its path, and
how many words are compiled; ids do not depend on the latter.

Scale: two readings of the texts; of the first, counts of words are shuffled, added up chunk by chunk before. The words that reach the driver are
bounded by `words`. Encoding and decoding shuffle nothing.
"""

from __future__ import annotations

import heapq
import json
import mmap
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, materialize, release

WORDS = 50_000
#: Words that are longer (in bytes) are left to the merges.
LONGEST = 64
#: Bytes of text in a chunk.
CHUNK = 1 << 22
#: Ids that are decoded in one go.
IDS = 1 << 20
#: Words of so many bytes are merged by scanning, longer ones with a heap.
SHORT = 48
#: Stands for a pair that does not merge; above all ranks.
NONE = (1 << 40, -1)
# Fixed values of the vocabulary's file format: what splits words, white space, the mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
END = "</w>"


# ---- texts to words ----------------------------------------------------------------------------------------------------------


class Splitter:
    """The words of tokens (what stands between ASCII blanks): normalised (NFC, lower case letter by letter) and split; special tokens are words as they stand.

    No word reaches across a blank and nothing composes with one, so texts can be cut there and each distinct token be split once. Letters and
    digits are those of the `regex` package's tables; a code point younger than the tables of another library may be split otherwise there.
    """

    def __init__(self, specials: Iterable[str]) -> None:
        self.words, specials = regex.compile(SPLIT.replace(r"\s", SPACE)), list(specials)
        self.marked = regex.compile(self.words.pattern + "|\n")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _plain(self, text: str) -> str:
        # a capital sigma is lowered without regard to its place in the word
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def one(self, token: str) -> list[str]:
        """The words of one token or text."""
        parts = self.special.split(token) if self.special else [token]
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words.findall(self._plain(part)))]

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, list[str]]:
        """How many words each token has, and all of them in order. Letters a-z alone are a word; the rest is split in one go, with line feeds between tokens."""
        out: list[list[str] | None] = [[t.lower()] if t.isascii() and t.isalpha() else None for t in tokens]
        rest = [i for i, w in enumerate(out) if w is None]
        text = "\n".join([tokens[i] for i in rest])
        if self.special and self.special.search(text):
            for i in rest:
                out[i] = self.one(tokens[i])
        elif rest:
            words, at = [*self.marked.findall(self._plain(text)), "\n"], 0
            for i in rest:
                end = words.index("\n", at)
                out[i] = words[at:end]
                at = end + 1
        return np.array([len(w) for w in out], np.int64), list(chain.from_iterable(out))


# ---- the vocabulary ----------------------------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Merges:
    """Ids of words by merging pairs in the order of rank."""

    def __init__(self, inner: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> None:
        self.inner, self.last = inner.tolist(), last.tolist()
        self.pairs = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(pairs.tolist())}

    def ids(self, word: bytes) -> list[int]:
        """The leftmost pair of the lowest rank is merged until there is none."""
        at, get = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]], self.pairs.get
        if len(at) > SHORT:
            return self._long(at)
        ranks = [get(p, NONE) for p in zip(at, at[1:], strict=False)]
        while ranks and (low := min(ranks)) is not NONE:
            i = ranks.index(low)
            at[i : i + 2] = [low[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((low[1], at[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((at[i - 1], low[1]), NONE)
        return at

    def _long(self, at: list[int]) -> list[int]:
        """The same by a heap of pairs and links between neighbours, in n log n steps."""
        n, get = len(at), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        waiting = [(*p, i, at[i], at[i + 1]) for i in range(n - 1) if (p := get((at[i], at[i + 1])))]
        heapq.heapify(waiting)
        gone = [False] * n
        while waiting:
            _, new, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if gone[i] or at[i] != a or j < 0 or at[j] != b:
                continue
            at[i], gone[j], after[i] = new, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if p := get((new, at[after[i]])):
                    heapq.heappush(waiting, (*p, i, new, at[after[i]]))
            if before[i] >= 0 and (p := get((at[before[i]], new))):
                heapq.heappush(waiting, (*p, before[i], at[before[i]], new))
        return [x for x, g in zip(at, gone, strict=True) if not g]


def load_vocabulary(path: str) -> dict:
    """Arrays of the vocabulary: ids of bytes within and at the end of a word, pairs (a, b, a + b) by rank, tokens by id, special tokens."""
    raw = json.loads(Path(path).read_text())
    model, letters = raw["model"], byte_letters()
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
        raise ValueError(f"{path} holds no BPE vocabulary with word ends marked {END}")
    ids = model["vocab"]
    specials = {t["content"]: t["id"] for t in raw["added_tokens"]}
    tokens = {i: t for t, i in ids.items()} | {i: t for t, i in specials.items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "inner": np.array([ids[c] for c in letters], np.int32), "last": np.array([ids[c + END] for c in letters], np.int32),
        "pairs": np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int32).reshape(-1, 3), "tokens": [tokens.get(i, "") for i in range(max(tokens) + 1)], "specials": specials,
    }


# ---- the transducer ----------------------------------------------------------------------------------------------------------


class _State:
    __slots__ = ("edges", "final", "number", "rest")

    def __init__(self) -> None:
        #: byte: [target, output]; rest: output at the end of a word that ends here
        self.edges, self.final, self.rest, self.number = {}, False, (), -1

    def key(self) -> tuple:
        return self.final, self.rest, tuple((b, id(t), o) for b, (t, o) in self.edges.items())


def _shared(a: tuple, b: tuple) -> tuple:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def compile_words(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The minimal transducer of distinct words in the order of their bytes, with id sequences as outputs, as flat arrays.

    edge_keys (state * 256 + byte, ascending), edge_to, edge_out, final_out (-1: no word ends there), out_starts and out_ids; output 0 is empty, state 0 the start.
    A word's branch is settled when the next one leaves it: states whose futures and outputs equal those of a settled one are replaced by it.
    """
    start, settled, path, last = _State(), {}, [], b""
    path = [start]

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            child = path.pop()
            edge = path[-1].edges[last[len(path) - 1]]
            edge[0] = settled.setdefault(child.key(), child)

    for word, out in entries:
        if not word or word <= last and (last or start.final):
            raise ValueError("words must be distinct, not empty, and in order")
        common = len(_shared(tuple(word), tuple(last)))
        settle(common)
        for b in word[common:]:
            path[-1].edges[b] = [nxt := _State(), ()]
            path.append(nxt)
        path[-1].final = True
        # along the shared branch, keep what both have and push the rest of the older outputs down
        for i in range(common):
            edge, below = path[i].edges[word[i]], path[i + 1]
            keep = _shared(edge[1], out)
            if rest := edge[1][len(keep) :]:
                for e in below.edges.values():
                    e[1] = rest + e[1]
                if below.final:
                    below.rest = rest + below.rest
            edge[1], out = keep, out[len(keep) :]
        path[common].edges[word[common]][1] = out
        last = word
    settle(0)

    outs, order = {(): 0}, [start]
    start.number = 0
    for s in order:  # grows while it is read
        for t, _ in s.edges.values():
            if t.number < 0:
                t.number = len(order)
                order.append(t)
    number = lambda o: outs.setdefault(o, len(outs))
    edges = sorted((s.number << 8 | b, t.number, number(o)) for s in order for b, (t, o) in s.edges.items())
    finals = [number(s.rest) if s.final else -1 for s in order]
    keys, to, out = (np.array(x) for x in zip(*edges, strict=True)) if edges else (np.empty(0, int),) * 3
    return {
        "edge_keys": keys.astype(np.int64), "edge_to": to.astype(np.int32), "edge_out": out.astype(np.int32), "final_out": np.array(finals, np.int32),
        "out_starts": np.cumsum([0, *map(len, outs)]).astype(np.int32), "out_ids": np.array([i for o in outs for i in o], np.int32),
    }


def ragged(starts: np.ndarray, values: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `take` of a ragged array, one after the other, and their lengths."""
    n = (starts[1:] - starts[:-1])[take].astype(np.int64)
    ends = np.cumsum(n)
    return values[np.repeat(starts[take] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def walk(t: dict[str, np.ndarray], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words the transducer knows, and their ids as a ragged array (none for the others). All words go through together, byte by byte."""
    size = np.array([len(w) for w in words], np.int64)
    starts, data = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
    state, alive = np.zeros(len(words), np.int64), np.arange(len(words))
    known, place, outs, step, keys = np.zeros(len(words), bool), [], [], 0, t["edge_keys"]
    while len(alive):
        ends = size[alive] == step
        final = t["final_out"][state[ends]]
        done = alive[ends][final >= 0]
        known[done] = True
        place.append(done)
        outs.append(final[final >= 0])
        alive, state = alive[~ends], state[~ends]
        if not len(alive) or not len(keys):
            break
        want = state << 8 | data[starts[alive] + step]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        ok = keys[at] == want
        alive, at = alive[ok], at[ok]
        state = t["edge_to"][at].astype(np.int64)
        place.append(alive)
        outs.append(t["edge_out"][at])
        step += 1
    place, outs = np.concatenate(place or [np.empty(0, np.int64)]), np.concatenate(outs or [np.empty(0, np.int32)])
    some = (outs != 0) & known[place]
    place, outs = place[some], outs[some]
    order = np.argsort(place, kind="stable")
    place, outs = place[order], outs[order]
    ids, n = ragged(t["out_starts"], t["out_ids"], outs)
    counts = np.bincount(np.repeat(place, n), minlength=len(words))
    return known, np.concatenate(([0], np.cumsum(counts))), ids


# ---- the file that tasks map -------------------------------------------------------------------------------------------------


def write_arrays(path: str, arrays: dict[str, np.ndarray], names: dict) -> None:
    """A line of JSON (where each array lies, and names), then the arrays."""
    at, said = 0, {}
    for k, a in arrays.items():
        said[k] = [at, str(a.dtype), a.shape]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"arrays": said, "names": names}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))


def map_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays of the file as views of its memory-mapped pages, which all tasks of a machine share."""
    with open(path, "rb") as f:
        pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = f.readline()
    said = json.loads(head)
    view = lambda at, kind, shape: np.frombuffer(pages, kind, int(np.prod(shape)), len(head) + at).reshape(shape)
    return {k: view(*v) for k, v in said["arrays"].items()}, said["names"]


class Codec:
    """A compiled lexicon on an executor."""

    _open: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        self.arrays, names = map_arrays(path)
        self.specials, self.tokens = names["specials"], pa.array(names["tokens"], pa.string())
        self.split = Splitter(self.specials)
        self.merges = Merges(self.arrays["inner"], self.arrays["last"], self.arrays["pairs"])

    @classmethod
    def of(cls, name: str) -> Codec:
        if name not in cls._open:
            cls._open[name] = cls(SparkFiles.get(name))
        return cls._open[name]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words as a ragged array: by the transducer, or by merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        known, starts, ids = walk(self.arrays, raw)
        n = np.diff(starts)
        if known.all():
            return starts, ids
        rest = [[self.specials[w]] if (w := words[i]) in self.specials else self.merges.ids(raw[i]) for i in np.flatnonzero(~known)]
        n[~known] = [len(x) for x in rest]
        starts = np.concatenate(([0], np.cumsum(n)))
        out = np.empty(starts[-1], np.int32)
        own = np.repeat(known, n)
        out[own], out[~own] = ids, list(chain.from_iterable(rest))
        return starts, out

    def encode(self, texts: pa.Array) -> pa.Array:
        """Distinct tokens are split, their distinct words looked up, and both spread over the texts again."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        tokens = lists.flatten().dictionary_encode()
        per_token, words = self.split(tokens.dictionary.to_pylist())
        coded = pa.array(words, pa.string()).dictionary_encode()
        starts, ids = self.word_ids(coded.dictionary.to_pylist())
        ids, n = ragged(starts, ids, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_token)))]
        ids, n = ragged(starts, ids, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _parts(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of rows of about `size` in all, from the rows' cumulated sizes; a larger row is a run of its own."""
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, stop - at
        at = stop


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes of text."""
    return _parts(np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), CHUNK)


# ---- Spark -------------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, specials: Iterable[str], text: str = "text") -> DataFrame:
    """word, n over all texts; special tokens are no words."""
    specials = list(specials)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(specials)
        for batch in batches:
            for at, n in _slices(batch.column(0)):
                found = pc.ascii_split_whitespace(pc.fill_null(batch.column(0).slice(at, n), "")).flatten().value_counts()
                per, words = split(found.field(0).to_pylist())
                coded = pa.array(words, pa.string()).dictionary_encode()
                total = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.repeat(found.field(1).to_numpy(), per), len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(total.astype(np.int64))], ["word", "n"])

    counts = arrow(docs.select(text), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(~F.col("word").isin(specials)) if specials else counts


def compile_lexicon(docs: DataFrame, path: str, words: int = WORDS, text: str = "text") -> str:
    """Compiles the most frequent words of the texts (ties by word) and hands the file to all executors; returns its name there."""
    vocabulary = load_vocabulary(path)
    merges = Merges(vocabulary["inner"], vocabulary["last"], vocabulary["pairs"])
    counts = materialize(word_counts(docs, vocabulary["specials"], text).where(F.octet_length("word") <= LONGEST), "lexicon-counts")
    # words by the power of two of their count: what lies below the power at which there are enough is not sorted
    sizes, some, least = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()}, 0, 0
    for power in sorted(sizes, reverse=True):
        some, least = some + sizes[power], 1 << power
        if some >= words:
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words)
    found = sorted(r.word.encode() for r in top.select("word").collect())  # `words` rows at most
    release(counts)
    arrays = compile_words((w, tuple(merges.ids(w))) for w in found)
    return ship_arrays(docs.sparkSession, arrays | {k: vocabulary[k] for k in ("inner", "last", "pairs")}, {k: vocabulary[k] for k in ("specials", "tokens")})


def ship_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], names: dict) -> str:
    """Writes the file on the driver and adds it to the application; executors, later ones too, fetch it from there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = Path(tempfile.mkdtemp(prefix="lexicon-")) / name
    write_arrays(str(path), arrays, names)
    spark.sparkContext.addFile(str(path))
    return name


def encode(docs: DataFrame, lexicon: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col and ids (array of int) of each row, whole texts; a null text has no ids. Repeated rows and ids are kept as they are.

    Other columns take no part, whatever they are called. Long texts are split like others; a single word of any length is merged in n log n steps.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(lexicon)
        for batch in batches:
            for at, n in _slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), codec.encode(batch.column(1).slice(at, n))], ["id", "ids"])

    return arrow(docs.select(id_col, text), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, lexicon: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and text: the tokens of the ids, special ones too, joined by blanks (the vocabulary has no decoder of its own); no ids, or null, give an empty text.

    An id outside the vocabulary is skipped.
    """
    kind = dict(coded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(lexicon)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for at, n in _parts(np.cumsum(sizes.astype(np.int64)), IDS):
                ids = pc.fill_null(batch.column(1).slice(at, n), [])
                flat = ids.flatten()
                ok = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(codec.tokens))), False)
                before = np.concatenate(([0], np.cumsum(ok.to_numpy(zero_copy_only=False))))
                ends = before[np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))))]
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), codec.tokens.take(flat.filter(ok)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pc.binary_join(tokens, " ")], ["id", "text"])

    return arrow(coded.select(id_col, "ids"), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as decimal numbers, joined by a blank) and decoded_sha256 (of the decoded text) of each row."""
    lexicon = compile_lexicon(docs, path, words)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.struct("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha(F.array_join("ids", " ")).alias("ids_sha256"))
    coded = encode(docs, lexicon).select(said.alias("said"), "ids")
    return decode(coded, lexicon, "said").select("said.*", sha(F.col("text")).alias("decoded_sha256"))
