"""Vector codes, collocations and BPE: each against brute force or the tokenizers library, and edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest

from tidewatch.llm import heap_lloyd, lexicon, phrases

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def brute_codes(rows, parts=16, entries=64, scale=256, rounds=2):
    """rows (id, vector, label): every part against every entry in every round."""
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0], list(r[1])))
    x = np.floor(scale * np.array([r[1] for r in kept], float)).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: np.array([((x[:, p, None] - books[p]) ** 2).sum(-1).argmin(1) for p in range(parts)])
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in set(own[p]):
                m = own[p] == e
                books[p, e] = np.floor_divide(x[m, p].sum(0), m.sum())
    own = assign()
    error = sum(((x[:, p] - books[p][own[p]]) ** 2).sum(-1) for p in range(parts)).tolist()
    by_label, sha = defaultdict(int), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] += e
    return sorted((r[0], "".join(f"{own[p, k]:02x}" for p in range(parts)), error[k], by_label[r[2]], sha) for k, r in enumerate(kept))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, code string")


def codes(df):
    return sorted(tuple(r) for r in df.collect())


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    spread = rng.normal(0, 1, (300, 32)) + 6 * rng.integers(0, 5, (300, 1))
    rows = [(int(i), list(map(float, v)), int(i) % 3 if i % 7 else None) for i, v in zip(rng.permutation(300), spread, strict=True)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)] + [(rows[5][0], rows[5][1], 2)]  # a third are copies, one row is repeated
    want = brute_codes(rows)
    dropped = [(2000, None, 1), (2001, [float("nan")] * 32, 1), (2002, [1.0] * 31 + [None], None), (2003, [float("inf")] * 32, 0)]
    assert codes(heap_lloyd.digest(vectors(spark, rows + dropped))) == want
    for rounds in (0, 1, 6):
        assert codes(heap_lloyd.digest(vectors(spark, rows), rounds=rounds)) == brute_codes(rows, rounds=rounds)
    wide = [(i, [1e4 * x for x in v], k) for i, v, k in rows]  # past 53 bits, so in integers
    assert codes(heap_lloyd.digest(vectors(spark, wide))) == brute_codes(wide)
    with pytest.raises(Exception, match="63 bits"):
        heap_lloyd.encode(vectors(spark, [(1, [1e300] * 32, 1)]))


def test_vector_codes_of_few_and_no_rows(spark):
    few = [(2, [0.5] * 16, None), (1, [0.25] * 16, None)]
    assert codes(heap_lloyd.digest(vectors(spark, few))) == brute_codes(few)
    assert codes(heap_lloyd.digest(vectors(spark, []))) == []
    odd = [*few, (3, [1.0] * 17, 1), (4, [], 1)]  # no equal parts
    assert codes(heap_lloyd.digest(vectors(spark, odd))) == brute_codes(few)


def test_heaps_leave_safe_parts_alone(spark):
    """Well parted clusters: later assignments compare few parts again, and the codes are those of a full search."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 50, (64, 16))
    rows = [(i, list(map(float, centres[i % 64] + rng.normal(0, 0.05, 16))), 0) for i in range(1280)]
    found = heap_lloyd.encode(vectors(spark, rows))
    assert sum(found.rescanned) < 0.2 * 2 * 16 * len(rows)
    assert codes(heap_lloyd.digest(vectors(spark, rows))) == brute_codes(rows)


def test_heaps():
    own, key = np.array([1, 0, 1, 1]), np.array([3.0, 9.0, 1.0, 2.0], np.float32)
    h = heap_lloyd.Heaps.build(own, key, 3)
    assert h.pop_violated(np.array([8.9, 2.0, 0.0])) == [2, 3]
    h.push(2, 0.5, 2)
    key, row, starts = h.arrays()
    assert (key.tolist(), row.tolist(), starts.tolist()) == ([9.0, 3.0, 0.5], [1, 0, 2], [0, 1, 2, 3])


def brute_phrases(rows, least, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n, some = sum(v for p, v in c.items() if len(p) == 1), {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items()):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    bag = ["new", "york", "city", "of", "the", "Ünï", "x\x0by", "a.b", "end!", "e\tf"]
    rows = [(["en", "de", None][k % 3], " ".join(rng.choice(bag, 30))) for k in range(40)]
    rows += [("en", "san francisco bay area, san francisco")] * 9 + [("en", None), ("de", ""), (None, " \n. "), ("zz", "only once")]
    rows += [("en", "one very long text of new york\n" * 4000)]
    df = spark.createDataFrame([(i, t, lang, "q") for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string")
    for least, options in ((5, {}), (30, {}), (5, {"max_cells": 64}), (300, {"depth": 3}), (5, {"top": 3})):
        got = sorted(tuple(r) for r in phrases.mine(df, least=least, **options).collect())
        assert got == brute_phrases(rows, least, options.get("top", 2000))
    assert phrases.mine(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_pieces():
    text = b"a b. " * 3_000_000
    runs = list(phrases._pieces(text.translate(phrases.PLAIN)))
    assert len(runs) > 1 and b"\n".join(runs) == text.translate(phrases.PLAIN)


TEXTS = [
    None, "", "  \n ", "Hello, WORLD's isn't they'LL 123 <|endoftext|> <|ENDOFTEXT|> <|startoftext|><|endoftext|>x", "ΑΣ Σ ΣΑΣ İstanbul naïve ﬁ Å", "中文字符 日本語🙂🙂 ​zero\x1cwidth\x00nul\x85next\xa0nbsp",
    "a" * 5000, "<|endoftext|>" * 3, "word " * 20000, "'s't're'S", "½ ² Ⅷ ٣", "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "word " * 20000,
]


def library(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_bpe_equals_the_library(spark):
    found = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()[:60]
    rows = list(enumerate(TEXTS + found)) + [(3, "a row with the id of another")]
    df = spark.createDataFrame([(i, t, "w", [1]) for i, t in rows], "doc_id bigint, text string, word string, ids array<int>")
    for words in (50_000, 40, 0):
        assert sorted(tuple(r) for r in lexicon.digest(df, VOCABULARY, words).collect()) == library(rows)
    assert lexicon.digest(df.limit(0), VOCABULARY).count() == 0


def test_bpe_of_every_block_of_letters():
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(VOCABULARY), lexicon.load_vocabulary(VOCABULARY)
    merges, split = lexicon.Merges(v["inner"], v["last"], v["pairs"]), lexicon.Splitter(v["specials"])
    for c in [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3000, 0x3400)]:
        if chr(c).isprintable() or c < 0x100:
            text = f"a{chr(c)}b {chr(c)} 1{chr(c)}2 e{chr(c)}́"
            ids = [i for w in split.one(text) for i in ([v["specials"][w]] if w in v["specials"] else merges.ids(w.encode()))]
            assert ids == t.encode(text, add_special_tokens=False).ids, hex(c)


def test_decoding_skips_what_is_no_id(spark):
    df = spark.createDataFrame([(1, "one two one", "x")], "doc_id bigint, text string, id string")
    name = lexicon.compile_lexicon(df, VOCABULARY, 10)
    ids = lexicon.encode(df, name).first().ids
    odd = spark.createDataFrame([(1, [*ids, 99999999, -1, None]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r.text for r in lexicon.decode(odd, name).orderBy("doc_id").collect()] == ["one</w> two</w> one</w>", "", ""]


def test_transducer_is_minimal_and_exact():
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 9))).encode() for _ in range(400)} | {"naïve".encode()})
    entries = [(w, tuple(len(w[:k]) % 3 for k in range(1, len(w) + 1))) for w in words]
    t = lexicon.compile_words(entries)
    asked = [*words, b"zz", b"abcabcabcabca", b"na"]
    known, starts, ids = lexicon.walk(t, asked)
    assert [bool(k) for k in known] == [w in set(words) for w in asked]
    assert [tuple(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)][: len(words)] == [o for _, o in entries]
    # no two states of the same future: finals, outputs and edges by target
    edges = defaultdict(list)
    for k, to, out in zip(t["edge_keys"], t["edge_to"], t["edge_out"], strict=True):
        edges[k >> 8].append((k & 255, to, out))
    rows = [(t["final_out"][s], tuple(edges[s])) for s in range(len(t["final_out"]))]
    assert len(set(rows)) == len(rows)
    plain = lexicon.compile_words([(w, ()) for w in (b"tapped", b"tapping", b"topped", b"topping")])
    assert len(plain["final_out"]) == 9  # 15 in a trie: both stems share their tails
    with pytest.raises(ValueError, match="order"):
        lexicon.compile_words([(b"b", ()), (b"a", ())])
    assert not lexicon.walk(lexicon.compile_words([]), [b"a"])[0].any()
