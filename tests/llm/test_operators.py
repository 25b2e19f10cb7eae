"""Corpus operators: edge cases, and each query against brute force on small tables."""

import hashlib
import os
import re
import timeit
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from tidewatch.llm import common, decontaminate, jaccard, language_id, line_dedup, mixing, nearest, pii, quality, sharding, warc
from tidewatch.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, shard int, spans string"
LONG = " ".join(f"w{i}" for i in range(4000))
P1 = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
EDGE = [
    (1, P1, "en", "a"), (2, P1, "en", "a"), (2, P1, "en", "a"), (3, P1.upper() + " omicron", None, None), (4, None, "en", "a"), (5, "", "de", "b"), (6, "   \n\n ", "de", "b"),
    (7, LONG, "en", "b"), (8, LONG + " tail", "en", "b"), (9, "1234 !!", "en", "a"), (10, "one two", "en", "a"), (11, "ONE two", "en", "c"), (None, P1, "en", "a"),
    (12, "Line of words one two three four five\nother thing entirely here now\nline of words one two three four five", "en", "c"), (13, "line of words one two three four five six", "en", "c"),
]


def docs(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0, 0, "x") for i, t, lang, s in rows], DOCS)


def table(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pandas()


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if t else []


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if t else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets, root = [(i, shingles(t)) for i, t in rows], {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, s in sets)


def brute_hits(text, items, window=10):
    w, hit, ids = words(text), set(), set()
    for k, t in items:
        v = words(t)
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add(str(k))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination(spark):
    items = [(1, P1), (2, "one two"), (3, None), (4, ""), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda sigma"), (2, "two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(str, (brute_hits(t, items) for _, t, _, _ in EDGE)))
    for block in (200_000, 3):  # one block, and one item or so in each of several
        got = decontaminate.digest(decontaminate.find_hits(docs(spark).select("doc_id", "text"), bench, block_words=block)).toPandas()
        assert sorted(str(tuple(r)) for r in got[["n_words", "n_hit", "n_items", "items_sha256"]].itertuples(index=False, name=None)) == want
    kept = decontaminate.decontaminate(docs(spark), bench)
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9}
    cut = decontaminate.decontaminate(docs(spark, [(1, "zzz " + P1 + " end", "en", "a")]), bench, max_coverage=0.95).first()
    assert cut.text.split() == ["zzz", "end"]
    assert decontaminate.find_hits(docs(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(docs(spark), bench.limit(0)).count() == len(EDGE)


def test_decontamination_query(spark):
    items = list(table("benchmark")[["item_id", "text"]].itertuples(index=False, name=None))
    got = Q.op1_decontamination(spark, SF).toPandas().set_index("doc_id")
    for i, t in table("documents")[["doc_id", "text"]].itertuples(index=False, name=None):
        assert tuple(got.loc[i, ["n_words", "n_hit", "n_items", "items_sha256"]]) == brute_hits(t, items)


def brute_lines(rows, t=line_dedup.THRESHOLD):
    lines = [(-1 if i is None else i, n, frozenset(re.split(r"[ \t\r\x0b\f]+", x.lower())) - {""}) for i, text in rows if text is not None for n, x in enumerate(text.split("\n"))]
    lines = sorted({(i, n, s) for i, n, s in lines if s}, key=lambda x: x[:2])
    gone = set()
    by = defaultdict(set)
    for k, (i, n, s) in enumerate(lines):
        near = {j for w in s for j in by[w]}
        if any(lines[j][:2] < (i, n) and len(s & lines[j][2]) >= t * len(s | lines[j][2]) - 1e-9 for j in near):
            gone.add((i, n))
        for w in s:
            by[w].add(k)
    return gone


def test_line_dedup(spark):
    got = line_dedup.removed_lines(docs(spark)).toPandas()
    found = {(-1 if pd.isna(r.doc_id) else int(r.doc_id), int(n)) for r in got.itertuples() for n in r.removed.split(",") if n}
    assert found == brute_lines([(i, t) for i, t, _, _ in EDGE]) and len(got) == len(EDGE)
    assert (12, 2) in found and (13, 0) in found
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark)).collect()}
    assert clean[12].count("\n") == 1 and clean[4] is None
    assert line_dedup.removed_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("common_sets", [50_000, 1])
def test_line_dedup_in_a_group_of_near_copies(spark, monkeypatch, common_sets):
    monkeypatch.setattr(line_dedup, "COMMON", common_sets)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(120):
        lines = []
        for n in (3, 8, 12, 25, 90):  # the last with the longer signature
            w = base[:n] + ["the", "of"]
            for k in rng.choice(n, rng.integers(0, 1 + n // 5), replace=False):
                w[k] = f"x{rng.integers(0, 40)}"
            lines.append(" ".join(w))
        rows.append((int(rng.integers(0, 100)) if i % 7 else None, "\n".join(lines), "en", "a"))
    by_id = {i: t for i, t, _, _ in rows}
    rows = [(i, t, "en", "a") for i, t in by_id.items()]
    got = line_dedup.removed_lines(docs(spark, rows)).toPandas()
    found = {(-1 if pd.isna(r.doc_id) else int(r.doc_id), int(n)) for r in got.itertuples() for n in r.removed.split(",") if n}
    assert found == brute_lines([(i, t) for i, t, _, _ in rows])


def test_line_dedup_holds_one_table_of_lines_and_no_pairs_of_places(spark, monkeypatch):
    stored, seen = {}, {}

    def materialize(df, name):
        seen[name] = df._jdf.queryExecution().toString()
        if name == "line-pairs":
            seen["lines kept"] = os.path.exists(stored["lines"].stored_at.removeprefix("file:"))
        stored[name] = common.materialize(df, name)
        return stored[name]

    monkeypatch.setattr(line_dedup, "materialize", materialize)
    rows = [(i, f"one two three four five six seven eight nine w{i % 7}\nother words in line {i}", "en", "a") for i in range(60)]
    assert line_dedup.removed_lines(docs(spark, rows)).where("n_removed > 0").count() == 59
    assert seen["lines kept"] is False and "prefix" in stored["open-lines"].columns and "keys" not in stored["open-lines"].columns
    assert "explode(array(x" not in seen["line-docs"]  # pairs are not laid out before their places meet


def test_line_dedup_query(spark):
    got = Q.op2_line_dedup(spark, SF).toPandas()
    found = {(r.doc_id, int(n)) for r in got.itertuples() for n in r.removed.split(",") if n}
    assert found == brute_lines(list(table("documents")[["doc_id", "text"]].itertuples(index=False, name=None)))


def test_mixing(spark):
    rows = [(i, f"word{i % 7} common text here", "en" if i % 3 else "de", "big" if i % 4 else "small") for i in range(400)]
    want = {"source": {"big": 0.5, "small": 0.5}}
    got = mixing.draw(docs(spark, rows), want).toPandas()
    share = (got.tokens * got.p).groupby(got.source).sum()
    assert share["big"] / share.sum() == pytest.approx(0.5, abs=1e-6) and got.p.max() == 1.0 and len(got) == 400
    forced = mixing.draw(docs(spark, rows), None, max_cells=1).toPandas()  # the loop over tables
    plain = mixing.draw(docs(spark, rows)).toPandas()
    assert np.allclose(forced.sort_values("doc_id").p, plain.sort_values("doc_id").p, atol=1e-6)
    edge = mixing.draw(docs(spark)).toPandas()
    assert len(edge) == len(EDGE) and edge.loc[edge.doc_id == 4, "sampled"].all()
    assert mixing.mix(docs(spark)).count() == edge.sampled.sum()
    assert mixing.draw(docs(spark, [])).count() == 0


def _kept(drawn):
    return (drawn.tokens * drawn.p).sum() / drawn.tokens.sum()


@pytest.mark.parametrize(("max_cells", "langs"), [(mixing.MAX_CELLS, ("en", "xx")), (1, ("en",))])
def test_mixing_keeps_the_corpus_beside_a_rare_source(spark, max_cells, langs):
    rows = [(i, f"word{i % 8} common text here", ("en", "de", "fr", "es")[i // 7 % 4], "s0" if i % 3 == 0 else f"s{1 + i % 10}") for i in range(5000)]
    plain = _kept(mixing.draw(docs(spark, rows), max_cells=max_cells).toPandas())
    for lang in langs:
        got = mixing.draw(docs(spark, [*rows, (5000, "word0 common text here", lang, "tiny")]), max_cells=max_cells).toPandas()
        assert _kept(got) >= 1 / 4 and (lang != "en" or _kept(got) == pytest.approx(plain, abs=0.01))
        weights = got.groupby("source").p.mean()
        assert weights["tiny"] > weights["s0"] and got.p.min() >= 1 / 4 - 1e-6


def test_mixing_over_tables_meets_given_targets(spark):
    rows = [(i, f"word{i % 7} common text here", "en" if i % 3 else None, "big" if i % 4 else "small") for i in range(400)]
    want = {"source": {"big": 1, "small": 3, "absent": 5}, "lang": {"en": 0.2, None: 0.8}}
    forced = mixing.draw(docs(spark, rows), want, max_cells=1).toPandas().sort_values("doc_id")
    plain = mixing.draw(docs(spark, rows), want).toPandas().sort_values("doc_id")
    assert np.allclose(forced.p, plain.p, atol=1e-6) and np.allclose(forced.weight, plain.weight, atol=1e-6)
    for got in (forced, plain):
        share = got.tokens * got.p
        assert share[got.source == "small"].sum() / share.sum() == pytest.approx(0.75, abs=1e-6)
        assert share[got.lang.isna()].sum() / share.sum() == pytest.approx(0.8, abs=1e-6)


def brute_rake(cells, want, rounds=2000):
    w = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(rounds):
        for axis, goal in enumerate(want):
            have = defaultdict(float)
            for c, v in w.items():
                have[c[axis]] += v
            w = {c: v * goal[c[axis]] / have[c[axis]] if have[c[axis]] else 0.0 for c, v in w.items()}
    return w


def test_mixing_query(spark):
    got = Q.op3_mixing(spark, SF).toPandas()
    raw = table("documents").set_index("doc_id")
    assert sorted(got.doc_id) == sorted(raw.index)
    cells, rows = defaultdict(int), []
    for r in got.itertuples():
        d = raw.loc[r.doc_id]
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        assert r.tokens == n and (r.source, r.lang) == (d.source, d.lang) and (r.topic >= 0) == bool(words(d.text))
        rows.append((r, (r.source, r.lang, r.topic)))
        cells[rows[-1][1]] += n
    flat = dict(cells)
    for axis, name in enumerate(mixing.AXES):
        seen = defaultdict(int)
        for c, n in cells.items():
            seen[c[axis]] += n
        for c in flat:
            flat[c] *= min(mixing.GAINS[name], (max(seen.values()) / max(1, seen[c[axis]])) ** (1 - mixing.POWERS[name]))
    want = []
    for axis in range(3):
        goal = defaultdict(float)
        for c, v in flat.items():
            goal[c[axis]] += v / sum(flat.values())
        want.append(goal)
    w = brute_rake(cells, want)
    top = max(w[c] / n for c, n in cells.items() if n)
    for r, c in rows:
        p = w[c] / cells[c] / top if r.tokens else 1.0
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        assert r.p == pytest.approx(p, abs=1e-3) and (abs(u - p) < 1e-3 or r.sampled == (u < p))


def test_topics_part_texts_by_their_words():
    rng = np.random.default_rng(2)
    packs = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    texts = [" ".join([*rng.choice(packs[k % 3], 12), "the", "of"]) for k in range(90)]
    learned = mixing.Topics([mixing.word_bins(t) for t in texts[:60]], 3)
    found = [learned.of(t) for t in texts]
    assert {len({found[k] for k in range(j, 90, 3)}) for j in range(3)} == {1} and len(set(found)) == 3
    assert learned.of(None) == learned.of("") == learned.of("?! ...") == -1 and mixing.Topics([]).of("a word") == 0


def test_word_bins_take_one_pass_without_counting_words():
    def counted(text):
        n = Counter(common.alnum_words(text))
        out = np.zeros(mixing.BINS, np.int64)
        np.add.at(out, [zlib.crc32(w) & (mixing.BINS - 1) for w in n], list(n.values()))
        at = np.flatnonzero(out)
        return at, [int(k).bit_length() for k in out[at]]

    def plain(text):  # as it was
        n = Counter(common.alnum_words(text))
        return np.bincount(np.fromiter((zlib.crc32(w) & (mixing.BINS - 1) for w in n), np.int64, len(n)), np.fromiter(n.values(), float, len(n)), mixing.BINS)

    rng = np.random.default_rng(4)
    texts = [" ".join(f"Word{k}" for k in rng.integers(0, 400, 600)) for _ in range(60)]
    for t in [None, "", "?!", "one", *texts]:
        (at, tf), (want, bits) = mixing.word_bins(t), counted(t)
        assert at.tolist() == want.tolist() and tf.tolist() == bits

    def least(f):
        return min(timeit.repeat(lambda: [f(t) for t in texts], number=1, repeat=15))

    assert least(mixing.word_bins) < 0.9 * least(plain)


def test_mixing_reads_parts_of_sliced_batches():
    rows = [([5, 9, 300], [1, 2, 1]), ([7], [3]), ([0, 4095], [1, 9]), ([8, 9], [2, 2])]
    cols = [pa.array([3, 4, -5, 6]), *[pa.array([np.array(r[k], t).tobytes() for r in rows], pa.binary()) for k, t in enumerate((np.uint16, np.uint8))]]
    (part,) = mixing._parts([pa.RecordBatch.from_arrays(cols, ["hash", "bins", "tf"]).slice(1, 3)])
    assert part.hashes.tolist() == [4, -5, 6] and part.sizes.tolist() == [1, 2, 2] and part.starts.tolist() == [0, 1, 3]
    assert part.bins.tolist() == [7, 0, 4095, 8, 9] and part.tf.tolist() == [3, 1, 9, 2, 2]


def test_mixing_reports_targets_out_of_reach(spark):
    rows = [(i, f"some text {i}", "en" if i % 2 else "de", "big" if i % 2 else "small") for i in range(40)]
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.draw(docs(spark, rows), {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 0.9, "de": 0.1}})


def test_mixing_default_targets_are_met_within_their_bound():
    rng = np.random.default_rng(3)
    for _ in range(20):  # groups that occur together or not, of very different sizes
        at = rng.integers(0, [12, 5, 6], (60, 3))
        cells = pd.DataFrame(np.unique(at, axis=0), columns=list(mixing.AXES))
        cells["tokens"] = (10 ** rng.uniform(0, 4, len(cells))).astype(int)
        want = mixing.targets(cells)
        w = mixing.rake(cells, want)
        for axis in mixing.AXES:
            assert np.allclose(pd.Series(w).groupby(cells[axis]).sum(), want[axis], atol=1e-4)
        gain = w / cells.tokens
        assert gain.max() <= 4.05 * gain.min() and gain.max() * cells.tokens.sum() <= 4


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (9, 0, 0), (99, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs(spark), labels).toPandas()
    assert len(got) == len(EDGE) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % 4 == 2)).all()
    assert (quality.score(docs(spark), labels.limit(0)).toPandas().score == 0.5).all()
    again = quality.score(docs(spark).repartition(5), labels).toPandas()
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, again.itertuples(index=False, name=None)))
    assert quality.score(docs(spark, []), labels).count() == 0


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    pool = "the of and river stone quiet house window garden letter |||| $$$ CLICK HERE 1234 buy!!! http://x".split()
    texts = [" ".join(rng.choice(pool[:10] if k % 3 else pool[8:], int(rng.integers(1, 60)))) for k in range(200)] + ["", None]
    rows = [quality.terms(t) for t in texts]
    labels = np.array([float(k % 3 > 0) for k in range(120)])
    m = quality.Model(rows[:120], labels, 0.6)
    good, bad = 0.6 / labels.mean(), 0.4 / (1 - labels.mean())
    for k, (t, got) in enumerate(zip(texts, m.score(rows), strict=True)):
        if not t:
            assert got == 0.6
            continue
        z = m.place(rows[k])
        near = sorted(range(120), key=lambda i: (-round(float(z @ m.vectors[i]) * 1e6), i))[: quality.NEIGHBOURS]
        vote = [max(0.0, float(z @ m.vectors[i])) ** quality.SHARPNESS * (good if labels[i] else bad) for i in near]
        assert got == pytest.approx(sum(v for v, i in zip(vote, near, strict=True) if labels[i]) / sum(vote), abs=1e-4)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op4_quality(spark, sf).toPandas().merge(ds.dataset(f"{sf}/labels.parquet").to_table().to_pandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_jaccard_join(spark):
    rows = [(i, t) for i, t, _, _ in EDGE]
    got = jaccard.classes(docs(spark)).toPandas().fillna(-1)
    assert sorted(map(tuple, got.astype(int).itertuples(index=False))) == brute_classes(rows)
    kept = jaccard.keep_first(docs(spark, [*EDGE, EDGE[0], EDGE[-1], (None, P1, "en", "a")])).collect()  # repeated rows and null ids once for each text
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 4, 5, 6, 7, 9, 10, 12, 13]
    assert jaccard.classes(docs(spark, [])).count() == 0


def test_jaccard_join_in_blocks_and_frequent(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 3), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w), "en", "a"))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "COMMON", 1)
    got = jaccard.classes(docs(spark, rows)).toPandas()
    assert sorted(map(tuple, got.astype(int).itertuples(index=False))) == brute_classes([r[:2] for r in rows])


@pytest.mark.parametrize("block", [4, 2000])
def test_jaccard_join_beside_the_pivot(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    w = [f"c{i}" for i in range(200)]
    # chains, whose far ends don't link to the smallest id; ids with two texts, of which one links only
    rows = [(i, " ".join(w[4 * i : 4 * i + 60])) for i in range(20)]
    rows += [(i, " ".join(w[10:60] + [f"y{i}_{k}" for k in range(int(rng.integers(0, 30)))])) for i in range(20, 40)]
    rows += [(5, " ".join(w[100:150])), (41, " ".join(w[100:152])), (42, "z " + " ".join(w[101:150])), (0, " ".join(f"q{i}" for i in range(30))), (43, " ".join(f"q{i}" for i in range(32)))]
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).toPandas()
    assert sorted(map(tuple, got.astype(int).itertuples(index=False))) == brute_classes(rows)


def test_jaccard_query(spark):
    got = Q.op5_jaccard_join(spark, SF).toPandas()
    assert sorted(map(tuple, got.astype(int).itertuples(index=False))) == brute_classes(list(table("documents")[["doc_id", "text"]].itertuples(index=False, name=None)))


def test_language_id(spark):
    got = language_id.predict(docs(spark)).toPandas()
    assert len(got) == len(EDGE)
    none = got[got.doc_id.isin([4, 5, 6, 9])]
    assert (none.lang_pred == "und").all() and (none.score == 0).all() and got.score.between(0, 1).all()
    assert all((r.lang_pred == "und") == (len(r.langs) == 0) and (not len(r.langs) or r.langs[0]["lang"] == r.lang_pred) for r in got.itertuples())
    assert {r.doc_id for r in language_id.keep_identified(docs(spark)).collect()}.isdisjoint({4, 5, 6, 9})
    assert (language_id.predict(docs(spark, [(1, "text", None, "a")])).toPandas().lang_pred == "und").all()
    assert language_id.predict(docs(spark, [])).count() == 0


def test_language_id_held_out(spark):
    got = Q.op6_language_id(spark, SF).toPandas().merge(table("documents"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_mixture_names_both_languages():
    rng = np.random.default_rng(0)
    a, b = ("".join(rng.choice(list("abcdef "), 6000)) for _ in range(2))
    b = b.translate(str.maketrans("abcdef", "uvwxyz"))
    counts = np.zeros((2, language_id.BINS))
    for k, t in enumerate((a, b)):
        at, n = language_id.trigrams(t)
        counts[k, at] = n
    name, score, chosen = language_id.Mixture(["x", "y"], counts).infer(a[:900] + " " + b[:300])
    assert name == "x" and {k for k, _ in chosen} == {"x", "y"} and 0.65 < score < 0.85


@pytest.mark.parametrize("n", [0, 3, 15, 200])
def test_sharding(spark, n):
    rows = EDGE if n == 15 else [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(n)]
    got = sharding.assign(docs(spark, rows)).toPandas()
    assert len(got) == n
    if n:
        sizes = got.groupby("shard").size().reindex(range(8), fill_value=0)
        assert sizes.max() - sizes.min() <= 1 and (got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))).all()
        want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows if i is not None}
        assert {(int(r.doc_id), r.size_, r.text_crc32) for r in got.rename(columns={"size": "size_"}).itertuples() if not pd.isna(r.doc_id)} == want
    if n == 200:
        hot = {i for i, _, _, s in rows if s == "hot"}
        by = got.groupby("shard").doc_id.apply(lambda s: sum(int(i) in hot for i in s))
        assert by.max() - by.min() <= len({s for _, _, _, s in rows})  # each source moves a cut by one row at most


def brute_pii(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in pats.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii_equals_patterns():
    rng = np.random.default_rng(5)
    finder = pii.Finder()
    parts = ["a@b.co", "@", ".", "+1 (202) 555-0143", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6", " ", "-", "é", "x.y@z", "a@b.c@d.e", "12", "+", "http://x.yz/q.", "IBAN: DE89 3704 0044 0532 0130 00"]
    for _ in range(400):
        t = "".join(rng.choice(parts, 8))
        assert pii.listed(finder.find(t), pii.BASE).split(",") == (brute_pii(t) or [""])
    f = finder.find("see http://x.yz/q. IBAN: DE89 3704 0044 0532 0130 00 ok")
    assert f["url"] == [(4, 17)] and len(f["account"]) == 1


def test_pii(spark):
    got = pii.scan(docs(spark)).toPandas()
    assert len(got) == len(EDGE) and (got.n_email == 0).all()
    clean = pii.redact(docs(spark, [(1, "mail a@b.co now", "en", "a"), (2, None, "en", "a")]))
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "mail [EMAIL] now", 2: None}
    assert pii.scan(docs(spark, [])).count() == 0


def test_pii_query(spark):
    got = Q.op8_pii(spark, SF).toPandas().set_index("doc_id")
    for i, t in table("documents")[["doc_id", "text"]].itertuples(index=False, name=None):
        base = brute_pii(t or "")
        assert got.loc[i, "base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert tuple(got.loc[i, [f"n_{k}" for k in ("email", "ip", "card", "phone")]]) == tuple(sum(x.startswith(f"{k}:") for x in base) for k in ("email", "ip", "card", "phone"))
        assert set(base) <= set(got.loc[i, "spans"].split(","))


def test_warc(spark):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (5, "http://c", ""), (4, "u\r\nv", "é" * 50_000), (7, "http://d", "unique"), (None, "http://e", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' as digest")
    folder, archives = warc.write_archives(pages, archive_bytes=1000)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = {r.page_id: r for r in warc.read_archives(folder, archives).collect()}
    assert (got[1].record_type, got[3].record_type, got[3].refers_to, got[5].refers_to, got[2].record_type, got[None].refers_to) == ("response", "revisit", 1, 2, "response", 1)
    assert got[4].payload_bytes == 100_000
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [1.0] * 4), (304, [None] + [1.0] * 15), (None, [1.0] * 16), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.search(df, df.where("vec_id % 20 = 0")).toPandas()
    want = []
    for q in range(0, 300, 20):
        s = np.array([x[i] @ x[q] for i in range(300)])
        want += [(q, i) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]]
    assert len(set(want) & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.97 * len(want) and (got["rank"] <= 20).all()
    first = got[got.query_id == 0].sort_values("rank").vec_id.tolist()
    assert first == list(range(100, 120))  # ties to the smaller id
    few = nearest.search(df.where("vec_id < 3"), df.where("vec_id = 0")).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [0.03, 0.3])
def test_nearest_among_near_copies(spark, noise):
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, 64)))
    x[:2000] = unit(x[0] + noise * unit(rng.normal(size=(2000, 64))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    q = np.arange(0, 6000, 60)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = {(a, b) for a, top in zip(q, np.argsort(-s, axis=1)[:, :20], strict=True) for b in top}
    got = nearest.search(df, df.where("vec_id % 60 = 0")).toPandas()
    assert set(zip(got.query_id, got.vec_id, strict=True)) == want


def test_nearest_counts_a_repeated_id_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(1, rows[0][1])] * 30
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.search(df, df.where("vec_id = 0")).toPandas()
    assert len(got) == got.vec_id.nunique() == 20 and got.sort_values("rank").vec_id.iloc[0] == 1


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = ds.dataset(f"{sf}/embeddings.parquet").to_table().to_pandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = {(ids[a], ids[b]) for a, top in zip(q, np.argsort(-s, axis=1)[:, :20], strict=True) for b in top}
    got = Q.op10_nearest(spark, sf).toPandas()
    assert len(want & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.9 * len(want)


def test_shingles_are_those_of_words():
    powers = common.Powers()
    for t in (None, "", "  ", "a b", "A b c d e f", "a b c d e a b c d e", "é x y z w v", LONG):
        assert len(common.shingle_set(t, 5, powers)) == len(shingles(t))


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [k for k, _ in P.STAGES][0] == "language_id" and len(P.STAGES) == 5
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = d
    for _, stage in P.STAGES[:3]:
        kept = common.materialize(stage(spark, kept, SF), "t")
        assert kept.columns == d.columns
    raw = table("documents")[["doc_id", "text"]]
    items = list(table("benchmark")[["item_id", "text"]].itertuples(index=False, name=None))
    lettered = [(i, t) for i, t in raw.itertuples(index=False, name=None) if t and any(map(str.isalpha, t))]
    first = {i for i, _, c in brute_classes(lettered) if i == c}
    assert {r.doc_id for r in kept.collect()} == {i for i, t in lettered if i in first and not brute_hits(t, items)[1]}
    got = P.run(spark, SF).toPandas()
    assert set(got.doc_id) <= {r.doc_id for r in kept.collect()} and got.groupby("shard").size().pipe(lambda s: s.max() - s.min()) <= 1
    assert {r.doc_id for r in mixing.draw(kept).where("sampled").collect()} == set(got.doc_id)


def test_topics_come_from_all_documents(spark, monkeypatch):
    """One text in a few thousand counts in the frequencies and sums, and tasks and slices change nothing."""
    rows = [(i, f"word{i % 3} text{i % 7} more", "en", "a") for i in range(2500)]
    used = [mixing.learn_topics(mixing.binned(docs(spark, [*rows, *more]).repartition(k)), 3).weights for more, k in (([], 1), ([], 5), ([(9000 + i, "singular plural", "en", "a") for i in range(3)], 2))]
    assert (used[0] == used[1]).all() and used[0].any()
    at = mixing.word_bins("singular")[0]
    assert not used[0][at].any() and used[2][at].any()
    n = 2503
    x = [mixing.word_bins(t) for t in [*[r[1] for r in rows], *["singular plural"] * 3]]
    df = np.bincount(np.concatenate([b for b, _ in x]), minlength=mixing.BINS)
    idf = np.log((1 + n) / (1 + df))
    centres = used[2] / np.where(idf > 0, idf, 1)[:, None] / 1e6
    assert np.allclose(np.linalg.norm(centres, axis=0), 1, atol=1e-4)
