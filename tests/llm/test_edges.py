"""Columns whose names clash with an operator's own, long texts, and rows that share an id."""

import pyarrow as pa
import pytest

from tidewatch.llm import common, decontaminate, jaccard, language_id, line_dedup, pii

P = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
NAMES = ("__id", "__spans", "__lang", "__gone", "__items", "__score", "__n_words", "own0")


def docs(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", "a", *(f"{n}{i}" for n in NAMES)) for i, t in rows], schema)


@pytest.mark.parametrize("op", ["keep_first", "dedup_lines", "decontaminate", "keep_identified", "redact"])
def test_clashing_columns_come_back_as_they_were(spark, op):
    df = docs(spark, [(1, P + "\nmail me at a@b.org"), (2, P), (3, None), (4, "quite another text with some words of its own here")])
    run = {
        "keep_first": jaccard.keep_first, "dedup_lines": line_dedup.dedup_lines, "keep_identified": language_id.keep_identified, "redact": pii.redact,
        "decontaminate": lambda d: decontaminate.decontaminate(d, spark.createDataFrame([(1, "nothing of this kind")], "item_id bigint, text string")),
    }[op]
    out = run(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)


def test_a_text_of_many_lines(spark):
    lines = [f"line {i} has the words {i * 7} and {i * 13} in it {i % 5}" for i in range(40_000)]
    df = docs(spark, [(1, "\n".join(lines + lines[:10])), (2, "\n".join(lines[:5] + ["a line of its own, unlike all of the others"]))])
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).select("doc_id", "text").collect()}
    assert got[2] == ["a line of its own, unlike all of the others"] and len(got[1]) <= 40_000 and got[1][0] == lines[0]


def test_rows_of_one_id_in_any_order(spark):
    one, near, other = (f"the very same words in a line that is long enough to be compared {x}" for x in ("one two", "one two", "xx yy"))
    rows = [(1, one + " end"), (2, near + " end here"), (2, "nothing like it at all, not a single word"), (3, other)]
    found = [sorted((r.doc_id, r.removed) for r in line_dedup.removed_lines(docs(spark, order)).collect()) for order in (rows, rows[::-1], [rows[2], rows[1], rows[0], rows[3]])]
    assert found[0] == found[1] == found[2]
    assert ("2", "0") in {(str(i), r) for i, r in found[0]}


def test_batches_of_long_texts_are_bounded(spark):
    texts = spark.range(0, 40, 1, 1).selectExpr("repeat(chr(97 + id), 1000000) AS text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([sum(len(t.as_py()) for t in b.column("text"))], pa.int64())], ["n", "size"])

    seen = common.arrow(texts, run, "n bigint, size bigint").toPandas()
    assert seen.n.sum() == 40 and seen["size"].sum() == 40_000_000 and seen["size"].max() <= 2 * common.BATCH_BYTES
