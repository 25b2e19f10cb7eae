"""Language identification as inference of a multilingual mixture.

Each language has a distribution over hashed character trigrams, learned from labelled texts. A document is a mixture of
languages: expectation-maximisation estimates the proportions from the likelihoods of its trigrams. The set of languages is
chosen by penalised likelihood: starting with the best single language, the next in proportion joins as long as
the likelihood gains more than the penalty of a parameter. The prediction is the largest proportion in that set.

Scale: the profiles are languages x `BINS` counts, whatever the corpus; they are learned from about `SAMPLE` texts a language
(chosen by a hash of doc_id under a threshold from that language's count, so no sort and no group in one task) and summed before
they reach the driver. Prediction maps the documents in place, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_columns, seeded

#: Texts of each language that the profiles are learned from, about.
SAMPLE = 1500
BINS = 1 << 15
FOLDS, HELD_OUT = 5, 0
ROUNDS = 12
#: Log-likelihood that one more language has to gain, in units of log(trigrams): trigrams overlap, so 3/2 for each of BIC's halves.
PENALTY = 1.5
LEAST_SHARE = 0.02
UNKNOWN = "und"
SET = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
#: The pipeline rejects texts whose main language has a lower score.
LEAST_SCORE = 0.3


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the text's trigrams over lower-cased letters (anything else is a blank), and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (codes >= 128) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letters, codes, 32)
    codes = np.concatenate((np.array([32], np.uint32), codes, np.array([32], np.uint32)))
    inside = np.concatenate(([False], letters, [False]))
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    use = inside[:-2] | inside[1:-1] | inside[2:]
    with np.errstate(over="ignore"):
        h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(((h >> np.uint32(17)) & np.uint32(BINS - 1))[use], minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins].astype(np.float64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Mixture:
    """Trigram distributions of the languages, in the order of their names."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        self.p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BINS) if names else np.zeros((0, BINS))
        self.log = np.log(self.p)

    @staticmethod
    def fit(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log-likelihood."""
        share, n = np.full(len(p), 1 / len(p)), counts.sum()
        for _ in range(ROUNDS):
            share = share * (p @ (counts / (share @ p))) / n
        return share, float(counts @ np.log(share @ p))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its score, and the chosen set with proportions."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0, []
        bins, counts = trigrams(text)
        if not len(bins):
            return UNKNOWN, 0.0, []
        p = self.p[:, bins]
        alone = self.log[:, bins] @ counts
        chosen, best = [int(alone.argmax())], float(alone.max())
        share = np.ones(1)
        if len(p) > 1:
            whole, _ = self.fit(p, counts)
            cost = PENALTY * np.log(counts.sum() + 1)
            for k in np.argsort(-whole, kind="stable"):
                if k in chosen or whole[k] < LEAST_SHARE:
                    continue
                more, gained = self.fit(p[[*chosen, k]], counts)
                if gained - best <= cost:
                    break
                chosen, share, best = [*chosen, int(k)], more, gained
        top = int(share.argmax())
        others = np.delete(alone, chosen[top])
        margin = (alone[chosen[top]] - others.max()) / 3 if len(others) else 30.0
        sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) if len(chosen) == 1 else 1.0
        return self.names[chosen[top]], round(float(share[top] * sure), 6), [(self.names[k], float(s)) for k, s in zip(chosen, share, strict=True)]


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Mixture:
    """Profiles of the languages of rows outside the held-out fold with text and lang."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return Mixture([], np.zeros((0, BINS)))
    limit = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, sample / counts[name]))])
    drawn = known.where(F.pmod(seeded("doc_id", seed=6), F.lit(1_000_000)) < F.element_at(limit, F.col("lang")) * 1_000_000)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                bins, n = trigrams(text.as_py())
                total.setdefault(lang, np.zeros(BINS))[bins] += n
            rows = [(k, np.flatnonzero(v), v) for k, v in total.items()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, at, _ in rows for _ in at], pa.string()),
                    pa.array(np.concatenate([at for _, at, _ in rows]), pa.int32()),
                    pa.array(np.concatenate([v[at] for _, at, v in rows]), pa.float64()),
                ],
                ["lang", "bin", "n"],
            )

        return each

    held = map_arrow(drawn.select("lang", "text"), make, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    profile = np.zeros((len(names), BINS))
    profile[held.lang.map({k: i for i, k in enumerate(names)}).to_numpy(int), held.bin.to_numpy(int)] = held.n
    return Mixture(names, profile)


def _mapped(docs: DataFrame, model) -> DataFrame:
    """docs with __lang, __score and __langs, the set of languages with proportions, largest first."""

    def make():
        m = model.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [m.infer(t.as_py()) for t in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([[{"lang": k, "share": round(v, 6)} for k, v in sorted(x[2], key=lambda c: (-c[1], c[0]))] for x in found], SET),
                ],
                [*batch.schema.names, "__lang", "__score", "__langs"],
            )

        return each

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, make, f"{columns}, __lang string, __score double, __langs array<struct<lang:string,share:double>>")


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each row's doc_id, held_out, lang_pred, score (the main language's proportion, less what doubt there is about it) and langs.

    langs: the chosen set of languages with their proportions, largest first. Null texts and texts without a letter are `und` with score 0
    and an empty set, as is every text where no language was learned. Ties go to the name that comes first. Repeated
    rows get the same answer; a very long text is counted whole, in its task; other columns take no part in a prediction.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    found = _mapped(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold() == HELD_OUT).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__langs").alias("langs"))


@own_columns
def keep_identified(docs: DataFrame, sample: int = SAMPLE, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs, in their own columns, without texts of no language or of none that leads with least_score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    return _mapped(docs, model).where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).select(docs.columns)
