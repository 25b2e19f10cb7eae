"""The corpus queries, each over its whole table, and SQL for those that SQL can express on small data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, heap_lloyd, jaccard, language_id, lexicon, line_dedup, mixing, nearest, phrases, pii, quality, sharding, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_hits(docs, _read(spark, sf_dir, "benchmark")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(_read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.digest(_read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only the driver reads the vocabulary

    return lexicon.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_line_dedup, op3_mixing, op4_quality, op5_jaccard_join, op6_language_id, op7_sharding, op8_pii, op9_warc, op10_nearest, op11_vector_codes, op12_collocations, op13_bpe, pipeline,
    )
}

ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS k, array_to_string(w[p : p + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS win
  FROM i, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS t(p) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(p) WHERE len(w) >= k
), hits AS (SELECT dw.r, dw.k, dw.p, iw.item_id FROM dw JOIN iw USING (k, win)
), words AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT r, k, p FROM hits), unnest(range(0, k)) AS t(o) GROUP BY r
), items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP2_SQL = rf"""
WITH l AS (
  SELECT doc_id, CAST(t.n - 1 AS INT) AS line_no, x AS line
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, n) WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\r\x0B\f]+'), lambda v: v <> ''))) AS ws FROM l
), s AS (SELECT ws, min((doc_id, line_no)) AS first, row_number() OVER (ORDER BY min((doc_id, line_no))) AS sid FROM w WHERE len(ws) > 0 GROUP BY ws
), t AS (SELECT sid, first, len(ws) AS n, unnest(ws) AS tok FROM s
), f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok
), o AS (SELECT t.*, row_number() OVER (PARTITION BY sid ORDER BY df, tok) AS i FROM t JOIN f USING (tok)
), p AS (SELECT * FROM o WHERE i <= n - ceil({line_dedup.THRESHOLD} * n - 1e-9) + 1
), c AS (SELECT DISTINCT x.sid AS a, y.sid AS b FROM p x JOIN p y ON x.tok = y.tok AND x.sid > y.sid AND least(x.n, y.n) >= {line_dedup.THRESHOLD} * greatest(x.n, y.n) - 1e-9
), v AS (
  SELECT a FROM (SELECT a, len(list_intersect(sa.ws, sb.ws)) AS k, len(sa.ws) AS na, len(sb.ws) AS nb FROM c JOIN s sa ON a = sa.sid JOIN s sb ON b = sb.sid)
  GROUP BY a HAVING bool_or(k >= {line_dedup.THRESHOLD} * (na + nb - k) - 1e-9)
), gone AS (
  SELECT w.doc_id, w.line_no FROM w JOIN s USING (ws) WHERE (w.doc_id, w.line_no) > s.first OR s.sid IN (SELECT a FROM v)
), g AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g USING (doc_id)
"""

OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda p: array_to_string(w[p : p + 4], ' ')))) AS sh FROM d WHERE len(w) > 0
), g AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s GROUP BY sh
), t AS (SELECT rep, n, unnest(sh) AS tok FROM g
), f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok HAVING count(*) > 1
), c AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM (SELECT t.* FROM t JOIN f USING (tok)) x JOIN (SELECT t.* FROM t JOIN f USING (tok)) y ON x.tok = y.tok AND x.rep < y.rep
  GROUP BY 1, 2
), e AS (SELECT a, b FROM c WHERE 100 * k >= {jaccard.PERCENT} * (na + nb - k)
), twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(a, b) AS (SELECT rep, rep FROM g UNION SELECT r.a, x.b FROM reach r JOIN twoway x ON r.b = x.a
), comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(len(s.sh), 0) AS BIGINT) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN g USING (sh) LEFT JOIN comp USING (rep)
"""



def _crc_table() -> str:
    """The 256 remainders of CRC-32's reversed polynomial, by its rule, as 8 hexadecimal digits each."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(f"{c:08x}")
    return "".join(out)


OP7_SQL = f"""
WITH r AS (
  SELECT doc_id, '=' || source AS src, coalesce(strlen(text), 0) + 1 AS size,
         md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(hex(encode(text)), '') AS hx
  FROM documents
), x AS (
  SELECT r.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(hx), 2), lambda p: CAST(('0x' || hx[p : p + 1]) AS BIGINT))),
         lambda a, b: xor(a >> 8, CAST(('0x' || substr('{_crc_table()}', (xor(a, b) & 255) * 8 + 1, 8)) AS BIGINT))), 4294967295) AS crc
  FROM r
), f AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY h, doc_id, crc, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY src) AS place FROM x
), g AS (SELECT *, row_number() OVER (ORDER BY place, h, doc_id, crc, size, src) - 1 AS pos, count(*) OVER () AS total FROM f
), k AS (SELECT *, (pos * {sharding.SHARDS}) // total AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
       CAST(pos - (shard * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM k
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html
), h AS (
  SELECT p.page_id, first_id, strlen(p.html) AS n, sha1(encode(p.html)) AS hx FROM p JOIN f USING (html)
), b AS (
  SELECT *, list_transform(range(0, 32), lambda i: (
    (CAST(('0x' || hx[(i * 5) // 4 + 1 : (i * 5) // 4 + 2] || CASE WHEN strlen(hx[(i * 5) // 4 + 1 : (i * 5) // 4 + 2]) = 1 THEN '0' ELSE '' END) AS BIGINT)) >> (3 - (i * 5) % 4)) & 31) AS v
  FROM h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[i + 1]), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

OP11_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({heap_lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), x AS (
  SELECT r, p, v[p * s + 1 : p * s + s] AS x FROM (SELECT *, len(v) // {heap_lloyd.PARTS} AS s FROM k), unnest(range(0, {heap_lloyd.PARTS})) AS t(p)
), b0 AS (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= {heap_lloyd.ENTRIES}
), """ + "".join(
    f"""a{n} AS (
  SELECT r, p, any_value(x) AS x, min(d * {heap_lloyd.ENTRIES} + e) AS best
  FROM (SELECT r, x.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{n} b ON x.p = b.p) GROUP BY r, p
), """ + (f"""m{n} AS (
  SELECT p, best % {heap_lloyd.ENTRIES} AS e, i, CAST((sum(x[i]) - (sum(x[i]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS c
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY ALL
), b{n + 1} AS (
  SELECT p, e, coalesce(any_value(n.c), any_value(b.c)) AS c FROM b{n} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM m{n} GROUP BY p, e) n USING (p, e) GROUP BY p, e
), """ if n < heap_lloyd.ROUNDS else "")
    for n in range(heap_lloyd.ROUNDS + 1)
) + f"""f AS (
  SELECT r, string_agg(printf('%02x', best % {heap_lloyd.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {heap_lloyd.ENTRIES}) AS BIGINT) AS error FROM a{heap_lloyd.ROUNDS} GROUP BY r
), h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{heap_lloyd.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h
"""

OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM w, unnest(range(1, {phrases.WORDS} + 1)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrases.LEAST}
), t AS (
  SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, CAST(({phrases.SCALE}::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), x AS (
  SELECT lang, sub AS phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS sub FROM c, unnest(range(2, {phrases.WORDS})) AS e(m), unnest(range(1, k - m + 2)) AS d(i) WHERE m < k) GROUP BY 1, 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN x USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < {phrases.SUBSUMED}::HUGEINT * a
QUALIFY rank <= {phrases.TOP}
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op7_sharding": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
