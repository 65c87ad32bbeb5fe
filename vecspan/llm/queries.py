"""The registered queries of the ten training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, jaccard_join, license_scan, line_dedup, lm_score, media, mixing, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_summary(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_score.cross_parse_scores(docs, lm_score.clean_reference(docs, _table(spark, sf_dir, "labels")))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_toxicity, op3_decontamination, op4_html_extraction, op5_lm_scoring, op6_token_store, op7_jaccard_join, op8_line_dedup, op9_source_mixing, op10_media_columns)
    return {f.__name__: f for f in own}


_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS x
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, win.item FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_TOKEN}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 70 * (na + nb - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.doc_id),
m AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id),
n AS (SELECT a AS doc_id, count(*) AS n_similar FROM l GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, CAST(coalesce(n_similar, 0) AS BIGINT) AS n_similar, component_id
FROM s JOIN m ON s.doc_id = m.doc_id LEFT JOIN n ON s.doc_id = n.doc_id
"""

_LEVELS = [1 << k for k in range(1, 15)]  #: lengths of runs that SQL looks for; longer ones don't occur at its size
_DOUBLED = ", ".join(f"n{h} AS (SELECT a.doc_id, a.ln, md5(a.x || b.x) AS x FROM n{h // 2} a JOIN n{h // 2} b ON a.doc_id = b.doc_id AND b.ln = a.ln + {h // 2})" for h in _LEVELS)
_LONGEST = " UNION ALL ".join(f"SELECT doc_id, {h} AS h FROM (SELECT doc_id, row_number() OVER (PARTITION BY x ORDER BY doc_id, ln) AS k FROM n{h}) WHERE k > 1" for h in _LEVELS)

_OP8 = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS x FROM raw WHERE text IS NOT NULL),
solid AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ln FROM every WHERE trim(x) <> ''),
pair AS (SELECT a.doc_id, a.ln, a.x || chr(10) || b.x AS x FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.ln = a.ln + {line_dedup.MIN_LINES - 1}),
runs AS (SELECT doc_id, ln, {line_dedup.MIN_LINES} AS n, row_number() OVER (PARTITION BY x ORDER BY doc_id, ln) AS k FROM pair
         UNION ALL SELECT doc_id, ln, 1, row_number() OVER (PARTITION BY x ORDER BY doc_id, ln) FROM solid WHERE length(x) >= {line_dedup.LONG_LINE}),
gone AS (SELECT DISTINCT doc_id, unnest(range(ln, ln + n)) AS ln FROM runs WHERE k > 1),
n1 AS (SELECT doc_id, ln, md5(x) AS x FROM solid), {_DOUBLED},
longest AS (SELECT doc_id, max(h) AS h FROM ({_LONGEST} UNION ALL SELECT doc_id, 1 FROM runs WHERE k > 1 AND n = 1) GROUP BY doc_id),
left_over AS (SELECT e.doc_id, e.pos, e.x, g.ln IS NULL AS keep FROM every e LEFT JOIN solid s ON e.doc_id = s.doc_id AND e.pos = s.pos LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.ln = s.ln)
SELECT raw.doc_id, CAST(coalesce(len(raw.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(longest.h, 0) AS INTEGER) AS longest_run, CASE WHEN raw.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM raw LEFT JOIN (SELECT doc_id, sum(CASE WHEN keep THEN 0 ELSE 1 END) AS n, string_agg(x, chr(10) ORDER BY pos) FILTER (keep) AS text FROM left_over GROUP BY doc_id) k ON raw.doc_id = k.doc_id LEFT JOIN longest ON raw.doc_id = longest.doc_id
"""


def _digest(use: str) -> str:
    return f"md5('{mixing.SEED}:{use}:' || coalesce(CAST(doc_id AS VARCHAR), ''))"


_OP9 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, n, least(cap, coalesce(max(CASE WHEN cap > level * w THEN level END) OVER () * w, cap)) AS target FROM v),
h AS (SELECT *, CAST(round(sum(target) OVER () / {mixing.BLOCK}) AS BIGINT) AS seats FROM t),
q AS (SELECT source, count(*) AS quota FROM (
        SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r, seats
        FROM (SELECT source, target, seats, unnest(range(0, seats + 1)) AS k FROM h WHERE target > 0)) WHERE r <= seats GROUP BY source),
a AS (SELECT h.source, h.source_size, h.target, coalesce(q.quota, 0) AS quota, CAST(ceil(h.n / {mixing.SHARD_DOCS}) AS BIGINT) AS shards FROM h LEFT JOIN q ON h.source IS NOT DISTINCT FROM q.source),
p AS (SELECT d.*, a.source_size, a.target, a.quota, ('0x' || substr({_digest('shard')}, 1, 8))::BIGINT % a.shards AS shard FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
ps AS (SELECT source, quota, shard, CAST(sum(size) AS BIGINT) AS total FROM p GROUP BY ALL),
b AS (SELECT source, shard, count(*) AS blocks FROM (
        SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY total / (2 * k + 1) DESC, shard, k) AS r
        FROM (SELECT source, shard, quota, total, unnest(range(0, quota + 1)) AS k FROM ps WHERE total > 0)) WHERE r <= quota GROUP BY source, shard),
l AS (SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY {_digest('order')}, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM p)
SELECT l.doc_id, l.size, l.source_size, l.target,
       CAST(greatest(0, least(stop, coalesce(blocks, 0) * {mixing.BLOCK}) - (stop - size)) + greatest(0, least(stop, coalesce(blocks, 0) * {mixing.BLOCK} - total) - (stop - size)) AS BIGINT) AS taken
FROM l JOIN ps ON l.source IS NOT DISTINCT FROM ps.source AND l.shard = ps.shard LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.shard = b.shard
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3, "op7_jaccard_join": _OP7, "op8_line_dedup": _OP8, "op9_source_mixing": _OP9}
