"""The queries ``opN_<name>`` and ``pipeline``, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import render
from . import warc
from .common import stage, table
from .lines import quality_rules
from .packing import pack
from .pieces import report
from .quality import quality
from .simhash import near_duplicates
from .suffixes import repeat_report
from .topk import top_k
from .toxicity import toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Offsets past any file's end, where the replica has moved and extra records.
_MOVED, _EXTRA = 1 << 30, 1 << 31


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica of its files in which some records have rotted, gone, moved or come twice."""
    pages = table(spark, sf_dir, "pages")
    fate = F.coalesce(F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2), F.lit("zz"))
    rotten = F.when((fate < "03") & (F.char_length("html") > 0), F.concat(F.expr("left(html, char_length(html) - 1)"), F.lit("\x01"))).otherwise(F.col("html"))
    rot = F.sha2(warc.record_text(F.col("page_id"), F.col("url"), rotten), 256)
    archive = stage(warc.placed(warc.digests(pages.withColumn("rot", rot).withColumn("fate", fate), "rot", "fate")), "archive")
    at, fate = F.col("offset"), F.col("fate")
    places = F.when(fate == "03", F.array().cast("array<bigint>")).when(fate == "04", F.array(at + _MOVED)).when(fate == "05", F.array(at, at + _EXTRA)).otherwise(F.array(at))
    replica = archive.select("page_id", "file", "length", F.col("rot").alias("digest"), F.explode(places).alias("offset"))
    return warc.audit(archive, replica)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_suffix_dedup, op4_top_k, op5_warc_fixity, op6_quality_rules, op7_toxicity, op8_quality_classifier, op9_packing, op10_chat_format, pipeline)}


_TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


_WARC = """
WITH records AS (
  SELECT page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), 'none'),
    '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Block-Digest: sha256:', sha256(coalesce(html, '')),
    chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record,
    html
  FROM pages
), digests AS (
  SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256, coalesce(length(html) > 0, false) AS has_text, coalesce(substring(sha256(CAST(page_id AS VARCHAR)), 1, 2), 'zz') AS fate FROM records
), ordered AS (
  SELECT *, (row_number() OVER (ORDER BY page_id NULLS FIRST, sha256) - 1) AS ordinal FROM digests
), filed AS (
  SELECT *, CAST(ordinal // 1024 AS BIGINT) AS file FROM ordered
), placed AS (
  SELECT page_id, file, CAST(sum(length) OVER (PARTITION BY file ORDER BY ordinal) - length AS BIGINT) AS "offset", length, sha256, has_text, fate FROM filed
), judged AS (
  SELECT page_id, file, "offset", length, sha256, CASE WHEN fate < '03' AND has_text THEN 'rotten' WHEN fate = '03' THEN 'missing' WHEN fate = '04' THEN 'moved' ELSE 'intact' END AS status FROM placed
  UNION ALL SELECT page_id, file, "offset" + 1073741824, length, sha256, 'moved_to' FROM placed WHERE fate = '04'
  UNION ALL SELECT page_id, file, "offset" + 2147483648, length, sha256, 'extra' FROM placed WHERE fate = '05'
)
SELECT page_id, file, "offset", length, sha256, status = 'intact' AS intact, status FROM judged
"""

_CHAT = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), prefixes AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM turns
), whole AS (
  SELECT prefix, total, min(conv_id) AS conv_id FROM prefixes WHERE len(prefix) = total GROUP BY prefix, total
), kept AS (
  SELECT conv_id, total FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE len(prefix) < total)
)
SELECT conv_id, CAST(turn // 256 AS BIGINT) AS segment, count(*) AS n_turns, total AS total_turns,
  string_agg('<|im_start|>' || regexp_replace(translate(role, chr(13) || chr(10), '  '), '<(\\*\|im_(?:start|end)\|>)', '<\\\1', 'g') || chr(10)
    || regexp_replace(text, '<(\\*\|im_(?:start|end)\|>)', '<\\\1', 'g') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM turns JOIN kept USING (conv_id)
GROUP BY conv_id, turn // 256, total
"""


_REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (
  SELECT r, doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)
), m AS (
  SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 50)) AS b FROM w JOIN m USING (s) WHERE first_id < doc_id
), cut AS (
  SELECT r, count(*) AS n_removed, count(*) FILTER (start) AS n_spans FROM (SELECT r, b, coalesce(b - lag(b) OVER (PARTITION BY r ORDER BY b) > 1, true) AS start FROM gone) GROUP BY r
), kept AS (
  SELECT d.r, string_agg(substring(h, 2 * x.b + 1, 2), '' ORDER BY x.b) AS hx FROM d JOIN cut USING (r) JOIN (SELECT r, unnest(range(0, n)) AS b FROM d) x USING (r) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = x.r AND g.b = x.b) GROUP BY d.r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(text) ELSE sha256(unhex(coalesce(hx, ''))) END AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""

_LINES = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM rows
), grams AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY r
), own_lines AS (
  SELECT r, doc_id, host, line, sum(n) AS words FROM (
    SELECT r, doc_id, host, array_to_string(w, ' ') AS line, len(w) AS n FROM (SELECT r, doc_id, host, regexp_extract_all(lower(unnest(lines)), '[^\x20\x09-\x0D]+') AS w FROM split)
  ) GROUP BY r, doc_id, host, line
), hosts AS (
  SELECT host, count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) AS documents FROM rows GROUP BY host
), frequent AS (
  SELECT l.host, l.line FROM (SELECT host, line, count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) AS held FROM own_lines GROUP BY host, line) l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  WHERE held > 1 AND held - 1 > 0.1 * (documents - 1)
), removed AS (
  SELECT l.r, CAST(sum(l.words) AS BIGINT) AS removed_words FROM own_lines l JOIN frequent f ON l.line = f.line AND l.host IS NOT DISTINCT FROM f.host GROUP BY l.r
), counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM split LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
), judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.3 * n_words AS kept FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": _REPEATS, "op6_quality_rules": _LINES, "op4_top_k": _TOP_K, "op5_warc_fixity": _WARC, "op10_chat_format": _CHAT}
