"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_features, bpe, secret_scan, toxicity
from .chunk_fingerprint import edit_fingerprints
from .common import spool, table
from .line_dedup import line_dedup
from .mixing import mix_plan
from .simhash import simhash_components
from .url_filter import judge, rules_table
from .warc import archive_round_trip

TOKENIZER = "word_bpe_49k.json"

#: Fixed values of op3: action, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edit_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spool(audio_features.to_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media", compression="zstd")
    found = audio_features.features(stored, with_tensors=True)
    return audio_features.described(spool(found.drop("feature"), "features", compression="zstd")).select(*found.drop("tensors", "segments").columns)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM placed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM placed LEFT JOIN hits USING (page_id)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.pos, d.line, c.k IS NOT NULL AND d.doc_id <> c.keep AS gone
  FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return out.select(F.col("_cl_id").alias("doc_id"), F.lower(F.lpad(F.hex("_cl_fp"), 16, "0")).alias("fingerprint"), F.col("_cl_component").alias("component_id"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, with_decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # a rebuilt record whose bytes aren't what its header says fails the job
    whole = F.when(F.col("verified"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("archive record differs: "), F.col("page_id").cast("string"))))
    return out.select("page_id", "payload_bytes", whole.alias("payload_digest"), "record_type", "refers_to")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("_cl_id").cast("string").cast("binary")) % 3 == 1
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return toxicity.score(docs, model).select(F.col("_cl_id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(
        F.col("_cl_id").alias("doc_id"),
        F.col("_cl_size").alias("size"),
        F.col("_cl_source_size").alias("source_size"),
        F.col("_cl_target").alias("target"),
        (F.col("_cl_copies") * F.col("_cl_size")).cast("long").alias("taken"),
    )


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
            / (1.0::DOUBLE / (1.0::DOUBLE + abs(length(text) / greatest(size, 1)::DOUBLE - 7.0::DOUBLE))) AS k
  FROM base),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM keyed GROUP BY source),
ratios AS (SELECT *, s * 2.0::DOUBLE AS cap, s * 2.0::DOUBLE / w AS ratio, sum(s) OVER () * 1.5::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS kk,
         (total - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM ratios),
targets AS (
  SELECT source, s, least(cap, coalesce(w * (SELECT arg_min(lvl, kk) FROM levels WHERE ratio >= lvl), cap)) AS target FROM levels),
placed AS (
  SELECT k.doc_id, k.size, t.s AS source_size, t.target,
         CASE WHEN t.s > 0 THEN floor(t.target / t.s) ELSE 0 END AS whole,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST((whole + CASE WHEN whole < 2 AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_fingerprint": op1_chunk_fingerprint,
    "op2_audio_features": op2_audio_features,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_mix_sources": op10_mix_sources,
}
SQL: dict[str, str] = {"op3_url_filter": OP3_SQL, "op7_warc": OP7_SQL, "op4_line_dedup": OP4_SQL, "op10_mix_sources": OP10_SQL}
