"""The operators' registered queries.  Each takes (spark, sf_dir) and returns its whole result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, html_blocks, language_mixture, media_columns, near_dup, packing, quality_qda, quality_rules, secret_scan
from tesserae.llm.shared import fresh_folder, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def remainder(divisor: int) -> F.Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write_packed(table(spark, sf_dir, "documents"), fresh_folder(spark, "tokens"), TOKENIZER)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "media")
    stored = media_columns.store_payloads(table(spark, sf_dir, "documents"), folder)
    read = media_columns.read_back(stored, folder)
    return read.select("doc_id", "n_bytes", "payload_bytes", F.col("read_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "sample_bits")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mixture.learn(docs.filter(remainder(5) != 0))
    out = language_mixture.identify(docs, model)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", F.to_json("shares").alias("shares"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality_rules.statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    cutoffs = quality_rules.certified_cutoffs(stats, table(spark, sf_dir, "labels"))
    return quality_rules.verdicts(stats, cutoffs).drop("content")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), RANKS)


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(quality_qda.features(table(spark, sf_dir, "documents")), "quality-vectors")
    model = quality_qda.fit(vectors.filter(remainder(4) != 2), table(spark, sf_dir, "labels"))
    return quality_qda.score(vectors, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_binary, op2_media_columns, op3_language_mixture, op4_html_blocks, op5_secret_scan, op6_quality_rules, op7_near_dup, op8_packing, op9_byte_bpe, op10_quality_qda)}


def _secret_sql() -> str:
    """The scan in SQL: matches and the gaps between them, whose lengths add up to positions."""
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(
            f"SELECT row, '{rule.kind}' AS kind, {order} AS kind_order, {rule.least} AS least, regexp_extract_all(t, '{regex}') AS found, regexp_extract_all(t, '{regex}', {rule.group}) AS sized, "
            f"string_split_regex(t, '{regex}') AS gaps FROM d WHERE regexp_matches(t, '{regex}')"
        )
    total = lambda values, upto: f"coalesce(list_sum(list_transform({values}[1:{upto}], lambda x: length(x))), 0)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT row, kind, kind_order, CAST({total('gaps', 'i')} + {total('found', 'i - 1')} AS BIGINT) AS b, CAST({total('gaps', 'i')} + {total('found', 'i')} AS BIGINT) AS e FROM i WHERE length(sized[i]) >= least),
g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, kind_order) FILTER (kind_order < {len(secret_scan.BASE_RULES)}) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, kind_order) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.row = g.row"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against plain versions."""
    return {"op5_secret_scan": _secret_sql()}
