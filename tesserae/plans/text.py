"""Queries over documents as containers of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ident, segments
from tesserae.operators import occurrence, relations, response
from tesserae.plans.catalog import registered, table

#: The word whose neighbourhood the flagship query asks for.
ANCHOR = "the"

_TOKENS = """
o AS (SELECT d.doc_id AS container, CAST(t.ord AS BIGINT) AS ordinal, t.tok AS entity FROM documents d, LATERAL (SELECT unnest(string_split(lower(d.text), ' ')) AS tok, generate_subscripts(string_split(lower(d.text), ' '), 1) AS ord) t WHERE t.tok <> ''),
m AS (SELECT *, CASE WHEN entity = lag(entity) OVER w AND ordinal = lag(ordinal) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY container ORDER BY ordinal)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY container ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run_index FROM m),
r AS (SELECT container, CAST(run_index AS BIGINT) AS run_index, entity, min(ordinal) AS ordinal, count(*) AS run FROM n GROUP BY ALL)"""

_CANDIDATES = _TOKENS + f""",
s AS (SELECT *, CASE WHEN lead(ordinal) OVER w = ordinal + run THEN lead(entity) OVER w END AS nxt, CASE WHEN lag(ordinal + run) OVER w = ordinal THEN lag(entity) OVER w END AS prv FROM r WINDOW w AS (PARTITION BY container ORDER BY ordinal)),
a AS (SELECT * FROM s WHERE entity = '{ANCHOR}'),
c AS (
 SELECT CAST(container AS VARCHAR) AS target, container, 1 AS relation, run AS multiplicity, 0 AS gap FROM a
 UNION ALL SELECT nxt, container, 8, 1, 0 FROM a WHERE nxt IS NOT NULL UNION ALL SELECT entity, container, 8, run - 1, 0 FROM a WHERE run > 1
 UNION ALL SELECT prv, container, 4, 1, 0 FROM a WHERE prv IS NOT NULL UNION ALL SELECT entity, container, 4, run - 1, 0 FROM a WHERE run > 1
 UNION ALL SELECT r.entity, a.container, 16, r.run, abs(r.ordinal - a.ordinal) FROM a JOIN r ON a.container = r.container AND a.ordinal <> r.ordinal UNION ALL SELECT entity, container, 16, run - 1, 1 FROM a WHERE run > 1)"""


def document_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = occurrence.dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return occurrence.runs(occurrence.tokens(docs, "doc_id", F.lower("text")))


def _anchored_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs of the documents that have the anchor, which are all that its relations touch.

    They are told from the others before anything is exploded.
    """
    held = F.contains(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), F.lit(f" {ANCHOR} "))
    docs = occurrence.dealt(table(spark, d, "documents").select("doc_id", "text").filter(held), "doc_id", "text")
    return occurrence.runs(occurrence.tokens(docs, "doc_id", F.lower("text")))


def _anchor(spark: SparkSession) -> DataFrame:
    """The anchor as a table of known size, which is broadcast; tokens don't move to meet it."""
    return spark.range(1).select(F.lit(ANCHOR).alias("entity"))


@registered("WITH " + _CANDIDATES + """
SELECT target, count(*) AS candidate_count, CAST(sum(multiplicity) AS BIGINT) AS multiplicity, CAST(min(gap) AS BIGINT) AS min_gap, CAST(bit_or(relation) AS INTEGER) AS relation_mask, count(DISTINCT container) AS containers,
 CAST(sum(CASE WHEN relation = 1 THEN multiplicity ELSE 0 END) AS BIGINT) AS mass_container, CAST(0 AS BIGINT) AS mass_constituent, CAST(sum(CASE WHEN relation = 4 THEN multiplicity ELSE 0 END) AS BIGINT) AS mass_predecessor,
 CAST(sum(CASE WHEN relation = 8 THEN multiplicity ELSE 0 END) AS BIGINT) AS mass_successor, CAST(sum(CASE WHEN relation = 16 THEN multiplicity ELSE 0 END) AS BIGINT) AS mass_cooccur FROM c GROUP BY target""")
def response_field_anchor(spark: SparkSession, d: str) -> DataFrame:
    """What stands in which structural relation to the anchor word, with what mass, over all documents."""
    return response.response_field(None, relations.anchor_sums(_anchored_runs(spark, d), _anchor(spark)))


@registered("WITH " + _TOKENS + " SELECT container, CAST(sum(run) AS BIGINT) AS occurrences, count(*) AS runs, max(run) AS longest, count(DISTINCT entity) AS entities FROM r GROUP BY ALL")
def document_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return document_runs(spark, d).groupBy("container").agg(F.sum("run").alias("occurrences"), F.count("*").alias("runs"), F.max("run").alias("longest"), F.countDistinct("entity").alias("entities"))


@registered("WITH " + _TOKENS + " SELECT container, run_index, entity, ordinal, run FROM r WHERE run > 1")
def coalesced_runs(spark: SparkSession, d: str) -> DataFrame:
    return document_runs(spark, d).filter("run > 1").select("container", F.col("run_index").cast("bigint").alias("run_index"), "entity", "ordinal", "run")


@registered("WITH " + _TOKENS + " SELECT entity, count(DISTINCT container) AS containers, CAST(sum(run) AS BIGINT) AS multiplicity FROM r GROUP BY entity")
def container_counts(spark: SparkSession, d: str) -> DataFrame:
    per = occurrence.entity_count(document_runs(spark, d))
    return per.groupBy("entity").agg(F.count("*").alias("containers"), F.sum("multiplicity").alias("multiplicity"))


@registered("WITH " + _CANDIDATES + " SELECT target, count(*) AS n, CAST(sum(multiplicity) AS BIGINT) AS multiplicity FROM c WHERE relation = 8 GROUP BY target")
def successors(spark: SparkSession, d: str) -> DataFrame:
    return relations.neighbours(_anchored_runs(spark, d), _anchor(spark), relations.SUCCESSOR).groupBy("target").agg(F.count("*").alias("n"), F.sum("multiplicity").alias("multiplicity"))


@registered("WITH " + _CANDIDATES + " SELECT target, count(*) AS n, CAST(sum(multiplicity) AS BIGINT) AS multiplicity FROM c WHERE relation = 4 GROUP BY target")
def predecessors(spark: SparkSession, d: str) -> DataFrame:
    return relations.neighbours(_anchored_runs(spark, d), _anchor(spark), relations.PREDECESSOR).groupBy("target").agg(F.count("*").alias("n"), F.sum("multiplicity").alias("multiplicity"))


@registered("WITH " + _TOKENS + " SELECT CAST(container AS VARCHAR) AS source, entity AS target, CAST(sum(run) AS BIGINT) AS multiplicity FROM r WHERE container IN (SELECT doc_id FROM documents WHERE source = 'src3') GROUP BY ALL")
def constituents(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("container"))
    return relations.constituents(document_runs(spark, d), anchors).groupBy("source", "target").agg(F.sum("multiplicity").alias("multiplicity"))


@registered("WITH " + _TOKENS + """, x AS (SELECT container, CAST(sum(run) OVER (PARTITION BY container ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before, run FROM r)
SELECT container, max(coalesce(before, 0) + run) AS logical_count, count(*) AS vertices FROM x GROUP BY container""")
def decoded_ordinals(spark: SparkSession, d: str) -> DataFrame:
    vertices = document_runs(spark, d).withColumnRenamed("ordinal", "vertex")
    return occurrence.decoded(vertices).groupBy("container").agg(F.max(F.col("ordinal") + F.col("run") - 1).alias("logical_count"), F.count("*").alias("vertices"))


@registered("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 32) AS content_id, CAST(length(text) AS BIGINT) AS chars, octet_length(encode(text)) AS octets FROM documents")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", ident.content_id(F.coalesce("text", F.lit(""))).alias("content_id"), F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("octets"))


@registered("SELECT substr(sha256(text), 1, 32) AS content_id, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY ALL HAVING count(*) > 1")
def equal_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(ident.content_id(F.col("text")).alias("content_id")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("sources")).filter("copies > 1")


@registered("""
WITH i AS (SELECT source, substr(sha256(text), 1, 32) AS i FROM documents WHERE text IS NOT NULL), n AS (SELECT source, CAST('0x' || substr(i, 1, 15) AS HUGEINT) AS a, CAST('0x' || substr(i, 16, 15) AS HUGEINT) AS b, CAST('0x' || substr(i, 31, 2) AS HUGEINT) AS c FROM i)
SELECT source, sha256(concat_ws(':', count(*), sum(a), sum(b), sum(c))) AS fingerprint FROM n GROUP BY source""")
def set_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").filter("text is not null").select("source", ident.content_id(F.col("text")).alias("id"))
    return ids.groupBy("source").agg(ident.set_fingerprint(F.col("id")).alias("fingerprint"))


@registered("SELECT conv_id, sha256(array_to_string(list(substr(sha256(coalesce(text, '')), 1, 32) ORDER BY turn, substr(sha256(coalesce(text, '')), 1, 32)), '')) AS fingerprint, count(*) AS turns FROM conversations GROUP BY conv_id")
def sequence_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select("conv_id", "turn", ident.content_id(F.coalesce("text", F.lit(""))).alias("id"))
    return ids.groupBy("conv_id").agg(ident.sequence_fingerprint(F.col("turn"), F.col("id")).alias("fingerprint"), F.count("*").alias("turns"))


@registered("WITH " + _TOKENS + """, l AS (SELECT container, min(ordinal) AS at FROM o WHERE entity = 'of' GROUP BY ALL), x AS (SELECT container, ordinal FROM o WHERE entity = 'to')
SELECT l.container, count(*) AS later FROM l JOIN x ON l.container = x.container AND l.at < x.ordinal GROUP BY ALL""")
def interval_precedes(spark: SparkSession, d: str) -> DataFrame:
    occ = occurrence.tokens(table(spark, d, "documents"), "doc_id", F.lower("text"))
    left = occ.filter("entity = 'of'").groupBy("container").agg(F.min("ordinal").alias("first")).withColumn("last", F.col("first"))
    right = occ.filter("entity = 'to'").select("container", F.col("ordinal").alias("first"), F.col("ordinal").alias("last"))
    return occurrence.precedes(left, right).groupBy("container").agg(F.count("*").alias("later"))


@registered("SELECT doc_id, text IS NOT DISTINCT FROM array_to_string(string_split(text, ' '), ' ') AS exact FROM documents")
def readback_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every text, taken apart into ordered pieces, and put together again from them, in any order of rows.

    Texts are told apart by id and digest, so that ids that are shared or null don't mix their pieces.  They are dealt
    before they are taken apart: pieces stay in the task of their text.
    """
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_digest"), "text")
    dealt = occurrence.dealt(docs, ["_id", "_digest"], "text")
    pieces = dealt.select("_id", "_digest", F.posexplode(F.split("text", " ")).alias("ordinal", "piece"))
    again = pieces.groupBy("_id", "_digest").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("ordinal", "piece"))), lambda x: x["piece"]), " ").alias("again"))
    mine = again.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"), "again")
    return dealt.join(mine, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_digest").eqNullSafe(F.col("_d")), "left").select(F.col("_id").alias("doc_id"), F.col("text").eqNullSafe(F.col("again")).alias("exact"))


@registered()
def blake3_atoms(spark: SparkSession, d: str) -> DataFrame:
    """BLAKE3 atom ids of every distinct character of the documents, with its occurrences."""
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("c")).filter("c != ''").groupBy("c").agg(F.count("*").alias("n"))
    return chars.select(F.ascii("c").alias("position"), "n").select("position", "n", F.lower(F.hex(ident.atom_id("position"))).alias("atom_id"))


@registered("SELECT doc_id, length_grapheme(coalesce(text, '')) AS graphemes FROM documents")
def grapheme_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", segments.grapheme_count("text").alias("graphemes"))


@registered()
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    """User-perceived characters, words and sentences of every document."""
    return table(spark, d, "documents").select("doc_id", segments.segment_counts("text").alias("n")).select("doc_id", "n.*")
