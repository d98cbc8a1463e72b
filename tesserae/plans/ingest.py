"""Queries for sources and sinks: strict scans, bundles, providers, versioned tables, receipts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.closure import shared_folder
from tesserae.plans import registry
from tesserae.plans.catalog import registered, table
from tesserae.sources import bundle, providers, store, tabular


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@registered("SELECT CAST(s_suppkey AS BIGINT) AS suppkey, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as tab-separated records and scanned again under the strict grammar."""
    path = _folder(spark, "delimited")
    table(spark, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))).write.text(path)
    rows = tabular.scan_delimited(spark, path, tabular.Delimited(("suppkey", "name", "nation")))
    return rows.select(F.col("suppkey").cast("bigint"), "name", F.col("nation").cast("bigint"))


@registered("SELECT c_custkey, c_name, CAST(greatest(length(c_name) - 16, 0) AS BIGINT) AS excess FROM customer")
def fixed_width_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "fixed")
    name = F.when(F.length("c_name") < 16, F.rpad("c_name", 16, " ")).otherwise(F.col("c_name"))
    table(spark, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), name)).write.text(path)
    rows = tabular.scan_fixed_width(spark, path, (tabular.Field("key", 12, "left"), tabular.Field("name", 16)), overflow="name", extra=200)
    return rows.select(F.col("key").cast("bigint").alias("c_custkey"), F.col("name").alias("c_name"), F.col("overflow_excess").cast("bigint").alias("excess"))


@registered("SELECT 'exact' AS state, count(DISTINCT n_regionkey) AS n FROM nation")
def bundle_verification(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "bundle")
    table(spark, d, "nation").coalesce(1).select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    found = bundle.artifacts(spark, path)
    keyed = found.withColumn("name", F.col("digest"))
    return bundle.verification(keyed, keyed.select("name", "bytes", "digest")).groupBy("state").agg(F.count("*").alias("n"))


@registered("SELECT page_id, t.tag AS tag, count(*) AS n FROM pages, LATERAL (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag) t GROUP BY ALL")
def page_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, d, "pages").select("page_id", tags.alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@registered()
def page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Pages taken apart by the HTML provider, and their texts by the text provider in turn."""
    roots = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("artifact"), F.lit("text/html").alias("media"), F.encode("html", "UTF-8").alias("content"))
    return providers.decompose(roots).groupBy("artifact", "provider", "kind").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("length"))


@registered("SELECT o_custkey % 100 AS k, max(o_custkey) AS top FROM orders GROUP BY ALL")
def versioned_appends(spark: SparkSession, d: str) -> DataFrame:
    """Two batches appended to a versioned table; the second is replayed, which changes nothing."""
    versions = store.VersionedTable(spark, _folder(spark, "versioned"))
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.max("o_custkey").alias("top"))
    versions.append_missing(rows.filter("k % 2 = 0"), ["k"])
    epoch = versions.append_missing(rows, ["k"])
    if versions.append_missing(rows, ["k"]) != epoch:
        raise RuntimeError("a replay changed the table")
    return versions.read()


@registered("SELECT 'reference_topology_resolve_batch' AS operation, CAST(393219 AS BIGINT) AS opcode, count(*) AS rows_in, count(*) AS rows_out FROM customer")
def execution_receipt(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda v, n: F.lit(v).alias(n)
    batch = table(spark, d, "customer").select(lit("a", "authority"), lit("r", "release"), lit("nation", "namespace"), F.col("c_nationkey").cast("string").alias("local_identifier"), lit("1", "version"), lit(7, "kind"), lit(1, "rule_flags"))
    _, receipt = registry.execute("reference_topology_resolve_batch", batch)
    return receipt.select("operation", F.col("opcode").cast("bigint").alias("opcode"), "rows_in", "rows_out")
