"""Raw octet artifacts: exact bytes, verified against a manifest, and recomposed bit by bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, digest, content) of the files under ``path``; links and paths out of it aren't followed by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"), "content")


def verification(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state): exact, missing, undeclared, or differing in size or digest; both sides stay visible."""
    declared = manifest.select(F.col("name").alias("_name"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    both = found.select("name", "bytes", "digest").join(declared, F.col("name") == F.col("_name"), "full_outer")
    state = F.when(F.col("name").isNull(), "missing").when(F.col("_name").isNull(), "undeclared").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("digest") != F.col("_digest"), "digest").otherwise("exact")
    return both.select(F.coalesce("name", "_name").alias("name"), state.alias("state"))


def recomposed(spans: DataFrame) -> DataFrame:
    """(artifact, content): spans (artifact, start, content) put together again; they must tile the artifact."""
    pieces = F.sort_array(F.collect_list(F.struct("start", "content")))
    text = F.aggregate(pieces, F.lit(b""), lambda acc, p: F.concat(acc, p["content"]))
    return spans.groupBy("artifact").agg(text.alias("content"))
