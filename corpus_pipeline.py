"""A training corpus from raw documents: quality, language, near-duplicates, secrets, packing.

Every stage takes all rows that its predecessor kept; ``run`` writes each result as Parquet into the shared folder and
reads it again as the next stage's documents.  What a stage wrote for itself is deleted once its result is written.

All stages but the last return the columns of their input, extra ones of any name included.  Null texts count as
empty, rows with null ids stay rows of their own, texts are read whole, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import language_mixture, near_dup, packing, quality_qda, secret_scan
from tesserae.llm.queries import TOKENIZER, remainder
from tesserae.llm.shared import clear_folders, folders_made, fresh_folder, table, written, written_to


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the discriminant, learned from the labels, scores under 0.7.

    Null and empty texts are scored like others; repeated rows are judged alike and stay as often as they occur; without
    labels of both kinds all documents have one score.
    """
    # vectors are few bytes: they meet the labels, the texts stay where they are.  They are written first, so that the
    # Python of features and that of moments never share a task, whatever join Spark picks
    vectors = written(quality_qda.features(docs.filter(remainder(4) != 2)), "pipeline-vectors")
    return quality_qda.accepted(docs, quality_qda.fit(vectors, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, those of which no learned language has a third or so, and those in none of them.

    Null and empty texts have no letters and go; rows without a language are judged, but nothing is learned from them;
    repeated rows are judged alike; if no language can be learned all documents go.
    """
    return language_mixture.accepted(docs, language_mixture.learn(docs.filter(remainder(5) != 0)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component: that of the least id.

    Documents are told apart by id and text, so two texts under one id are two documents, and of rows that repeat both
    one stays.  Texts without words are copies of nothing; rows with null ids stay.
    """
    return near_dup.survivors(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind in brackets; n_chars follows the new text.

    Null texts become empty ones; of overlapping spans the first counts; repeated rows are treated alike.
    """
    return secret_scan.redact(docs, length_column="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 1024 tokens, one row per piece.

    Empty texts have an end id only; texts of over 1024 tokens are cut; extra columns aren't read; repeated rows, of
    which the stages before leave none, would be packed as often as they occur.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", deduplicate), ("secrets", secrets), ("packing", pack)]

#: SQL can't express the stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = folders_made()
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        docs = written_to(stage(spark, docs, sf_dir), path)
        clear_folders(spark, since=mark, keep=path)  # of what the stages wrote so far, only this result is read from now on
    return docs
