"""Strict tabular sources: delimited and fixed-width records without quoting, any deviation failing the artifact."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERMINATORS = {"lf": "\n", "crlf": "\r\n"}


class MalformedArtifact(ValueError):
    """An artifact breaks its declaration; nothing of it is admitted."""


class Delimited(NamedTuple):
    columns: tuple[str, ...]
    delimiter: str = "\t"
    terminator: str = "lf"
    header: bool = False


def _lines(spark: SparkSession, path: str, terminator: str) -> DataFrame:
    # splits by LF whatever the declaration, so that a stray CR is seen
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("artifact"))


def _edges(spark: SparkSession, path: str, head: int = 0) -> list[tuple[str, bytes, int]]:
    """(name, first ``head`` bytes, last byte) of the files under ``path`` that aren't empty, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in system.listStatus(root):
        size, name = status.getLen(), status.getPath().getName()
        if status.isFile() and size and name[0] not in "._":
            stream = system.open(status.getPath())
            first = bytes(stream.readNBytes(min(head, size)))
            stream.seek(size - 1)
            out.append((status.getPath().toString(), first, stream.read()))
            stream.close()
    return out


def scan_delimited(spark: SparkSession, path: str, form: Delimited) -> DataFrame:
    """Records of all artifacts under ``path`` as strings, in a plan that splits files of any size.

    Every record ends with the declared terminator, has the declared number of fields, and is UTF-8.  With a header the
    first record of every file that isn't empty must equal the declared columns; records that equal it further on are
    data.  Quotes are ordinary characters.
    """
    if len(form.delimiter.encode()) != 1:
        raise ValueError("the delimiter is one byte")
    header = (form.delimiter.join(form.columns) + TERMINATORS[form.terminator]).encode()
    for name, first, last in _edges(spark, path, len(header)):
        if last != 10:
            raise MalformedArtifact(f"the last record has no terminator: {name}")
        if form.header and first != header:
            raise MalformedArtifact(f"the header isn't the declared one: {name}")
    rows = _lines(spark, path, form.terminator)
    fields = F.split("body", f"\\Q{form.delimiter}\\E", -1)
    crlf = form.terminator == "crlf"
    body = F.expr("substring(value, 1, length(value) - 1)") if crlf else F.col("value")
    ends = F.endswith("value", F.lit("\r")) if crlf else ~F.endswith("value", F.lit("\r"))
    seen = rows.select("artifact", body.alias("body"), ends.alias("ends"), F.is_valid_utf8("value").alias("valid")).withColumn("fields", fields)
    fault = F.when(~F.col("valid"), "encoding").when(~F.col("ends"), "terminator").when(F.size("fields") != len(form.columns), "column_count")
    checked = seen.withColumn("fault", fault)
    if (first := checked.filter("fault is not null").select("artifact", "fault").first()) is not None:
        raise MalformedArtifact(f"{first['fault']}: {first['artifact']}")
    if form.header:
        names = F.array(*map(F.lit, form.columns))
        # records that equal the header are alike, so it doesn't matter which of a file's is taken away
        alike = checked.filter(F.col("fields") == names).groupBy("artifact").agg(F.count("*").alias("n"))
        again = alike.filter("n > 1").select("artifact", F.explode(F.sequence(F.lit(2).cast("bigint"), "n")).alias("k"), names.alias("fields"))
        checked = checked.filter(F.col("fields") != names).select("artifact", "fields").unionByName(again.select("artifact", "fields"))
    return checked.select("artifact", *[F.element_at("fields", k + 1).alias(c) for k, c in enumerate(form.columns)])


def field_spans(spark: SparkSession, path: str, form: Delimited) -> DataFrame:
    """(artifact, record, column, start, end, value): every field with its byte range, for declared small artifacts."""
    end = TERMINATORS[form.terminator].encode()
    mark, width = form.delimiter.encode(), len(form.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for artifact, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content and not content.endswith(end):
                    raise MalformedArtifact(f"the last record has no terminator: {artifact}")
                out, at = [], 0
                for number, line in enumerate(content.split(end)[:-1]):
                    fields = line.split(mark)
                    if len(fields) != width or b"\n" in line:
                        raise MalformedArtifact(f"column_count: {artifact}")
                    for k, value in enumerate(fields):
                        out.append((artifact, number, k, at, at + len(value), value.decode("utf-8")))
                        at += len(value) + 1
                    at += len(end) - 1
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["artifact", "record", "column", "start", "end", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "artifact string, record bigint, column int, start bigint, end bigint, value string")


class Field(NamedTuple):
    name: str
    width: int
    trim: str = "right"  # of the semantic value: left, right, both or none


def scan_fixed_width(spark: SparkSession, path: str, fields: tuple[Field, ...], overflow: str | None = None, extra: int = 0) -> DataFrame:
    """Fixed-width records by bytes; one declared field may overflow by up to ``extra``, witnessed by its excess.

    The last record needs its terminator too, and every field by itself must be UTF-8, so that a width that cuts a
    character in two is told.
    """
    total = sum(f.width for f in fields)
    for name, _, last in _edges(spark, path):
        if last != 10:
            raise MalformedArtifact(f"the last record has no terminator: {name}")
    rows = _lines(spark, path, "lf").withColumn("value", F.col("value").cast("binary")).withColumn("excess", F.octet_length("value") - total)
    bound = F.lit(extra if overflow else 0)
    if (first := rows.filter((F.col("excess") < 0) | (F.col("excess") > bound)).first()) is not None:
        raise MalformedArtifact(f"record width: {first['artifact']}")
    trims = {"left": F.ltrim, "right": F.rtrim, "both": F.trim, "none": lambda c: c}
    at, shift, out = 1, F.lit(0), []
    for f in fields:
        size = F.lit(f.width) + F.col("excess") if f.name == overflow else F.lit(f.width)
        out.append((f, F.substring(F.col("value"), F.lit(at) + shift, size).cast("string")))
        at += f.width
        shift = F.col("excess") if f.name == overflow else shift
    cut = rows.filter(~functools.reduce(lambda a, b: a & b, [F.is_valid_utf8(c) for _, c in out]))
    if (first := cut.first()) is not None:
        raise MalformedArtifact(f"encoding: {first['artifact']}")
    return rows.select("artifact", *[trims[f.trim](c).alias(f.name) for f, c in out], F.col("excess").alias("overflow_excess"))
