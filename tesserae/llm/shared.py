"""What the training-data operators share: the shared folder, written tables, and Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this machine, as in local tests, a temporary folder is set and used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tesserae-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def folders_made() -> int:
    """How many folders this process has made, as a mark for ``clear_folders``."""
    return len(_made)


def clear_folders(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the folders made since a mark, but for ``keep``, once no frame that reads them is needed any more."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = [p for p in _made[since:] if p != keep]
    _made[since:] = [p for p in _made[since:] if p == keep]
    for name in gone:
        path = paths(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and a lost executor
    costs no recomputation."""
    return written_to(df, fresh_folder(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder; for small intermediate results of loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole_text(name: str = "text") -> F.Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can: idle Python workers live beside busy ones."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about ``limit`` bytes of a text column each, one row at least.

    Texts become Python objects and work arrays a slice at a time, so a worker's memory doesn't follow Spark's batches.
    """
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        begin, held = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, held + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin, held = end, int(size[end - 1])
        _give_back()


def clash_free(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the ``wanted`` columns of ``df``: extra ones, however named, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def single_labels(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """(label_id, label): one row per id that is labelled 0 or 1; repeated labels count once, contradictory ones not at all."""
    valid = clash_free(labels, [id_column, label_column]).toDF("label_id", "label").filter(F.col("label_id").isNotNull() & F.col("label").isin(0, 1))
    return valid.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
