"""Versioned tables with atomic activation, idempotent appends and reads that are pinned to an epoch.

Parts are written into directories of their own and stay inert until an epoch names them.  Epoch n is the small object
``_EPOCH-n`` with the list of its parts, and gets its name by a rename that fails if the name is taken: of two writers
that expect the same epoch one wins, and readers see either epoch whole.  An append writes its own rows only and names
the earlier parts again.  Old epochs stay readable until ``expire`` deletes them.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.resolve import missing, unique


class StaleEpoch(RuntimeError):
    """The active epoch isn't the one that the writer expected."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self) -> list[int]:
        where = self._path(self.path)
        if not self._fs.exists(where):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(where)]
        return sorted(int(n.removeprefix("_EPOCH-")) for n in names if n.startswith("_EPOCH-"))

    def _parts(self, epoch: int) -> list[str]:
        if epoch == 0:
            return []
        stream = self._fs.open(self._path(f"{self.path}/_EPOCH-{epoch:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def epoch(self) -> int:
        """The active epoch; 0 before the first activation."""
        return max(self._epochs(), default=0)

    def current(self) -> dict:
        """The active epoch and the parts of its version; epoch 0 without one before the first activation."""
        epoch = self.epoch()
        return {"epoch": epoch, "version": self._parts(epoch) or None}

    def stage(self, df: DataFrame) -> str:
        """Writes an inert part and returns its name."""
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{part}")
        return part

    def activate(self, parts: str | list[str], expected_epoch: int) -> int:
        """Makes the next epoch of a staged part, or several, if ``expected_epoch`` is the active one; returns it."""
        if self.epoch() != expected_epoch:
            raise StaleEpoch(f"epoch {self.epoch()} is active, not {expected_epoch}")
        own = self._path(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._fs.create(own)
        stream.write(bytearray(json.dumps([parts] if isinstance(parts, str) else parts).encode()))
        stream.close()
        # whole before it has its name; a rename onto a name that exists fails, as does the creation where renames copy
        if not self._renamed(own, self._path(f"{self.path}/_EPOCH-{expected_epoch + 1:012d}")):
            self._fs.delete(own, False)
            raise StaleEpoch("another writer was faster")
        return expected_epoch + 1

    def _renamed(self, own, target) -> bool:
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else self._fs.getUri())
        array = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        try:
            context.rename(own, target, array)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def abort(self, part: str) -> None:
        """Removes a part that no epoch names."""
        if not any(part in self._parts(n) for n in self._epochs()):
            self._fs.delete(self._path(f"{self.path}/{part}"), True)

    def read(self, epoch: int | None = None) -> DataFrame:
        """An epoch's rows, the active one's unless told, pinned now: later activations don't change what this frame reads."""
        return self.spark.read.parquet(*[f"{self.path}/{part}" for part in self._parts(self.epoch() if epoch is None else epoch)])

    def append_missing(self, rows: DataFrame, key: list[str]) -> int:
        """Adds the rows whose key isn't stored, as a further part of a new epoch; a replay adds nothing."""
        now = self.epoch()
        parts = self._parts(now)
        part = self.stage(missing(rows, self.read(now), key) if parts else unique(rows, key))
        if parts and self.spark.read.schema(rows.schema).parquet(f"{self.path}/{part}").isEmpty():
            self.abort(part)
            return now
        return self.activate([*parts, part], now)

    def expire(self, keep: int = 1) -> None:
        """Deletes all but the last ``keep`` epochs, and the parts that only they name."""
        epochs = self._epochs()
        gone, left = epochs[:-keep], epochs[-keep:]
        held = {part for n in left for part in self._parts(n)}
        for part in {part for n in gone for part in self._parts(n)} - held:
            self._fs.delete(self._path(f"{self.path}/{part}"), True)
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/_EPOCH-{n:012d}"), False)
