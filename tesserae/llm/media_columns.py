"""Media columns: content-addressed payloads in tar shards.

Tasks store each distinct payload of a shard once, as a greyscale PNG of 8-bit samples, 64 to a line, under its
digest; rows carry shard, digest, offset and length.  ``with_metadata`` fills width, height and sample columns from
range reads of the 33 header bytes alone; ``read_back`` reads the whole stored object back.  A shard's name is
the digest of its bytes, so a task that runs again writes the same object.  A null text counts as empty; an empty
payload is one line of zeros.  Equal texts have equal digests wherever they are stored; a copy is stored once in each
shard that needs it.  Null ids stay null, further columns aren't read, rows that repeat give rows that repeat, and an
empty table gives no rows and no shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.shared import clash_free, small, utf8
from tesserae.llm.storage import Store

#: Samples in a line, and the bytes to a multiple of which payloads are padded.
LINE = 64
#: Bytes of stored media after which a shard is closed; a task holds one shard in memory.
SHARD_BYTES = 16_000_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def pad(payload: bytes) -> bytes:
    lines = max(1, -(-len(payload) // LINE))
    return payload.ljust(lines * LINE, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png(samples: bytes, level: int = 1) -> bytes:
    """Samples (a multiple of ``LINE``) as a PNG file."""
    height = len(samples) // LINE
    lines = np.zeros((height, LINE + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, LINE)
    header = struct.pack(">IIBBBBB", LINE, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first bytes of a PNG file."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", data[16:25])


def png_samples(data: bytes) -> bytes:
    """The samples of a file that ``png`` made."""
    width, height, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A 64-bit mean hash in hex: a bit for each column of samples whose mean is over that of all."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, LINE)
    sums = lines.sum(axis=0, dtype=np.int64)
    return np.packbits(sums * LINE > sums.sum()).tobytes().hex()


def store_payloads(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes tar shards under ``folder``; per row: id, n_bytes, payload_sha256 (the address), shard, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        parts: list[bytes] = []
        placed: dict[str, tuple[int, int]] = {}
        keys: list[pa.Array] = []
        rows: list[tuple[int, str, int, int]] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = store.write(b"".join([*parts, bytes(1024)]), ".tar")
            n, digest, offset, length = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array([name] * len(n), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["id", "n_bytes", "payload_sha256", "shard", "offset", "length"])

        for batch in small(batches):
            begin = 0
            for k, text in enumerate(utf8(batch.column(1))):
                payload = pad(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in placed:
                    media = png(payload)
                    entry = tarfile.TarInfo(f"{digest}.png")
                    entry.size = len(media)
                    parts += [entry.tobuf(tarfile.USTAR_FORMAT), media, bytes(-len(media) % 512)]
                    placed[digest] = (size + 512, len(media))
                    size += 512 + len(media) + -len(media) % 512
                rows.append((len(text), digest, *placed[digest]))
                if size >= SHARD_BYTES:
                    keys.append(batch.column(0).slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield close()
                    parts, placed, keys, rows, size = [], {}, [], [], 0
            if begin < batch.num_rows:
                keys.append(batch.column(0).slice(begin))
        if rows:
            yield close()

    kind = docs.schema[id_column].dataType.simpleString()
    out = clash_free(docs, [id_column, text_column]).mapInArrow(run, f"id {kind}, n_bytes bigint, payload_sha256 string, shard string, offset bigint, length bigint")
    return out.withColumnRenamed("id", id_column)


def _by_shard(batch: pa.RecordBatch, store: Store) -> Iterator[tuple[int, pa.NativeFile, int, int]]:
    name, file = None, None
    for k, (shard, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)):
        if shard != name:
            if file is not None:
                file.close()
            name, file = shard, store.open(shard)
        yield k, file, offset, length
    if file is not None:
        file.close()


def with_metadata(stored: DataFrame, folder: str) -> DataFrame:
    """Adds width, height, sample_bits and payload_bytes from range reads of the headers; no payload is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            seen = [png_header(file.read_at(HEADER_BYTES, offset)) for _, file, offset, _ in _by_shard(batch, store)]
            width, height, bits = (np.array([x[i] for x in seen], np.int64) for i in range(3))
            columns = [pa.array(x) for x in (width, height, bits, width * height * bits // 8)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "sample_bits", "payload_bytes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{fields}, width bigint, height bigint, sample_bits bigint, payload_bytes bigint")


def read_back(stored: DataFrame, folder: str) -> DataFrame:
    """``with_metadata``, and from the stored bytes: read_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            out = []
            for _, file, offset, length in _by_shard(batch, store):
                width, height, bits = png_header(file.read_at(HEADER_BYTES, offset))
                media = file.read_at(length, offset)
                samples = png_samples(media)
                out.append((width, height, bits, width * height * bits // 8, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            names = ["width", "height", "sample_bits", "payload_bytes", "read_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{fields}, width bigint, height bigint, sample_bits bigint, payload_bytes bigint, read_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
