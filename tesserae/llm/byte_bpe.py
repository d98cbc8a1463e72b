"""Byte-level BPE encoding and decoding of a document table.

Null texts count as empty; an empty text has no ids, and the digests of no bytes.  Repeated rows, null ids and
further columns are no special case: every row is encoded by itself, and only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.bpe import Decoder, encoder_of, read_ranks
from tesserae.llm.shared import clash_free, small
from tesserae.llm.wordgrid import chunks


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids array<int>`` of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks_path)
        for batch in small(batches):
            texts = _texts(batch.column(1))
            for a, b in chunks(texts):
                ids, first = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = clash_free(docs, [id_column, text_column]).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``bytes binary`` of every row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(ranks_path))
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            data, at = decoder.decode(np.fromiter((i for x in lists for i in x), np.int64, int(count.sum())))
            first = at[np.concatenate(([0], np.cumsum(count)))]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "bytes"])

    kind = encoded.schema[id_column].dataType.simpleString()
    out = clash_free(encoded, [id_column, ids_column]).mapInArrow(run, f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_column)


def digests(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and returns the count of ids and both digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks_path)
        decoder = Decoder(read_ranks(ranks_path))
        for batch in small(batches):
            texts = _texts(batch.column(1))
            counts, of_ids, of_bytes = [], [], []
            for a, b in chunks(texts):
                ids, first = encoder.encode(texts[a:b])
                data, at = decoder.decode(ids)
                raw_ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    counts.append(y - x)
                    of_ids.append(hashlib.sha256(raw_ids[4 * x : 4 * y]).hexdigest())
                    of_bytes.append(hashlib.sha256(raw[at[x] : at[y]]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = clash_free(docs, [id_column, text_column]).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)
