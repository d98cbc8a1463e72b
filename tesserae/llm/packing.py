"""Best-fit-decreasing packing of token ids into windows, and its binary form.

Each task packs the documents it reads in groups of ``GROUP_TOKENS`` tokens at least, so memory is bounded whatever
the size of a partition, and nothing is shuffled.  Inside a group, overlong documents are first cut into full
windows; the rests go, longest first, into the tightest open window, found by a segment tree over remaining
capacities.  Every id lies in exactly one piece.

Ids are those of the vocabulary file, special tokens that occur in texts included, as the library encodes them.  A
null text counts as empty and has just the end id; rows that repeat are packed as often as they occur; null ids stay
null; further columns aren't read, whatever their names; documents of equal length go in the order in which they are
read; texts of any length are cut into windows; an empty table gives no rows and no shards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tesserae.llm.bpe import encode_with_ends, encoder_of, specials_of
from tesserae.llm.shared import clash_free, small
from tesserae.llm.storage import Store
from tesserae.llm.wordgrid import chunks

#: Tokens that are gathered before they are packed together; about 4 MB of ids.
GROUP_TOKENS = 1_000_000
#: Bytes of ids after which a shard is closed; shards hold whole groups and end with their task.
SHARD_BYTES = 256_000_000


class CapacityTree:
    """Open windows by remaining capacity: the leaf of a capacity counts them, inner nodes hold sums."""

    def __init__(self, window: int):
        self.leaves = 1 << max(1, window.bit_length())
        self.total = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.total[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least capacity of ``size`` or more, and that capacity; it leaves the tree."""
        total, node = self.total, self.leaves + size
        while not total[node]:  # up, as long as there is nothing at or right of the leaf below this node
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if total[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            total[node] -= 1
            node >>= 1
        return self.windows[capacity].pop(), capacity


class Pieces(NamedTuple):
    """One row per piece: document, its start there, length, window, offset in the window."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: int


def best_fit(sizes: Sequence[int], window: int) -> Pieces:
    """Packs documents of ``sizes`` (over 0) into windows; ties go in the order of the documents."""
    size = np.asarray(sizes, np.int64)
    full, rest = size // window, size % window
    doc = np.repeat(np.arange(len(size)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * window
    n = len(doc)
    short = np.flatnonzero(rest)
    order = short[np.argsort(-rest[short], kind="stable")]
    tree = CapacityTree(window)
    where, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    opened = n
    for k, need in enumerate(rest[order].tolist()):
        found = tree.take(need)
        if found is None:
            found, opened = (opened, window), opened + 1
        target, capacity = found
        where[k], offset[k] = target, window - capacity
        if capacity > need:
            tree.put(target, capacity - need)
    return Pieces(np.concatenate((doc, order)), np.concatenate((start, full[order] * window)), np.concatenate((np.full(n, window), rest[order])), np.concatenate((np.arange(n), where)), np.concatenate((np.zeros(n, np.int64), offset)), opened)


class Group(NamedTuple):
    ids: np.ndarray  # uint32, all documents, one after the other, each with its end id
    first: np.ndarray
    keys: pa.Array
    pieces: Pieces


def packed_groups(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, group_tokens: int) -> Iterator[Group]:
    encoder, specials = encoder_of(path), specials_of(path)
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    keys: list[pa.Array] = []
    tokens = 0

    def group() -> Group:
        size = np.concatenate(sizes)
        return Group(np.concatenate(held), np.concatenate(([0], np.cumsum(size))), pa.concat_arrays(keys), best_fit(size, window))

    for batch in small(batches):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in chunks(texts):
            ids, first = encode_with_ends(encoder, specials, texts[a:b], end_id)
            held.append(ids)
            sizes.append(np.diff(first))
            keys.append(batch.column(0).slice(a, b - a))
            tokens += len(ids)
            if tokens >= group_tokens:
                yield group()
                held, sizes, keys, tokens = [], [], [], 0
    if held:
        yield group()


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, group_tokens: int = GROUP_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: document, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the task's partition times 2**40 plus a running number, so that it is unique and a task that
    runs again gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for ids, first, keys, p in packed_groups(batches, tokenizer_path, window, end_id, group_tokens):
            raw, at = memoryview(ids.astype("<u4").tobytes()), first[p.doc] + p.start
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + p.length).tolist(), strict=True)]
            columns = [keys.take(pa.array(p.doc)), *map(pa.array, (p.start, p.length, np.array(crc, np.int64), np.diff(first)[p.doc], base + p.window, p.offset))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += p.windows

    kind = docs.schema[id_column].dataType.simpleString()
    ddl = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return clash_free(docs, [id_column, text_column]).mapInArrow(run, ddl).withColumnRenamed("id", id_column)


class _Shard:
    """Three growing files, of which rows of ids are appended a group at a time."""

    def __init__(self, store: Store, own: dict[str, str], kind: np.dtype, window: int, pad_id: int):
        self.store, self.own, self.kind, self.window, self.pad_id = store, own, kind, window, pad_id
        self.files = {ending: store.create(path) for ending, path in own.items()}
        self.digests = {ending: hashlib.sha256() for ending in own}
        self.sequences, self.cells, self.size = 0, 0, 0  # rows, cumulative lengths, and bytes of ids so far
        self.groups: list[tuple[pa.Array, np.ndarray, np.ndarray, int]] = []

    def _append(self, ending: str, data: bytes) -> None:
        self.files[ending].write(data)
        self.digests[ending].update(data)

    def add(self, group: Group) -> None:
        ids, first, keys, p = group
        matrix = np.full(p.windows * self.window, self.pad_id, self.kind)
        by_place = np.lexsort((p.offset, p.window))
        doc, start, length, row, offset = (x[by_place] for x in p[:5])
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        matrix[np.repeat(row * self.window + offset, length) + within] = ids[np.repeat(first[doc] + start, length) + within]
        segments = np.bincount(row, minlength=p.windows)
        rows = np.concatenate(([0], np.cumsum(segments + 1)))
        cumulative = np.zeros(rows[-1], "<i4")  # each row: 0, then the end of each segment
        cumulative[np.arange(len(row)) + row + 1] = offset + length
        self._append(".ids", matrix.tobytes())
        self._append(".cu", cumulative.tobytes())
        self._append(".rows", (self.cells + rows[:-1]).astype("<i8").tobytes())
        self.groups.append((keys.take(pa.array(doc)), start, segments, p.windows))
        self.sequences += p.windows
        self.cells += int(rows[-1])
        self.size += matrix.nbytes

    def close(self, base: int) -> Iterator[pa.RecordBatch]:
        """Publishes the files and yields a row per sequence, read back from them."""
        self._append(".rows", np.array([self.cells], "<i8").tobytes())
        for file in self.files.values():
            file.close()
        name = hashlib.sha256(b"".join(self.digests[e].digest() for e in sorted(self.digests))).hexdigest()[:40]
        for ending, path in self.own.items():
            self.store.publish(path, name + ending)
        all_cu, all_begin = np.frombuffer(self.store.read(f"{name}.cu"), "<i4"), np.frombuffer(self.store.read(f"{name}.rows"), "<i8")
        with self.store.open(f"{name}.ids") as file:
            at_row, wide = 0, self.window * self.kind.itemsize
            for keys, start, segments, windows in self.groups:
                stored = np.frombuffer(file.read_at(windows * wide, at_row * wide), self.kind).reshape(-1, self.window)
                begin = all_begin[at_row : at_row + windows + 1]
                cu, begin = all_cu[begin[0] : begin[-1]], begin - begin[0]
                n = cu[begin[1:] - 1]
                crc = [zlib.crc32(stored[k, : n[k]].astype("<u4").tobytes()) for k in range(windows)]
                at = np.concatenate(([0], np.cumsum(segments))).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(at), values)  # noqa: B023, E731
                is_end = np.ones(len(cu), bool)
                is_end[begin[1:] - 1] = False  # a segment begins at each cumulative length but a row's last
                row = at_row + np.arange(windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base + row), pa.array([name] * windows, pa.string()), pa.array(row), pa.array(n.astype(np.int64)), lists(keys), lists(pa.array(start)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(cu)), lists(pa.array(cu[is_end])), pa.array(crc, pa.int64())],
                    ["sequence_id", "shard", "row", "n_tokens", "ids", "starts", "cu_seqlens", "position_resets", "ids_crc32"],
                )
                at_row += windows


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, window: int = 1024, end_id: int = 0, pad_id: int | None = None, group_tokens: int = GROUP_TOKENS, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs, writes binary shards under ``folder`` and returns one row per sequence, read back from them.

    A shard is three files: ``.ids`` (a matrix of ``window`` columns of little-endian 16-bit ids, 32-bit if the
    vocabulary needs them, padded with ``pad_id``, by default the first id that the vocabulary doesn't have), ``.cu``
    (32-bit cumulative segment lengths of each row from 0 on) and ``.rows`` (64-bit begin of each row in ``.cu``, and
    the end).  Positions restart at 0 wherever a cumulative length says that a segment begins, and padding follows the
    last one; ``position_resets`` has those places.  Groups are appended to a shard of ``shard_bytes`` or so, and a task
    holds one group of ids at a time.  A shard's name is the digest of all three files, so writing it again after a
    lost task changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        base = TaskContext.get().partitionId() << 40
        size = max([encoder_of(tokenizer_path).pieces.size, end_id + 1, *(i + 1 for i in specials_of(tokenizer_path).ids.values())])
        pad = size if pad_id is None else pad_id
        kind = np.dtype("<u2" if max(size - 1, pad) < 1 << 16 else "<u4")
        groups = packed_groups(batches, tokenizer_path, window, end_id, group_tokens)
        group = next(groups, None)
        while group is not None:
            with store.attempt(".ids", ".cu", ".rows") as own:
                shard = _Shard(store, own, kind, window, pad)
                while group is not None and shard.size < shard_bytes:
                    shard.add(group)
                    group = next(groups, None)
                yield from shard.close(base)
                base += shard.sequences

    kind = docs.schema[id_column].dataType.simpleString()
    ddl = f"sequence_id bigint, shard string, row bigint, n_tokens bigint, ids array<{kind}>, starts array<bigint>, cu_seqlens array<int>, position_resets array<int>, ids_crc32 bigint"
    return clash_free(docs, [id_column, text_column]).mapInArrow(run, ddl).withColumnRenamed("ids", f"{id_column}s")
