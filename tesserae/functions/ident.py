"""Content identities: domain-separated SHA-256 column expressions, and BLAKE3 for exact parity with published vectors.

Both back-ends follow one law.  An atom is the hash of its UTF-8-shaped bytes (surrogates included); a composite of
two or more children is the hash of the byte 1 and the child ids; a composite of one child is that child.  An id is
the first 16 bytes of its 32-byte witness.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_BYTES = 16
COMPOSITE = 1


def witness(*parts: Column) -> Column:
    """SHA-256 over the parts in hex, each followed by a separator, so that no two lists of parts run together."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("\u0000")), F.lit("\u001f")) for p in parts]), 256)


def record_id(domain: str, *parts: Column) -> Column:
    """The 32-hex-digit id of a record in a domain."""
    return F.substring(witness(F.lit(domain), *parts), 1, 2 * ID_BYTES)


def content_id(text: Column) -> Column:
    """The id of a text's bytes."""
    return F.substring(F.sha2(text, 256), 1, 2 * ID_BYTES)


def composite_id(children: Column) -> Column:
    """The id of an array of child ids in hex; one child is its own composite, none has no id."""
    joined = F.sha2(F.concat(F.lit("01"), F.array_join(children, "")), 256)
    return F.when(F.size(children) == 1, F.element_at(children, 1)).when(F.size(children) > 1, F.substring(joined, 1, 2 * ID_BYTES))


def set_fingerprint(ids: Column) -> Column:
    """An aggregate over ids in hex, copies counted, that doesn't depend on their order.

    Ids are added up as numbers, 60 bits at a time, so partial sums merge and no task holds a group's ids.
    """
    parts = [F.sum(F.conv(F.substring(ids, at, size), 16, 10).cast("decimal(38,0)")) for at, size in ((1, 15), (16, 15), (31, 2))]
    return F.sha2(F.concat_ws(":", F.count(ids).cast("string"), *[p.cast("string") for p in parts]), 256)


def sequence_fingerprint(ordinal: Column, ids: Column) -> Column:
    """An aggregate over ids in the order of their ordinals."""
    ordered = F.sort_array(F.collect_list(F.struct(ordinal.alias("o"), ids.alias("i"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["i"]), ""), 256)


# BLAKE3.  Fixed values, from its specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_M32 = 0xFFFFFFFF


def _compress(chain: tuple[int, ...], block: bytes, counter: int, length: int, flags: int) -> list[int]:
    words = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*chain, *_IV[:4], counter & _M32, counter >> 32, length, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for add, turn_d, turn_b in ((x, 16, 12), (y, 8, 7)):
            s[a] = (s[a] + s[b] + add) & _M32
            s[d] ^= s[a]
            s[d] = (s[d] >> turn_d | s[d] << (32 - turn_d)) & _M32
            s[c] = (s[c] + s[d]) & _M32
            s[b] ^= s[c]
            s[b] = (s[b] >> turn_b | s[b] << (32 - turn_b)) & _M32

    for _ in range(7):
        for k in range(4):
            mix(k, k + 4, k + 8, k + 12, words[2 * k], words[2 * k + 1])
        for k in range(4):
            mix(k, (k + 1) % 4 + 4, (k + 2) % 4 + 8, (k + 3) % 4 + 12, words[2 * k + 8], words[2 * k + 9])
        words = [words[p] for p in _PERMUTATION]
    return [a ^ b for a, b in zip(s[:8], s[8:], strict=True)]


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash."""

    def chunk(piece: bytes, number: int, root: int) -> tuple[int, ...]:
        chain: tuple[int, ...] = _IV
        blocks = [piece[k : k + 64] for k in range(0, len(piece), 64)] or [b""]
        for k, block in enumerate(blocks):
            last = k == len(blocks) - 1
            chain = tuple(_compress(chain, block, number, len(block), _CHUNK_START * (k == 0) | (_CHUNK_END | root) * last))
        return chain

    def tree(first: int, pieces: list[bytes], root: int) -> tuple[int, ...]:
        if len(pieces) == 1:
            return chunk(pieces[0], first, root)
        half = 1 << (len(pieces) - 1).bit_length() - 1
        both = struct.pack("<16I", *tree(first, pieces[:half], 0), *tree(first + half, pieces[half:], 0))
        return tuple(_compress(_IV, both, 0, 64, _PARENT | root))

    pieces = [data[k : k + 1024] for k in range(0, len(data), 1024)] or [b""]
    return struct.pack("<8I", *tree(0, pieces, _ROOT))


def encode_position(position: int) -> bytes:
    """The UTF-8-shaped bytes of any code point up to U+10FFFF, surrogates too."""
    if not 0 <= position <= 0x10FFFF:
        raise ValueError(f"no code point: {position}")
    return chr(position).encode("utf-8", "surrogatepass")


@functools.lru_cache(1 << 16)
def atom_witness(position: int) -> bytes:
    return blake3(encode_position(position))


def composite(children: Iterable[bytes]) -> bytes:
    """The 16-byte id of a sequence of child ids."""
    ids = list(children)
    if not ids:
        raise ValueError("a composite has a child at least")
    return ids[0] if len(ids) == 1 else blake3(bytes([COMPOSITE]) + b"".join(ids))[:ID_BYTES]


def composite_runs(runs: Iterable[tuple[bytes, int]]) -> bytes:
    """The id of runs of equal children; it is that of the expanded sequence."""
    return composite(child for child, count in runs for _ in range(count))


def text_identity(text: str) -> bytes:
    return composite(atom_witness(ord(c))[:ID_BYTES] for c in text)


@F.pandas_udf(T.BinaryType())
def atom_id(positions: pd.Series) -> pd.Series:
    """BLAKE3 atom ids of code points."""
    return positions.map(lambda p: atom_witness(int(p))[:ID_BYTES])


@F.pandas_udf(T.BinaryType())
def blake3_text_id(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: text_identity(t) if t else None)
