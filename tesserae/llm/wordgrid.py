"""Words and word shingles over batches of texts.

A *word* is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r.  These six are ASCII, so words can
be cut on UTF-8 bytes.  Inside a batch words are numbered by their bytes, and shingles by the numbers of their words,
so equality there never rests on a hash.  Where shingles must be known across batches, as for minima, their values
come from a keyed hash of each word that mixes 8 bytes a round, chained so that no place can be traded for another.
Such values only propose what is then compared by words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain, count
from typing import NamedTuple

import numpy as np

#: Words in one shingle.
SHINGLE = 5
#: The key of word hashes: any bytes do, as long as all tasks of a job use the same.
KEY = b"tesserae shingles"
#: Words of more bytes than this are hashed one by one, by a keyed digest.
LONG_WORD = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """The words of a batch: text ``d`` has those at ``first[d]:first[d + 1]``; ``distinct[ids[i]]`` is word ``i``."""

    ids: np.ndarray
    first: np.ndarray
    distinct: list[bytes]

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(texts: Sequence[bytes], lower: bool = False) -> Words:
    """Words of all texts, of which A-Z become a-z if ``lower``."""
    parts = [t.lower().split() if lower else t.split() for t in texts]  # bytes: ASCII letters and white space only
    first = np.cumsum([0, *map(len, parts)])
    words = list(chain.from_iterable(parts))
    numbers = dict(zip(dict.fromkeys(words), count(), strict=False))
    return Words(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), first, list(numbers))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of small numbers, from 0 on; equal pairs have equal numbers."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def window_starts(w: Words) -> np.ndarray:
    """The first words of all windows of ``SHINGLE`` words that lie inside one text."""
    text = w.text
    return np.flatnonzero(text[: len(text) - SHINGLE + 1] == text[SHINGLE - 1 :]) if len(text) >= SHINGLE else np.zeros(0, np.int64)


def window_numbers(w: Words, at: np.ndarray) -> np.ndarray:
    """A number for each window that begins at a place of ``at``, equal only where all words are equal."""
    if not len(at):
        return np.zeros(0, np.int64)
    number = w.ids[at]
    for k in range(1, SHINGLE):
        number = paired(number, w.ids[at + k])
    return number


def shingle_numbers(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as numbers that hold inside this batch.

    A text of fewer words than a shingle has its whole word sequence as its one shingle; a text without words has none.
    """
    w = split_words(texts, lower=True)
    at = window_starts(w)
    text, number = w.text[at], window_numbers(w, at)
    base = int(number.max(initial=0)) + 1
    cells = np.unique(text * base + number)
    bounds = np.searchsorted(cells, np.arange(len(texts) + 1) * base)
    out = [cells[a:b] % base for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    short: dict[bytes, int] = {}
    for d in np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < SHINGLE)).tolist():
        words = w.ids[w.first[d] : w.first[d + 1]].tobytes()
        out[d] = np.array([base + short.setdefault(words, len(short))])
    return out


def _keys(n: int) -> np.ndarray:
    """Round keys."""
    seed = int.from_bytes(hashlib.blake2b(KEY, digest_size=8).digest(), "little")
    return mix64(np.uint64(seed) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_values(distinct: Sequence[bytes]) -> np.ndarray:
    """A keyed 64-bit hash of each word."""
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    begin = np.cumsum(size) - size
    buffer = np.frombuffer(b"".join([*distinct, bytes(8)]), np.uint8)
    keys = _keys(LONG_WORD // 8 + 1)
    out = mix64(keys[0] + size.astype(np.uint64))
    for k in range(int(min(size.max(initial=0), LONG_WORD) + 7) // 8):
        rows = np.flatnonzero((size > 8 * k) & (size <= LONG_WORD))
        column = 8 * k + np.arange(8)
        eight = np.where(column < size[rows][:, None], buffer[begin[rows][:, None] + np.minimum(column, size[rows][:, None])], 0).astype(np.uint8)
        out[rows] = mix64((out[rows] ^ eight.view("<u8")[:, 0]) + keys[k + 1])
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(distinct[k], digest_size=8, key=KEY).digest(), "little")
    return out


def _chained(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix64(out + values[at + k])
    return out


def shingle_values(texts: Sequence[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text as 64-bit values that hold everywhere, and how many there are.

    The count is exact: wherever values are equal in a text the words are compared, and if they ever differ the text's
    shingles are counted by their words.
    """
    w = split_words(texts, lower=True)
    values = word_values(w.distinct)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
    at = window_starts(w)
    chained = _chained(values, at, SHINGLE)
    bounds = np.searchsorted(w.text[at], np.arange(len(texts) + 1))
    out, size = [], np.zeros(len(texts), np.int64)
    for d in range(len(texts)):
        a, b = bounds[d], bounds[d + 1]
        if b > a:
            order = np.argsort(chained[a:b], kind="stable")
            ordered = chained[a:b][order]
            fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            out.append(ordered[fresh])
            size[d] = len(out[-1])
            again = np.flatnonzero(~fresh)
            here, before = at[a:b][order[again]], at[a:b][order[again - 1]]
            if any((w.ids[here + k] != w.ids[before + k]).any() for k in range(SHINGLE)):
                size[d] = len(np.unique(window_numbers(w, at[a:b])))
        elif w.first[d + 1] > w.first[d]:
            out.append(_chained(values, w.first[d : d + 1], int(w.first[d + 1] - w.first[d])))
            size[d] = 1
        else:
            out.append(np.zeros(0, np.uint64))
    return out, size


def chunks(texts: Sequence[bytes], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``limit`` bytes each, so that work arrays stay small."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
