"""Statistics of whole texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tesserae.llm.wordgrid import SHINGLE, Words, paired, split_words, window_numbers, window_starts

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Classes of bytes.
(LOWER, UPPER, DIGIT, SPACE, LINE_FEED, SYMBOL, STOP, MARK, QUOTE, LEAD, MORE, REST) = range(12)
N_CLASSES = 12
_CLASS = np.full(256, REST, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWER, UPPER, DIGIT
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = LINE_FEED
_CLASS[list(SYMBOLS)] = SYMBOL
_CLASS[list(b".,;:")], _CLASS[list(b"!?")], _CLASS[list(b"\"'()[]{}")] = STOP, MARK, QUOTE
_CLASS[0xC0:], _CLASS[0x80:0xC0] = LEAD, MORE


def class_counts(texts: Sequence[bytes]) -> np.ndarray:
    """A row of byte counts by class for each text."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    key = np.repeat(np.arange(n) * N_CLASSES, size) + _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    return np.bincount(key, minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def repeated_words(w: Words) -> np.ndarray:
    """Per text, the words inside windows of ``SHINGLE`` words that occur there twice or more."""
    per = np.diff(w.first)
    at = window_starts(w)
    text = w.text
    if not len(at):
        return np.zeros(len(per), np.int64)
    number = paired(window_numbers(w, at), text[at])
    repeated = at[np.bincount(number)[number] > 1]
    step = np.zeros(len(w.ids) + 1, np.int64)
    np.add.at(step, repeated, 1)
    np.add.at(step, repeated + SHINGLE, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(text[covered], minlength=len(per))


def distinct_words(w: Words) -> np.ndarray:
    n = len(w.first) - 1
    return np.bincount(np.unique(w.ids * n + w.text) % n, minlength=n) if n else np.zeros(0, np.int64)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip():
            seen.add(line)
    return count


def base_statistics(texts: Sequence[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = split_words(texts)
    counts = class_counts(texts)
    return {
        "n_words": np.diff(w.first),
        "word_chars": counts.sum(axis=1) - counts[:, MORE] - counts[:, SPACE] - counts[:, LINE_FEED],
        "n_symbols": counts[:, SYMBOL],
        "n_dup_lines": np.fromiter(map(repeated_lines, texts), np.int64, len(texts)),
        "n_repeat_words": repeated_words(w),
    }
