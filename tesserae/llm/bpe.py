"""Byte-level byte-pair encoding by numpy matrices, and decoding.

``Encoder`` cuts whole batches of texts into the matches of the usual byte-level pattern by character classes,
looks each piece up by its bytes in a bounded cache, and encodes the pieces that it misses with ``MatrixBPE``:
pieces are put into length buckets of padded matrices; in every round each row merges its leftmost pair of minimum
rank, found through a hashed pair table, rows close up over the merged place, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np

from tesserae.llm.wordgrid import mix64

#: The pattern whose matches are encoded separately.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3
#: Pieces longer than this many bytes are merged with a heap instead of in a matrix, in the same order: a row of n bytes
#: takes up to n rounds over its whole width.  The README has figures.
LONG_PIECE = 1024

_classes: np.ndarray | None = None


class Pieces(NamedTuple):
    """Byte ranges of a buffer; text ``d`` has those at ``first[d]:first[d + 1]``."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def character_classes() -> np.ndarray:
    """The class of every code point, made once in a process."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = WHITE
        _classes = table
    return _classes


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``pool[start[0]:start[0] + length[0]]``, then the next, as one array."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    before = np.cumsum(length) - length
    return pool[np.arange(total) + np.repeat(start - before, length)]


def cut_pieces(texts: Sequence[str]) -> Pieces:
    """The pattern's matches in all ``texts`` as byte ranges of one buffer.

    A run of one character class is one match, with these exceptions: a single U+0020 before a run of another
    class belongs to that run; a longer run of white space gives its last character away; and an apostrophe alone
    takes the letters of a contraction.  Texts never share a match.
    """
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(points)
    width = (1 + (points >= 0x80) + (points >= 0x800).astype(np.int8) + (points >= 0x10000)).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(width)))
    border = np.concatenate(([0], np.cumsum(chars)))
    buffer = np.frombuffer(whole.encode(), np.uint8)
    if not n:
        none = np.zeros(0, np.int64)
        return Pieces(buffer, none, none, np.zeros(len(texts) + 1, np.int64))
    kind = character_classes()[points]
    opens = np.zeros(n + 1, bool)  # texts begin here
    opens[border] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    last = np.empty(n, bool)  # the last character of a run
    last[:-1] = run[1:]
    last[-1] = True
    gives = last & (kind == WHITE) & ~opens[1:]  # white space right before a run of another class in the same text
    start |= gives
    joins = np.flatnonzero(gives & (points == 0x20)) + 1
    start[joins] = False
    alone = np.flatnonzero((points == 0x27) & run[:n] & last & start & ~opens[1:])
    if len(alone):
        padded = np.concatenate((points, [0, 0, 0]))
        inside = np.concatenate((~opens[:n], [False, False, False]))
        one, two = padded[alone + 1], padded[alone + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        pairs &= inside[alone + 2]
        for hit, size in ((alone[short], 1), (alone[pairs & ~short], 2)):
            start[hit + 1] = False
            rest = hit + 1 + size
            start[rest[rest < n]] = True
    first = np.flatnonzero(start)
    begin = at[first]
    end = np.concatenate((begin[1:], at[-1:]))
    return Pieces(buffer, begin, end, np.searchsorted(first, border))


class MatrixBPE:
    """Encodes pieces by ranks: the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self._pairs: dict[int, int] | None = None
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.size, np.int64)
        self.probes = 0
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing: the first to claim a free slot has it, the others look one further
            self.probes += 1
            where = slot[left]
            free = self.keys[where] < 0
            claim, who = np.unique(where[free], return_index=True)
            won = left[free][who]
            self.keys[claim], self.values[claim] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``size`` where they don't merge or either is padding (-1)."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.size)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def encode(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has."""
        size = end - start
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        width = 1
        while low < LONG_PIECE:
            rows = np.flatnonzero((size > low) & (size <= width))
            step = max(1, 4_000_000 // width)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                columns = np.arange(width)
                inside = columns < size[some][:, None]
                raw = buffer[np.minimum(start[some][:, None] + columns, len(buffer) - 1)]
                parts.append(self._merge(np.where(inside, self.byte_ids[raw], -1), some, count))
            low, width = width, width * 2
        for row in np.flatnonzero(size > LONG_PIECE):
            ids = self._merge_long(self.byte_ids[buffer[start[row] : end[row]]].tolist())
            count[row] = len(ids)
            parts.append((np.array([row]), np.array(ids, np.int64)))
        # the parts hold rows in groups; bring them into the order of the pieces
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for some, ids in parts:
            n = count[some]
            before = np.cumsum(n) - n
            out[np.arange(len(ids)) + np.repeat(place[some] - before, n)] = ids
        return out, count

    def _merge(self, ids: np.ndarray, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = ids.shape[1]
        if width > 1:
            rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
            live = np.arange(len(ids))
            columns = np.arange(width)
            work, work_rank = ids.copy(), rank
            while True:
                place = work_rank.argmin(axis=1)
                best = work_rank[np.arange(len(work)), place]
                going = best < self.size
                if not going.all():
                    ids[live[~going], : work.shape[1]] = work[~going]
                    ids[live[~going], work.shape[1] :] = -1
                    live, work, work_rank, place, best = live[going], work[going], work_rank[going], place[going], best[going]
                if not len(live):
                    break
                row = np.arange(len(work))
                work[row, place] = best
                w = work.shape[1]
                close = columns[: w - 1] + (columns[: w - 1] > place[:, None])  # skips the place after the pair
                work = np.take_along_axis(work, close, axis=1)
                if w == 2:
                    ids[live, :1] = work
                    ids[live, 1:] = -1
                    break
                work_rank = np.take_along_axis(work_rank, close[:, : w - 2], axis=1)
                left = np.flatnonzero(place > 0)
                work_rank[left, place[left] - 1] = self.rank(work[left, place[left] - 1], work[left, place[left]])
                right = np.flatnonzero(place < w - 2)
                work_rank[right, place[right]] = self.rank(work[right, place[right]], work[right, place[right] + 1])
        valid = ids >= 0
        count[rows] = valid.sum(axis=1)
        return rows, ids[valid]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        if self._pairs is None:  # only texts with such pieces need it
            used = self.keys >= 0
            self._pairs = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        pairs, size = self._pairs, self.size
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get(ids[i] * size + ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := pairs.get(rank * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pairs.get(ids[before[i]] * size + rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of either kind, told apart by its name."""
    if path.endswith(".json"):
        return json_ranks(path)
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def json_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary in the tokenizers library's JSON form.

    The file spells bytes as visible characters: printable Latin-1 bytes stand for themselves, the others follow
    from U+0100 on.  Ids must be in the order of the merges, so that an id is a rank.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocabulary = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocabulary[m] for m in merged]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError(f"{path}: ids don't follow the order of the merges")
    return {bytes(spelled[c] for c in token): vocabulary[token] for token in [*spelled, *merged]}


class _Slots(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """Encodes batches of texts through ``pieces``, keeping the ids of pieces it has seen.

    Pieces are known by their bytes.  After ``limit`` of them, or ``pool`` ids, the cache starts anew, so that a
    worker's memory doesn't grow with its input.
    """

    def __init__(self, pieces: MatrixBPE, limit: int = 600_000, pool: int = 3_000_000):
        self.pieces, self.limit, self.pool_limit = pieces, limit, pool
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots()
        self.start = np.zeros(1 << 10, np.int64)
        self.length = np.zeros(1 << 10, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _keep(self, known: int, ids: np.ndarray, count: np.ndarray) -> None:
        while known + len(count) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.start[known : known + len(count)] = self.used + np.cumsum(count) - count
        self.length[known : known + len(count)] = count
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's ids begin (with the end)."""
        cut = cut_pieces(texts)
        if self.used > self.pool_limit or len(self.slots) > self.limit:
            self._forget()
        known, raw = len(self.slots), cut.buffer.tobytes()
        slot = np.fromiter(map(self.slots.__getitem__, map(raw.__getitem__, map(slice, cut.start.tolist(), cut.end.tolist()))), np.int64, len(cut.start))
        new = list(islice(self.slots, known, None))
        if new:
            end = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
            self._keep(known, *self.pieces.encode(np.frombuffer(b"".join(new), np.uint8), np.concatenate(([0], end[:-1])), end))
        length = self.length[slot]
        total = np.concatenate(([0], np.cumsum(length)))
        return ragged(self.pool, self.start[slot], length), total[cut.first]


class Specials(NamedTuple):
    """Tokens that a vocabulary file cuts out of texts before anything else: their pattern, and their ids."""

    pattern: re.Pattern[str] | None
    ids: dict[str, int]

    @classmethod
    def of(cls, path: str) -> Specials:
        """Those of a tokenizers JSON file; files of ranks have none."""
        if not path.endswith(".json"):
            return cls(None, {})
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError(f"{path}: added tokens with strip, word or normalisation rules aren't supported")
        ids = {t["content"]: t["id"] for t in added}
        longest_first = sorted(ids, key=len, reverse=True)
        return cls(re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if ids else None, ids)


def encode_with_ends(encoder: Encoder, specials: Specials, texts: Sequence[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text, those of special tokens in it included, followed by ``end_id``; and where each text's begin."""
    parts: list[str] = []
    after: list[int] = []  # the id that follows each part
    held = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        cut = specials.pattern.split(text) if specials.pattern is not None else [text]
        parts += cut[::2]
        after += [*(specials.ids[x] for x in cut[1::2]), end_id]
        held[k] = len(after)
    ids, first = encoder.encode(parts)
    bounds = first + np.arange(len(first))  # every part has one more
    return np.insert(ids, first[1:], after), bounds[np.concatenate(([0], held))]


_encoders: dict[str, Encoder] = {}
_specials: dict[str, Specials] = {}


def specials_of(path: str) -> Specials:
    """This worker process's special tokens of a vocabulary file."""
    if path not in _specials:
        _specials[path] = Specials.of(path)
    return _specials[path]


def encoder_of(path: str) -> Encoder:
    """This worker process's encoder for a vocabulary file, so that its tables and cache serve many tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(MatrixBPE(read_ranks(path)))
    return _encoders[path]


class Decoder:
    """Bytes of ids, by one ragged gather."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id begin (with the end)."""
        length = self.length[ids]
        return ragged(self.pool, self.start[ids], length), np.concatenate(([0], np.cumsum(length)))
