"""Trajectory carriers: four binary64 values that carry 212 bits.

The payload is one integer: the id's 128 bits, 31 low bits of metadata, the ordinal, the run length, and 21 high bits
of metadata.  Its four 53-bit digits become the sign and fraction of doubles with exponent zero.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

MAX_RUN = 65535
_EXPONENT = 0x3FF << 52
_DIGIT = (1 << 53) - 1
#: Fields of the payload, from its lowest bit on: name and bits.
_FIELDS = (("lane", 128), ("low", 31), ("ordinal", 16), ("run", 16), ("high", 21))


class Carrier(NamedTuple):
    entity: bytes
    ordinal: int
    run: int
    metadata: int


def metadata_of(tier: int, atom: int | None = None) -> int:
    """Whether there is an atom, the tier in 5 bits, and from bit 31 on the atom."""
    if not 0 <= tier < 32:
        raise ValueError("tier out of range")
    return tier << 1 | (0 if atom is None else atom << 31 | 1)


def tier_of(metadata: int) -> int:
    return metadata >> 1 & 31


def atom_of(metadata: int) -> int | None:
    return metadata >> 31 if metadata & 1 else None


def encode(c: Carrier) -> bytes:
    """32 bytes: four little-endian doubles."""
    values = {"lane": int.from_bytes(c.entity[8:], "little") | int.from_bytes(c.entity[:8], "little") << 64, "low": c.metadata & (1 << 31) - 1, "ordinal": packed_ordinal(c.ordinal), "run": c.run, "high": c.metadata >> 31}
    payload, at = 0, 0
    for name, bits in _FIELDS:
        if not 0 <= values[name] < 1 << bits:
            raise ValueError(f"{name} out of range")
        payload |= values[name] << at
        at += bits
    digits = [payload >> 53 * k & _DIGIT for k in range(4)]
    return struct.pack("<4Q", *(d >> 52 << 63 | _EXPONENT | d & _DIGIT >> 1 for d in digits))


def decode(carrier: bytes) -> Carrier:
    payload = 0
    for k, bits in enumerate(struct.unpack("<4Q", carrier)):
        if bits >> 52 & 0x7FF != 0x3FF:
            raise ValueError("not a carrier")
        payload |= (bits >> 63 << 52 | bits & _DIGIT >> 1) << 53 * k
    values = {}
    for name, bits in _FIELDS:
        values[name] = payload & (1 << bits) - 1
        payload >>= bits
    lane = values["lane"].to_bytes(16, "little")
    return Carrier(lane[8:] + lane[:8], values["ordinal"], values["run"], values["low"] | values["high"] << 31)


def run_pieces(run: int) -> list[int]:
    """A run cut into pieces that a carrier can hold."""
    if run < 1:
        raise ValueError("a run has a member at least")
    return [MAX_RUN] * (run // MAX_RUN) + ([run % MAX_RUN] if run % MAX_RUN else [])


def packed_ordinal(ordinal: int) -> int:
    """Ordinals that don't fit are packed as 0."""
    return ordinal if ordinal <= MAX_RUN else 0
