"""Packages of named sections with integrity: measured, encoded and re-identified when they are read."""

from __future__ import annotations

import hashlib
import json
import struct


def measure(sections: dict[str, bytes]) -> int:
    """The size that ``encode`` will give."""
    return 8 + len(_index(sections)) + sum(map(len, sections.values()))


def _index(sections: dict[str, bytes]) -> bytes:
    return json.dumps([[n, len(d), hashlib.sha256(d).hexdigest()] for n, d in sorted(sections.items())], separators=(",", ":")).encode()


def encode(sections: dict[str, bytes]) -> tuple[bytes, str]:
    """The package and its identity, the digest of its index."""
    index = _index(sections)
    return struct.pack("<Q", len(index)) + index + b"".join(d for _, d in sorted(sections.items())), hashlib.sha256(index).hexdigest()


def decode(data: bytes, identity: str | None = None) -> dict[str, bytes]:
    """The sections, each of which must have its digest; the whole must have ``identity`` if one is asked for."""
    (size,) = struct.unpack("<Q", data[:8])
    index = data[8 : 8 + size]
    if identity is not None and hashlib.sha256(index).hexdigest() != identity:
        raise ValueError("another package")
    out, at = {}, 8 + size
    for name, length, digest in json.loads(index):
        section = data[at : at + length]
        if hashlib.sha256(section).hexdigest() != digest:
            raise ValueError(f"section {name} is damaged")
        out[name] = section
        at += length
    if at != len(data):
        raise ValueError("bytes after the last section")
    return out
