"""Deterministic tensor files (safetensors layout) for compiled operators: small, hence written by the driver."""

from __future__ import annotations

import json
import struct

import numpy as np

_KINDS = {"F64": np.dtype("<f8"), "F32": np.dtype("<f4"), "I64": np.dtype("<i8"), "I32": np.dtype("<i4"), "U8": np.dtype("u1")}


def encode(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> bytes:
    """Names in order, header padded with spaces to 8 bytes, then the arrays."""
    header: dict = {"__metadata__": dict(sorted(metadata.items()))} if metadata else {}
    data, at = [], 0
    for name in sorted(tensors):
        array = np.ascontiguousarray(tensors[name])
        kind = next(k for k, t in _KINDS.items() if t == array.dtype)
        raw = array.astype(_KINDS[kind]).tobytes()
        header[name] = {"dtype": kind, "shape": list(array.shape), "data_offsets": [at, at + len(raw)]}
        data.append(raw)
        at += len(raw)
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(data)


def decode(data: bytes) -> dict[str, np.ndarray]:
    (size,) = struct.unpack("<Q", data[:8])
    header = json.loads(data[8 : 8 + size])
    out, end = {}, 0
    for name, x in header.items():
        if name != "__metadata__":
            a, b = x["data_offsets"]
            out[name] = np.frombuffer(data[8 + size + a : 8 + size + b], _KINDS[x["dtype"]]).reshape(x["shape"])
            end = max(end, b)
    if 8 + size + end != len(data):
        raise ValueError("the file's length isn't the declared one")
    return out
