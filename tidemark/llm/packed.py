"""Number arrays as compressed bytes, for columns that carry many numbers of one chunk of texts."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Bytes of unsigned integers: differences if they ascend, byte planes apart, compressed."""
    kind = np.dtype(values.dtype).str.encode()
    if ascending and len(values):
        values = np.r_[values[:1], np.diff(values)]
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""
    return bytes([len(kind), ascending]) + kind + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    size, ascending = data[0], data[1]
    kind = np.dtype(data[2:2 + size].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2 + size:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending and len(values) else values


def least_type(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)
