"""Compressed blobs of bytes and of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", 3)


def squeezed(data: bytes) -> bytes:
    return _ZSTD.compress(data, asbytes=True)


def whole(data: bytes, size: int) -> bytes:
    return _ZSTD.decompress(data, decompressed_size=size, asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Values of one type, byte by byte of their places in memory, compressed."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()
    return len(values).to_bytes(8, "little") + squeezed(planes)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(whole(blob[8:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)
