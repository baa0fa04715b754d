"""Arrow text columns as numpy arrays of code points and back, a whole batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is as an empty text. Row i is bytes[offsets[i]:offsets[i + 1]]."""
    return binary_bytes(texts.cast(pa.large_string()))


def binary_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As `utf8_bytes`, of a string or binary array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may own bytes
        size = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        if size.sum() != at[-1] - at[0]:
            keep = np.repeat(at[:-1] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            return whole[keep], np.r_[0, np.cumsum(size)]
    return whole[at[0] : at[-1]], at - at[0]


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets in code points) of UTF-8 bytes."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return points, before[offsets]


def byte_lengths(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def encode(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string array of the rows; null where `valid` is False."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    ends = np.r_[0, np.cumsum(byte_lengths(points))][offsets]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    got = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data), mask)
    return got if ends[-1] >= 1 << 31 else got.cast(pa.string())
