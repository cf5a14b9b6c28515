"""Words of many texts at once: arrays over their UTF-8 bytes, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of string or binary ``texts``; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield i, j
        i = j


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array over ``data``, of less than 2 GB, cut at ``offsets``."""
    offsets = np.ascontiguousarray(offsets, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words(texts: pa.Array, separators: np.ndarray = WHITE, mapped: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words of each text): maximal runs of bytes outside ``separators``.

    ``separators`` marks ASCII bytes only, so that characters are never cut; ``mapped`` replaces bytes.
    """
    data, ends = utf8(texts)
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    full = ends[:-1] < ends[1:]
    first, last = ends[:-1][full], ends[1:][full] - 1
    starts[first] = inside[first]
    stops[last] = inside[last]
    at = np.flatnonzero(starts)
    lengths = np.flatnonzero(stops) + 1 - at
    kept = data[inside]
    counts = np.diff(np.searchsorted(at, ends))
    return binary(kept if mapped is None else mapped[kept], np.concatenate(([0], np.cumsum(lengths)))), counts


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each value's first like, distinct values)."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
