"""Vectorised splitting of Arrow text batches into dictionary-coded words.

A batch's texts are one byte buffer. Word and separator runs are found by
table lookups on the bytes, and Arrow's own dictionary encoder turns the runs
into integer codes without copying them, so that work on words is done once
for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ALL = np.ones(1, bool)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most_bytes`` of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def buffer_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and where each text starts, with the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return (LOWER[raw] if lower else raw), at - at[0]


def encode_runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of the runs that begin at ``starts`` and fill ``raw``."""
    offsets = np.append(starts, len(raw)).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Words:
    """Words of a batch: ``codes`` into ``values``, and ``bounds`` of each text in ``codes``."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, values: list[bytes] | pa.Array):
        self.codes, self.bounds, self.values = codes, bounds, values

    def per_text(self, weights: np.ndarray) -> np.ndarray:
        """Sum, for each text, of its words' values in ``weights``."""
        total = np.concatenate([[0], np.cumsum(weights)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def words_of(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    raw, at = buffer_of(texts, lower)
    if not len(raw):
        return Words(np.zeros(0, np.int32), np.zeros(len(at), np.int64), pa.array([], pa.large_binary()))
    gap = space[raw]
    begin = np.empty(len(raw), bool)
    begin[0] = True
    np.not_equal(gap[1:], gap[:-1], out=begin[1:])
    begin[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(begin)
    is_word = ~gap[starts]
    codes, values = encode_runs(raw, starts)
    codes = codes[is_word]
    bounds = np.searchsorted(starts[is_word], at)
    used, codes = np.unique(codes, return_inverse=True)
    return Words(codes.astype(np.int32), bounds, values.take(pa.array(used)))


def hash_values(values: pa.Array) -> np.ndarray:
    """64-bit content hashes of binary values, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of a 64-bit value over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_rows(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array whose row i holds the next ``lengths[i]`` items of ``flat``."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])
