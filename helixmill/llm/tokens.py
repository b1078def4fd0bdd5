"""Words of a whole column of texts at once, as arrays: for operators that count words.

A byte table sends each byte to a word byte, SPACE or BREAK, one to one, so a column's buffer is translated in one call
and its offsets stay. Words are then found by comparing neighbouring bytes and numbered by Arrow's dictionary encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE, BREAK = 32, 10
SLICE_BYTES = 2 << 20


@dataclass
class Words:
    doc: np.ndarray  #: of each word, the number of its text in the slice
    ids: np.ndarray  #: of each word, its number in the dictionary
    dictionary: pa.Array  #: binary, the different words
    joined: np.ndarray  #: of each word, whether the next word is of the same text and no BREAK stands between them


def byte_table(kind) -> bytes:
    """kind: from a byte to the byte that stands for it. A-Z become a-z beforehand."""
    return bytes(kind(c + 32 if 65 <= c <= 90 else c) for c in range(256))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes; a longer text is a range by itself."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > begin and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(size):
        yield begin, len(size)


def words(column: pa.Array, table: bytes) -> Words:
    """The words of the texts of column, in order. Null texts have none."""
    column = pc.fill_null(column.cast(pa.string()), "")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    raw = np.frombuffer(bytes(raw[int(at[0]) : int(at[-1])] if raw is not None else b"").translate(table), np.uint8)
    at = at - at[0]
    inside = (raw != SPACE) & (raw != BREAK)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at[:-1], start, "right") - 1
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    every = every.dictionary_encode()
    piece = np.cumsum(raw == BREAK, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    joined = np.zeros(len(start), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    return Words(doc, every.indices.to_numpy(zero_copy_only=False).astype(np.int64), every.dictionary, joined)


def hashes(dictionary: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of each word, the same in every task."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
