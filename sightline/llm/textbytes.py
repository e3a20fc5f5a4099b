"""Words of many texts at once, as numpy views of Arrow string buffers.

A text is never split between runs: one of n bytes takes about 8 n bytes in a worker while its words are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time: bounds the temporary arrays to some tens of MB.
CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _P)
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes in the given closed ranges."""
    flags = np.zeros(256, dtype=bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case; in UTF-8 every byte of a character over 0x7F is over 0x7F.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0], offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def pieces(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, row after the last, bytes, offsets."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: Bytes from which a hash is taken by BLAKE2b, range by range, instead of in blocks over all ranges.
_LONG = 512


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, *, wide: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; with ``wide`` two of them, in a second dimension.

    Blocks of eight bytes go one after the other through a mix that isn't linear in them, so that
    no pair of unlike texts is known to get the same hash.
    """
    size = end - start
    seeds = (_P, _MIX) if wide else (_P,)
    out = [mixed((size.astype(np.uint64) + np.uint64(1)) * seed) for seed in seeds]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left, at = np.flatnonzero((size > 0) & (size < _LONG)), 0
    while len(left):
        block = blocks[start[left] + at]
        rest = size[left] - at
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        for one, seed in zip(out, seeds, strict=True):
            one[left] = mixed((one[left] ^ block) * seed + np.uint64(at + 1))
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(size >= _LONG):
        made = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), "<u8")
        for one, value in zip(out, made, strict=False):
            one[i] = value
    return np.stack(out, axis=1) if wide else out[0]


def sliced(batch: pa.RecordBatch, *columns: str, size: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of a batch whose given columns hold about ``size`` bytes, and a row at least."""
    if not batch.num_rows:
        return
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        length = pc.binary_length(batch.column(c))
        total += np.nan_to_num(length.to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, row = np.cumsum(total), 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(row, end - row)
        row = end


def replaced(column: pa.Array, rows: np.ndarray, values: list) -> pa.Array:
    """A column with other values in the given rows; the rest isn't turned into Python objects."""
    if not len(rows):
        return column
    mask = np.zeros(len(column), dtype=bool)
    mask[rows] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(values, column.type))


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, longer by as many marks as it needs to be none of the taken ones."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


class Words:
    """The words of a run of texts.

    ``hash``, ``start`` and ``end`` have an entry per word; words ``first[i]`` to
    ``first[i + 1]`` are those of text i. Equal words have equal hashes. ``fold`` takes A-Z as a-z; ``wide`` makes two hashes a word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, *, fold: bool = True, wide: bool = False):
        self.data = LOWER[raw] if fold else raw
        inside = kind[self.data]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hashes(self.data, self.start, self.end, wide=wide)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()
