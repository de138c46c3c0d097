"""Words of whole texts as 64-bit hashes, cut from the bytes of an Arrow column with numpy.

A byte table maps each byte to 0 (between words) or to the byte it counts as. All separators used
here are ASCII, so cutting the UTF-8 bytes gives the same words as cutting the code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 << 10
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def draws(n: int, seed: int) -> np.ndarray:
    """n fixed odd random numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return mix(steps + _U(seed)) | _U(1)


def byte_table(separators: bytes) -> np.ndarray:
    """A-Z count as a-z; the separators as 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


# Words of letters and digits, anything beyond ASCII counting as a letter.
ALNUM = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))
# Words between white space: 0x20 and 0x09 to 0x0D. The NUL byte is part of a word there.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
SPACED[0] = 255  # a byte that UTF-8 never uses

_BYTES = draws(256, 11)
_PLACES = draws(64, 23)


class Chunk(NamedTuple):
    """Some whole texts of a column: `first` is the index of the first one; word i of the chunk has
    hash `hashes[i]` and lies in bytes `starts[i]:ends[i]` of the column; `counts` has the words of
    each text."""

    first: int
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts and ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at.astype(np.int64)


def chunks(texts: pa.Array, table: np.ndarray) -> Iterator[Chunk]:
    """The words of all texts, some whole texts at a time."""
    data, at = text_bytes(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield _chunk(data, at[first : last + 1], table, first)
        first = last


def _chunk(data: np.ndarray, at: np.ndarray, table: np.ndarray, first: int) -> Chunk:
    low, high = int(at[0]), int(at[-1])
    if low == high:
        none = np.zeros(0, np.int64)
        return Chunk(first, np.zeros(len(at) - 1, np.int64), none.astype(np.uint64), none, none)
    raw = table[data[low:high]]
    inside = raw != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[(at > low) & (at < high)] - low  # a word never spans two texts
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, at - low))
    if not len(starts):
        return Chunk(first, counts, np.zeros(0, np.uint64), starts, ends)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    letters = _BYTES[raw[inside]]
    places = np.arange(len(letters)) - np.repeat(heads, lengths)
    longest = int(lengths.max())
    letters *= (_PLACES if longest <= len(_PLACES) else draws(longest, 23))[places]
    return Chunk(first, counts, mix(np.add.reduceat(letters, heads)), starts + low, ends + low)


def hashes_of(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Hashes of single words as they appear in texts."""
    column = pa.array([w.decode() for w in words], pa.large_string())
    return np.concatenate([c.hashes for c in chunks(column, table)] or [np.zeros(0, np.uint64)])
