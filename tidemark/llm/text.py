"""Word splitting and hashing over the raw bytes of an Arrow text column.

All functions work on numpy arrays holding the UTF-8 bytes of many documents at
once, so the cost per word is a few vectorised passes instead of a Python call.
Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of the documents that are worked on at once; their arrays take some 60 times as much.
CHUNK_BYTES = 1 << 18
_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_CHECK_BASE = 0xAF251AF3B0F025B5
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

SAME_CASE = np.arange(256, dtype=np.uint8)
LOWER = SAME_CASE.copy()
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _CHECKS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_CHECK_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of some documents: hashes, byte ranges, and where each document's words and bytes begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray  # n_docs + 1 offsets into the words
    data: np.ndarray
    offsets: np.ndarray
    word: np.ndarray  # which bytes are in words

    def of(self, doc: int) -> slice:
        return slice(self.docs[doc], self.docs[doc + 1])

    def joined(self, keep: np.ndarray | None = None) -> list[bytes]:
        """Each document's words (those that keep marks) with one space between them."""
        stays, after = self.word, self.ends
        if keep is not None:
            edges = np.zeros(len(self.data) + 1, dtype=np.int8)
            edges[self.starts[keep]] += 1
            edges[self.ends[keep]] -= 1  # a word may end where the next document's begins
            stays, after = np.cumsum(edges[:-1], dtype=np.int8) > 0, after[keep]
        # The separator after a word stays as a space; the last word's goes, and at the end of a document there is none.
        gaps = after[~np.isin(after, self.offsets)]
        taken = stays.copy()
        taken[gaps] = True
        out = self.data.copy()
        out[gaps] = 0x20
        out, ends = out[taken], np.concatenate([[0], np.cumsum(taken)])[self.offsets]
        raw = out.tobytes()
        return [raw[a:b].removesuffix(b" ") for a, b in zip(ends, ends[1:], strict=False)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string column, where they lie, and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    for _ in range(2):
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, dtype=np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not column.null_count or not np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
            break
        column = column.fill_null("")  # bytes under a null
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: workers of one executor share its limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes each, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _BYTES.upto(len(data))
    sums = np.empty(len(data) + 1, dtype=_U)
    sums[0] = 0
    values = sums[1:]
    np.add(data, _U(1), out=values)
    values *= up
    np.cumsum(values, out=values)
    return mix((sums[ends] - sums[starts]) * down[starts])


def split_words(data: np.ndarray, offsets: np.ndarray, separators=ASCII_SPACE, case=LOWER) -> Words:
    """Split documents into words at separator bytes and hash every word."""
    word = ~separators[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), dtype=_U)
    data = case[data]
    at = 0
    while at < len(starts):  # a long document goes in pieces that end with a word
        base = starts[at]
        upto = max(int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")), at + 1)
        hashes[at:upto] = _hash_piece(data[base : ends[upto - 1]], starts[at:upto] - base, ends[at:upto] - base)
        at = upto
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data, offsets, word)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    size = len(hashes) - n + 1
    total = np.full(size, n, dtype=_U)
    for k in range(n):
        total = total * _U(_WORD_BASE) + hashes[k : k + size]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash for a whole sequence of words, its length included."""
    total = ngrams(hashes, len(hashes))
    return int(total[0]) if len(hashes) else 0


def _rolling(hashes: np.ndarray, n: int, powers: _Powers) -> np.ndarray:
    up, down = powers.upto(len(hashes))
    sums = np.empty(len(hashes) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(hashes * up, out=sums[1:])
    size = len(hashes) - n + 1
    return mix((sums[n:] - sums[:size]) * down[:size])


def windows(hashes: np.ndarray, n: int, check: bool = False) -> np.ndarray:
    """Hashes of all runs of n words in time independent of n; check: an independent second hash."""
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    return _rolling(hashes, n, _CHECKS if check else _WORDS)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling."""
    if len(values) < width:
        return np.zeros(0, dtype=values.dtype)
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x, dtype=_U).view(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
