"""Words of Arrow text columns as numpy arrays: byte ranges, rows and 64-bit hashes, a bounded piece at a time.

Hashes only choose candidates or stand for words inside one operator; where a result must not hang on a hash, the
operator compares the words themselves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text taken up at once. A single longer text still goes through whole.
PIECE = 4 << 20

# Bytes that separate words: space and 0x09 to 0x0D. Bytes of longer UTF-8 characters are never among them.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Words:
    data: np.ndarray  # bytes of the texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    row: np.ndarray  # of each word, in the piece
    first: np.ndarray  # words first[i]:first[i + 1] belong to row i
    hash: np.ndarray

    def spans(self, begin: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The texts from word begin[i] to before word stop[i], as they stand."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[begin].tolist(), self.end[stop - 1].tolist())]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PIECE bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets); NULL is empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, first byte of every word, byte after it)."""
    data, offsets = bytes_of(texts)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~SPACE[data]
    edge = inside[:-1].copy()
    edge[1:] &= ~inside[:-2]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[begins] = inside[begins]
    start = np.flatnonzero(edge)
    stop = inside[:-1] & ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[lasts] = inside[lasts]
    return data, offsets, start, np.flatnonzero(stop) + 1


def word_counts(texts: pa.Array) -> np.ndarray:
    _, offsets, start, _ = word_starts(texts)
    return np.diff(np.searchsorted(start, offsets, side="left"))


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets, start, end = word_starts(texts)
    if lower:
        data = _LOWER[data]
    first = np.searchsorted(start, offsets, side="left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # A word's hash is the sum of byte * base^place: two running sums give it, whatever the word's length.
    up, down = _power(_BASE, len(data)), _power(_BACK, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return Words(data, start, end, row, first, mixed((sums[end] - sums[start]) * down[start]))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all places."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words that follow each other, from each place where k are left."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out + hashes[i : i + n]) * np.uint64(0xA24BAED4963EE407 + 2 * i)
    return mixed(out)


def within(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each place lie in one text."""
    n = max(0, len(words.row) - k + 1)
    return words.row[:n] == words.row[k - 1 : k - 1 + n]


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held
