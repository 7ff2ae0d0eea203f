"""Scans of whole Arrow text buffers with NumPy: pieces between separators, and hashes of pieces.

A buffer holds many texts behind each other. What is found is given as byte positions in
it; a piece never reaches over the end of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are scanned together. A longer text is scanned by itself.
BLOCK = 4 << 20
_PAD = 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: The bytes that are left of a loaded word if a piece ends within it.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_class(characters: str) -> np.ndarray:
    """A table of 256 truth values for the bytes of these ASCII characters."""
    found = np.zeros(256, bool)
    found[[ord(c) for c in characters]] = True
    return found


#: The white space between words, as bytes.
SPACE = byte_class(" \t\n\x0b\x0c\r")


class Texts:
    """Texts of an Arrow array as one byte buffer (padded with zeros) and the positions at which they start and end."""

    def __init__(self, texts: pa.Array, first: int, last: int, offsets: np.ndarray):
        data = texts.buffers()[2]
        low, high = int(offsets[first]), int(offsets[last])
        self.data = np.zeros(high - low + _PAD, np.uint8)
        if high > low:
            self.data[: high - low] = np.frombuffer(data, np.uint8, high - low, low)
        self.offsets = offsets[first : last + 1].astype(np.int64) - low
        self.rows = slice(first, last)

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of these truth values, one a byte, each text has: a prefix sum, read where texts end."""
        sums = np.zeros(self.size + 1, np.int64 if self.size >= 1 << 31 else np.int32)
        np.cumsum(marks, out=sums[1:])
        return np.diff(sums[self.offsets]).astype(np.int64)

    def pieces(self, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the longest runs of bytes that are not marked ``apart``."""
        inside = np.zeros(self.size + 2, bool)
        np.logical_not(apart, out=inside[1:-1])
        edges, full = inside[1:] != inside[:-1], self.offsets[:-1][np.diff(self.offsets) > 0]
        # a text that starts inside a run starts a piece and ends the one before
        cut = full[(full > 0) & inside[full] & inside[full + 1]]
        starts = np.flatnonzero(edges & inside[1:])
        ends = np.flatnonzero(edges & inside[:-1])
        if len(cut):
            starts, ends = np.union1d(starts, cut), np.union1d(ends, cut)
        counts = np.diff(np.searchsorted(starts, self.offsets))
        return starts, ends, np.repeat(np.arange(len(counts)), counts)


def blocks(texts: pa.Array) -> Iterator[Texts]:
    """``texts`` (strings without nulls) in blocks of about BLOCK bytes."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)) if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + BLOCK, "right")) - 1)
        yield Texts(texts, at, to, offsets)
        at = to


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    return np.ndarray((len(data) - _PAD + 1,), "<u8", data, 0, (1,))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of a padded buffer, eight bytes of all pieces at a time."""
    words, left, at = _loads(data), ends - starts, starts.copy()
    out = left.astype(np.uint64) * _MIX[0]
    live = np.flatnonzero(left > 0)
    while len(live):
        n = left[live]
        h = (out[live] ^ (words[at[live]] & _KEEP[np.minimum(n, 8)])) * _MIX[1]
        out[live] = h ^ (h >> np.uint64(32))
        at[live] += 8
        left[live] = n - 8
        live = live[n > 8]
    out = (out ^ (out >> np.uint64(30))) * _MIX[2]
    return out ^ (out >> np.uint64(31))


def same_pieces(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the pieces of these lengths that start at ``a`` and at ``b`` have the same bytes."""
    words, same = _loads(data), np.ones(len(a), bool)
    live, done = np.flatnonzero(length > 0), 0
    while len(live):
        keep = _KEEP[np.minimum(length[live] - done, 8)]
        equal = (words[a[live] + done] & keep) == (words[b[live] + done] & keep)
        same[live[~equal]] = False
        done += 8
        live = live[equal & (length[live] > done)]
    return same
