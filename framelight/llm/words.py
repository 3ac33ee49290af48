"""Words of whole batches of texts as numpy arrays, straight from Arrow's buffers: no loop over texts or words.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; as these are ASCII, a word's bytes are its
UTF-8. A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums and then mixed."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text worked on at once; a longer text is a slice of its own
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]  # A-Z count as a-z
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; tables up to a slice's length are kept."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 4 * SLICE:
            _powers[base] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end
    doc: np.ndarray  # of each word, its text

    def hashes(self, fold: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up = powers(BASE, len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((FOLDED if fold else BYTE)[self.data] * up, out=sums[1:])
        down = powers(pow(BASE, -1, 1 << 64), len(self.data))
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def flat(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    return texts.fill_null("") if texts.null_count else texts


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    if not len(texts):
        return
    at = offsets(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1)
        yield low, min(high, len(texts))
        low = high


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def scan(texts: pa.Array, space: np.ndarray = SPACE) -> Words:
    """texts: without nulls; space: of each byte, whether it stands between words."""
    n = len(texts)
    at = offsets(texts) if n else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if n else None
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(n + 1, np.int64), np.zeros(0, np.int32))
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, first, np.repeat(np.arange(n, dtype=np.int32), np.diff(first)))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and whether they are of one text; one for each of the words but the last k-1."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    base = 0xC2B2AE3D27D4EB4F | 1
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    down = powers(pow(base, -1, 1 << 64), len(h))
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1]), doc[: len(h) - k + 1] == doc[k - 1 :]
