"""How chunks of documents ask all other chunks about their hashes in little room.

A chunk's different hashes are sorted and cut at the block edges: block b holds the b-th of n equal ranges of
hashes. What goes to a block is one row of sorted hashes, by byte planes (the upper planes of sorted numbers
compress to little). The answer comes back in the order of the hashes sent, so it needs no hashes."""

import numpy as np
import pyarrow as pa


def edges(n_blocks: int) -> np.ndarray:
    return np.array([(b << 64) // n_blocks for b in range(1, n_blocks)], np.uint64)


def cuts(ordered: np.ndarray, n_blocks: int) -> np.ndarray:
    """Where each block's part of sorted hashes begins; one more at the end."""
    return np.concatenate([[0], np.searchsorted(ordered, edges(n_blocks)), [len(ordered)]]).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different values, of each the first place, and of each place its value's number."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number
