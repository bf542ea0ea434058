"""Words and counts of Arrow text columns, by whole-array passes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library keeps its own counsel
    LIBC = None

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def trim() -> None:
    """Gives freed memory back to the system: workers stay between tasks, and share an executor's memory with others."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def slices(batches, column: str = "text", most_bytes: int = 4 << 20):
    """Record batches of about most_bytes of text, joined from smaller and cut from larger ones (a longer text stands alone)."""

    def joined(held):
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held, have = [], 0
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            upto = int(np.searchsorted(size, done + most_bytes - have, "right"))
            if upto == at and not held:
                upto += 1
            if upto > at:
                held.append(b.slice(at, upto - at))
                have += int(size[upto - 1] - done)
                at = upto
            if at < b.num_rows or have >= most_bytes:
                yield joined(held)
                held, have = [], 0
                trim()
    if held:
        yield joined(held)
    held = []
    trim()


def raw(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary array; null is empty."""
    a = pc.fill_null(texts, b"") if pa.types.is_large_binary(texts.type) else pc.fill_null(texts, "").cast(pa.large_string())
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def words(texts, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(all words, offsets of each text's words): runs of anything but ASCII white space."""
    t = pc.fill_null(texts, "")
    t = t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t
    lists = pc.ascii_split_whitespace((pc.ascii_lower(t) if lower else t).cast(pa.large_string()))
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return flat, off
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[off]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each number."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of words, equal in every process: two polynomials over the bytes, mixed."""
    d = flat.dictionary_encode()
    values = d.dictionary
    data, off = raw(values)
    n = np.diff(off)
    h = np.zeros(len(values), np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(n.max(initial=0)) + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
        at = np.arange(len(data)) - np.repeat(off[:-1], n)
        terms = mixed(data.astype(np.uint64) + np.uint64(1)) * power[at]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        h = total[off[1:]] - total[off[:-1]]
    return mixed(h + n.astype(np.uint64))[d.indices.to_numpy()]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words from each position on (only where so many follow)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(out)
