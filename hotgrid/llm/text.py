"""Vectorised word work on Arrow batches of texts: word bounds, word hashes, shingle hashes.

All word classes here are sets of ASCII bytes (every byte of a non-ASCII character is a word byte), so texts are cut
on their UTF-8 bytes. Batches are walked in blocks of whole texts of about ``BLOCK_BYTES``; one longer text is a block
by itself. A null text has no words, like an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 16  # the arrays of a block stay in a core's cache
U64 = np.uint64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags: bytes outside all the inclusive ``ranges`` are word bytes."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # with A-Z, which are folded when hashed
LINES = byte_class((0x0A, 0x0A))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (the public splitmix64 steps)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_PLAIN = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_BASE = 0xD1342543DE82EF95
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length()) if n <= 2 * BLOCK_BYTES else n
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            steps = np.full(size, base & (2**64 - 1), U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if n > 2 * BLOCK_BYTES:
            return out[0], out[1]  # of one very long text: not kept
        _powers = (out[0], out[1])
    return _powers


class Block:
    """Some texts of one batch: their bytes, and the bounds of each text in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.size = data, bounds, len(bounds) - 1

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of the class, and the bounds of each text in them."""
        inside = table[self.data]
        cut = self.bounds[:-1][self.bounds[:-1] < len(self.data)]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[cut] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
        """A 64-bit hash of each span's bytes; ``folded`` takes A-Z as a-z."""
        powers, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        values = (_FOLDED if folded else _PLAIN)[self.data]
        np.cumsum(values * powers[: len(self.data)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(out + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.bounds])

    def raw(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole texts, in order; every row is in exactly one block."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        to = min(to, n)
        low, high = offsets[at], offsets[to]
        yield Block(data[low:high], offsets[at : to + 1] - low)
        at = to


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def windows(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that stay within one text, and the bounds of each text in them."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, U64), out_bounds
    first = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], counts)
    h = np.full(total, U64(k))
    for i in range(k):
        h = h * U64(0x9FB21C651E98DF25) + words[first + i]
    return mix(h), out_bounds


def shingle_sets(column: pa.Array, k: int, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes per text, letters folded.

    A text of fewer than ``k`` words has its whole sequence as one shingle; without words its set is empty.
    """
    for block in blocks(column):
        starts, ends, bounds = block.spans(table)
        words = block.hashes(starts, ends, folded=True)
        shingles, at = windows(words, bounds, k)
        n_words = np.diff(bounds)
        for i in range(block.size):
            if n_words[i] >= k:
                yield np.unique(shingles[at[i] : at[i + 1]])
            elif n_words[i] == 0:
                yield np.zeros(0, U64)
            else:
                whole, _ = windows(words[bounds[i] : bounds[i + 1]], np.array([0, n_words[i]]), int(n_words[i]))
                yield whole


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list column of one numpy array per row."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if flat.dtype == U64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
