"""Small numpy helpers that work on whole Arrow batches of texts.

A batch is taken as one byte buffer with document offsets. Words are maximal runs of bytes
outside ``[\\x20\\x09-\\x0D]``; those bytes never occur inside a multi-byte UTF-8 character, so
byte runs and code-point runs are the same. All hashes are 64-bit and fixed by constants, so
every task and every rerun computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; one longer document is taken alone.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: One value for each byte; A-Z count as a-z, white space as nothing.
_BYTE_FOLDED = np.where(SPACE, U(0), _BYTE[_FOLD])
_BYTE_EXACT = np.where(SPACE, U(0), _BYTE)
_STEP = U(0xD1342543DE82EF95)
_LANES = mix(np.arange(1, 65, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)


def free(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column in ``taken`` has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its document offsets (null: no bytes)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text, or of one document."""
    if not batch.num_rows:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    at = 0
    while at < batch.num_rows:
        base = ends[at] - lens[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_bounds(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document where its words begin (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ok = ~space[data]
    before = np.empty_like(ok)
    before[0] = False
    before[1:] = ok[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    starts = np.flatnonzero(ok & ~before)
    after = np.empty_like(ok)
    after[-1] = False
    after[:-1] = ok[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(ok & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``folded``, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U)
    values = (_BYTE_FOLDED if folded else _BYTE_EXACT)[data[starts[0] : ends[-1]]]
    at = np.arange(starts[0], ends[-1]) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
    longest = int((ends - starts).max())
    np.minimum(at, longest, out=at)  # what follows a word is white space and counts 0
    powers = np.empty(longest + 1, U)
    powers[0] = 1
    powers[1:] = _STEP
    powers = np.multiply.accumulate(powers)
    # a word that ends where the next document begins has no white space after it
    values *= powers[at]
    return mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(U))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n (64 at most) consecutive values, by start."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    total = np.zeros(count, U)
    for k in range(n):
        total += hashes[k : k + count] * _LANES[k]
    return mix(total)


class Rolling:
    """Hashes of all runs of n values, of any n, from one prefix.

    The hash is a polynomial modulo 2**64 in an odd base: ``prefix`` sums value times base to
    the minus position, so a run is a difference of two entries, shifted back by one product.
    """

    BASE = 0xD1342543DE82EF95

    def __init__(self, hashes: np.ndarray):
        down = np.full(len(hashes) + 1, pow(self.BASE, -1, 1 << 64), U)
        up = np.full(len(hashes) + 1, self.BASE, U)
        down[0] = up[0] = 1
        self.up = np.multiply.accumulate(up)
        self.prefix = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * np.multiply.accumulate(down)[:-1], out=self.prefix[1:])

    def runs(self, a: int, b: int, n: int) -> np.ndarray:
        """Of the values a to b (not included), every run of n by its start."""
        if b - a < n:
            return np.zeros(0, U)
        return (self.prefix[a + n : b + 1] - self.prefix[a : b - n + 1]) * self.up[a : b - n + 1]


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct n-word shingles, words folded.

    With fewer words than n, the whole sequence is one shingle; without words, none.
    """
    starts, ends, woff = word_bounds(data, offs)
    hashes = word_hashes(data, starts, ends)
    every = windows(hashes, n)
    out = []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(hashes[a:b] * _LANES[8 + np.arange(b - a)]).sum() + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out
