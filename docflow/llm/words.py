"""Vectorised text work on Arrow batches: word spans, prefix hashes, grouped streams.

Texts of a batch are laid end to end as bytes, a separator after each. Words, word hashes and
hashes of any byte range then come from whole-array numpy operations, with no step per word.
Hashes are polynomial over uint64 with an odd base, so that a range's hash is a difference of
prefix sums times a power of the base's inverse.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = 4096
#: Bytes of text handled at once; a longer single text makes a part of its own.
PART_BYTES = 2 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_STEP, _BACK = _BASE, pow(_BASE, -1, 1 << 64)
_STEP_LOW, _BACK_LOW = _powers(_STEP, _LOW), _powers(_BACK, _LOW)


def _back(at: np.ndarray) -> np.ndarray:
    """The base's inverse to the power of each position."""
    high = _powers(pow(_BACK, _LOW, 1 << 64), int(at.max(initial=0)) // _LOW + 1)
    return high[at >> 12] * _BACK_LOW[at & (_LOW - 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix sums over `values`, from which `of(start, end)` hashes ranges."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        high = _powers(pow(_STEP, _LOW, 1 << 64), n // _LOW + 1)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        for i in range(0, n, _LOW):
            part = sums[i + 1 : i + 1 + _LOW]
            np.multiply(values[i : i + _LOW], _STEP_LOW[: len(part)], out=part)
            part *= high[i // _LOW]
        np.add.accumulate(sums, out=sums)
        self.sums = sums

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _back(start)

    def runs(self, length: int) -> np.ndarray:
        """Hashes of all ranges of this length, by their start."""
        out = self.sums[length:] - self.sums[: len(self.sums) - length]
        high = _powers(pow(_BACK, _LOW, 1 << 64), len(out) // _LOW + 1)
        for k in range(len(high)):
            part = out[k * _LOW : (k + 1) * _LOW]
            part *= _BACK_LOW[: len(part)] * high[k]
        return out


def separators(table: bytes) -> np.ndarray:
    """A look-up: True for bytes of words."""
    out = np.ones(256, dtype=bool)
    out[list(table)] = False
    return out


#: The white space of the word contract: space and \t..\r.
SPACE = separators(bytes([0x20, *range(0x09, 0x0E)]))


class Packed:
    """Words of several texts, packed with one separator byte after each word.

    buf: the bytes; start, end: of each word in buf; first: index of the first word of each text,
    and the number of words as the last entry.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray = SPACE) -> None:
        data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        word = is_word[data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        keep = word | before
        buf = data[keep]
        gap = ~word[keep]
        buf[gap] = 0x20
        self.buf = buf
        self.end = np.flatnonzero(gap)
        self.start = np.empty_like(self.end)
        if len(self.end):
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        begins = np.flatnonzero(word & ~before)
        self.first = np.searchsorted(begins, at)
        self.sums: Prefix | None = None

    def prefix(self) -> Prefix:
        if self.sums is None:
            self.sums = Prefix(self.buf)
        return self.sums

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        return mix(self.prefix().of(self.start, self.end) + np.uint64(0x51ED270B))


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def parts(sizes: Iterable[int], most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes sum to `most` at most, or single larger ones."""
    begin = total = 0
    end = 0
    for end, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield begin, end - 1
            begin, total = end - 1, 0
        total += n
    if end > begin:
        yield begin, end


def slices(batch: pa.RecordBatch, column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have `most` bytes at most, so that no more is decoded at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in parts(sizes, most):
        yield batch.slice(a, b - a)
    if not batch.num_rows:
        yield batch


def _run_tidy(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from run(batches)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def tidy(run: Callable) -> Callable:
    """`run`, for mapInArrow, giving freed memory back when its task ends: workers serve many tasks."""
    return partial(_run_tidy, run)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches sorted by these keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of many whole groups, from batches sorted by `keys`, with where each group begins
    (and the end): about `rows` rows at a time, or one larger group."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cuts_of(table: pa.Table) -> np.ndarray:
        change = np.ones(table.num_rows, dtype=bool)
        change[1:] = False
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = cuts_of(table)
            if len(cuts) > 2:
                yield table.slice(0, int(cuts[-2])), cuts[:-1]
                table = table.slice(int(cuts[-2]))
            held, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cuts_of(table)
