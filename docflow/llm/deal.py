"""Rows of numbers and byte strings, shuffled in packed form.

Rows are gathered by bucket and leave as one compressed load per bucket and send, so that the
shuffle moves few large rows. Buckets are dealt to a bounded number of partitions, each of which
takes its buckets one after the other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .words import groups

#: Partitions that buckets are dealt to at most, and the bytes held before loads are sent off.
MOST_PARTITIONS, SEND_BYTES = 1 << 15, 16 << 20


def pack(columns: list[np.ndarray], strings: list[bytes] | None = None) -> bytes:
    """Columns of one length, byte planes apart (constant ones vanish), and strings."""
    planes = [(c.dtype.str, np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()) for c in columns]
    sizes = None if strings is None else np.fromiter(map(len, strings), np.int64, len(strings))
    return zstandard.compress(pickle.dumps((planes, sizes, None if strings is None else b"".join(strings)), 5), 1)


def unpack(load: bytes) -> tuple[list[np.ndarray], list[bytes] | None]:
    planes, sizes, data = pickle.loads(zstandard.decompress(load))
    columns = [np.frombuffer(p, np.uint8).reshape(np.dtype(d).itemsize, -1).T.copy().view(d).ravel() for d, p in planes]
    if sizes is None:
        return columns, None
    ends = np.cumsum(sizes)
    return columns, [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


class Dealer:
    """Gathers rows, then gives one load per bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.held: list[tuple[np.ndarray, list[np.ndarray], list[bytes] | None]] = []
        self.bytes = 0

    def add(self, key: np.ndarray, columns: list[np.ndarray], strings: list[bytes] | None = None) -> None:
        """Rows for the buckets that the (well mixed) keys give."""
        if len(key):
            self.held.append(((key.view(np.uint64) % np.uint64(self.buckets)).astype(np.int64), columns, strings))
            self.bytes += sum(c.nbytes for c in columns) + (sum(map(len, strings)) if strings else 0)

    def full(self) -> bool:
        return self.bytes >= SEND_BYTES

    def send(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        bucket = np.concatenate([b for b, _, _ in self.held])
        columns = [np.concatenate(c) for c in zip(*(c for _, c, _ in self.held), strict=True)]
        strings = None if self.held[0][2] is None else [x for _, _, s in self.held for x in s]
        self.held, self.bytes = [], 0
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[a:b]
            yield int(bucket[rows[0]]), pack([c[rows] for c in columns], None if strings is None else [strings[i] for i in rows.tolist()])


def batch_of(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def dealt(loads: DataFrame, buckets: int) -> DataFrame:
    """The loads (bucket, load) with a bucket's together and in order."""
    return loads.select("bucket", "load").repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")


def received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[bytes] | None]]:
    """Each bucket with its columns and strings, from what `dealt` gives."""
    for group in groups(batches, ["bucket"]):
        loads = [unpack(x.as_py()) for x in group.column("load")]
        columns = [np.concatenate(c) for c in zip(*(c for c, _ in loads), strict=True)]
        yield group.column("bucket")[0].as_py(), columns, None if loads[0][1] is None else [x for _, s in loads for x in s]


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, dtype=np.int64)
    return np.append(np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])), len(sorted_keys))


def local_stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One (key, node) for each key, that with the smallest node, and the links of all others to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    cuts = runs_of(key)
    head = np.repeat(node[cuts[:-1]], np.diff(cuts))
    other = node != head
    return key[cuts[:-1]], node[cuts[:-1]], node[other], head[other]
