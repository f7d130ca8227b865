"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, all on diagonals (place in the text minus place in the
passage) within k of each other. Texts' q-grams are looked up in the benchmark's, hits counted in
overlapping bands of diagonals, bands that reach the bound are kept, and only these regions are
verified, by banded alignment. Texts stay where they are: nothing is shuffled.

The benchmark goes to the tasks in blocks of bounded size (`BLOCK_CHARS`), one pass a block.
Characters are compared lower-cased, each run of white space as one space.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Prefix, mix, slices, texts_of, tidy

Q, EDIT_RATE = 8, 0.1
BLOCK_CHARS, PART_CHARS = 4 << 20, 1 << 19
_BITS = 22
MATCHES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits")]))


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts after folding, a 0 after each; where each begins (and the end);
    and the place among all texts that each came from. Control characters count as white space."""
    joined = "\0".join([t.replace("İ", "i").replace("\0", " ") for t in texts] + [""]).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (code - np.uint32(1)) < 32  # 0 wraps around
    keep = np.ones(len(code), dtype=bool)
    np.logical_and(space[1:], space[:-1], out=keep[1:])
    np.logical_not(keep[1:], out=keep[1:])
    place = np.flatnonzero(keep)
    out = code[place]
    out[space[place]] = 32
    return out, np.concatenate([[0], np.flatnonzero(out == 0) + 1]), place


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in a passage of m characters: such that the bound stays above zero."""
    return max(0, min(int(rate * m), (m - q) // q))


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the pattern and a part of the text that starts on a diagonal in
    low..high, in a band around these, and where that part ends; any number over `most` if there
    are more. anchored: the part starts at 0."""
    m, big = len(pattern), 1 << 20
    width = high - low + 1
    step = np.arange(width)
    place = low + step
    row = np.where((place >= 0) & (place <= len(text)), np.abs(place) if anchored else 0, big)
    for i in range(1, m + 1):
        at = place + i  # the text place after this row's character, by diagonal
        inside = (at >= 1) & (at <= len(text))
        same = text[np.clip(at - 1, 0, max(0, len(text) - 1))] == pattern[i - 1] if len(text) else np.zeros(width, dtype=bool)
        here = np.where(inside, row + ~same, big)
        here[:-1] = np.minimum(here[:-1], row[1:] + 1)  # a pattern character without a partner
        if not inside.all():
            here[(at < 0) | (at > len(text))] = big
        row = np.minimum.accumulate(here - step) + step  # text characters without a partner
        row[(at < 0) | (at > len(text))] = big
        if row.min() > most:
            return big, 0
    best = int(row.argmin())
    return int(row[best]), int(place[best] + m)


class Scanner:
    """The q-gram index of one block of passages."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q = q
        items = sorted((i, t) for i, t in items if t)
        code, begin, _ = folded([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.codes = [code[a : b - 1] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        # white space at the ends is no part of a passage
        self.codes = [np.trim_zeros(np.where(c == 32, 0, c)) if len(c) and (c[0] == 32 or c[-1] == 32) else c for c in self.codes]
        self.codes = [np.where(c == 0, 32, c) for c in self.codes]
        self.texts = ["".join(map(chr, c.tolist())) for c in self.codes]
        length = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([budget(m, q, rate) for m in length.tolist()], dtype=np.int64)
        self.bound = np.maximum(1, length - q + 1 - self.edits * q)
        self.length = length
        grams, owner, place = [], [], []
        for i, c in enumerate(self.codes):
            n = len(c) - q + 1
            if n > 0:  # a passage shorter than a q-gram has none and matches nothing
                grams.append(self.hashes(c, n))
                owner.append(np.full(n, i))
                place.append(np.arange(n))
        grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.grams >> np.uint64(64 - _BITS)] = True

    def hashes(self, code: np.ndarray, n: int) -> np.ndarray:
        """Mixed hashes of the first n q-grams. Equal only for equal q-grams, but for chance."""
        return mix(Prefix(code).runs(self.q)[:n])

    def regions(self, code: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, passage, and the first and last diagonal of each run of bands that reach the bound."""
        n = len(code) - self.q + 1
        if n <= 0 or not len(self.grams):
            return
        hashes = self.hashes(code, n)
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _BITS)])
        found = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        hit = self.grams[found] == hashes[at]
        at, found = at[hit], found[hit]
        many = self.first[found + 1] - self.first[found]
        event = np.repeat(self.first[found] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = self.owner[event]
        at = np.repeat(at, many)
        text = np.searchsorted(begin, at, side="right") - 1
        diagonal = at - begin[text] - self.place[event]
        pair = text * len(self.codes) + item
        if (len(begin) - 1) * len(self.codes) <= 8 * len(code):
            count = np.bincount(pair)[pair]
        else:
            _, pair, count = np.unique(pair, return_inverse=True, return_counts=True)
            count = count[pair]
        enough = np.flatnonzero(count >= self.bound[item])
        if not len(enough):
            return
        text, item, diagonal = text[enough], item[enough], diagonal[enough]
        step = self.edits[item] + 1
        band = diagonal // step
        both = np.stack([np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
        both = both[:, np.lexsort(both[::-1])]
        cuts = np.flatnonzero(np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0), [True]]))
        full = both[:, cuts[:-1][np.diff(cuts) >= self.bound[both[1, cuts[:-1]]]]]
        if not full.shape[1]:
            return
        # bands that overlap or touch are one region
        joins = (full[0, 1:] == full[0, :-1]) & (full[1, 1:] == full[1, :-1]) & (full[2, 1:] - full[2, :-1] <= 2)
        first = np.flatnonzero(np.concatenate([[True], ~joins]))
        last = np.append(first[1:], full.shape[1]) - 1
        for a, z in zip(first.tolist(), last.tolist(), strict=True):
            t, i, b = full[:, a].tolist()
            step = int(self.edits[i]) + 1
            yield t, i, b * step, (int(full[2, z]) + 2) * step - 1

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the matches (item, start, end, edits): of each region that with the fewest edits."""
        code, begin, origin = folded(texts)
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for t, i, low, high in self.regions(code, begin):
            base, end = int(begin[t]), int(begin[t + 1]) - 1
            m, k = int(self.length[i]), int(self.edits[i])
            a = max(0, low - k)
            part = code[base + a : min(end, base + high + m + k)]
            exact = "".join(map(chr, part.tolist())).find(self.texts[i])
            if exact >= 0:
                edits, start, stop = 0, exact, exact + m
            else:
                edits, stop = align(self.codes[i], part, low - a - k, high - a + k, k)
                if edits > k:
                    continue
                back, length = align(self.codes[i][::-1], part[:stop][::-1], -k, k, k, anchored=True)
                start = stop - length if back <= edits else max(0, stop - m)
            found[t].append((i, a + start, a + stop, edits))
        for t, matches in enumerate(found):
            if len(matches) > 1:  # neighbouring bands see one place
                best: list[tuple[int, int, int, int]] = []
                for x in sorted(matches, key=lambda x: (x[0], x[3], x[1])):
                    if not any(y[0] == x[0] and y[1] < x[2] and x[1] < y[2] for y in best):
                        best.append(x)
                found[t] = matches = best
            if matches:
                at = origin[begin[t] : begin[t + 1]] - sum(len(x) + 1 for x in texts[:t])
                found[t] = sorted((self.ids[i], int(at[a]), int(at[b - 1]) + 1, e) for i, a, b, e in matches)
        return found


def blocks(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's passages in blocks of about `block_chars` characters; null ids and texts are left out."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    total = rows.select(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = -(-total // block_chars)
    for k in range(n):
        yield [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


def _each(docs: DataFrame, text: str, scanner: Scanner, give, schema: T.StructType) -> DataFrame:  # noqa: ANN001
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = pickle.loads(held.value)
        for whole in batches:
            for batch in slices(whole, place, PART_CHARS):
                yield from give(batch, scanner.scan(texts_of(batch.column(place))))

    return docs.mapInArrow(tidy(run), schema)


def matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits): where passages occur in the documents' texts.

    A match has at most `rate` times the passage's length of edits, and for short passages as few
    as keep the bound positive; passages shorter than q match nothing. Null and empty texts have
    no match; rows that repeat are searched each for itself. An empty benchmark gives no rows.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "start", "end", "edits")])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def give(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        flat = [(i, *m) for i, own in zip(ids, found, strict=True) for m in own]
        columns = list(zip(*flat, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

    out = None
    for items in blocks(benchmark, block_chars=block_chars):
        one = _each(rows, "text", Scanner(items, q, rate), give, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a match, all columns as they are."""

    def give(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        clean = pa.array([not own for own in found], pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(clean) for c in batch.columns], batch.schema.names)

    for items in blocks(benchmark, block_chars=block_chars):
        docs = _each(docs, text, Scanner(items, q, rate), give, docs.schema)
    return docs
