"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words. Each window's minimiser is the smallest hash among its
`GRAM`-word grams; consecutive windows of a document that share it travel as one packed string (a
super-k-mer) to the minimiser's bucket, where sorting finds equal windows exactly. Equal windows
always share a bucket, so the first occurrence over all documents is known there.

Copies are thinned before the shuffle: of equal super-k-mers in one batch only the earliest
travels as text; the others' windows are later occurrences already. Strings of one batch and
bucket travel together, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deal import MOST_PARTITIONS
from .words import Packed, Prefix, groups, mix, parts, slices, tidy

WINDOW, GRAM = 20, 3
#: Bytes of text per bucket, and bytes of text from which a batch's strings are sent off.
BUCKET_BYTES, SEND_BYTES = 4 << 20, 12 << 20
_SENT = pa.schema([("bucket", pa.int32()), ("load", pa.binary())])
_FOUND = pa.schema([("doc", pa.int64()), ("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def doc_key(doc_id: Column) -> Column:
    """The id as a key that is never null; null ids come first."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def row_key(text: Column) -> Column:
    """Tells rows that share an id apart by their text; equal rows count as one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def super_kmers(packed: Packed, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word, number of words and minimiser of each super-k-mer."""
    n_words = len(packed.start)
    none = np.zeros(0, dtype=np.int64)
    if n_words < window:
        return none, none, none, none.astype(np.uint64)
    word = packed.hashes()
    grams = word[: n_words - gram + 1].copy()
    for j in range(1, gram):
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams += word[j : n_words - gram + 1 + j]
    least = _slide_min(mix(grams), window - gram + 1)
    text = np.repeat(np.arange(len(packed.first) - 1), np.diff(packed.first))
    whole = np.flatnonzero(text[: n_words - window + 1] == text[window - 1 :])
    if not len(whole):
        return none, none, none, none.astype(np.uint64)
    least, owner = least[whole], text[whole]
    begins = np.ones(len(whole), dtype=bool)
    begins[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begins)
    n = np.diff(np.append(at, len(whole)))
    return owner[at], whole[at], n + window - 1, least[at]


def _pack_bucket(load: tuple[np.ndarray, ...], strings: list[bytes]) -> bytes:
    head = np.array([len(load[0])], dtype=np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(x, dtype=np.int64).tobytes() for x in load) + b"\n".join(strings), 3)


def _unpack_bucket(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n), raw[8 + 40 * n :]


def _first_equal(strings: list[bytes], order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each string the position of the first equal one; `order` is by hash, ties by position."""
    first = np.arange(len(order))
    begins = np.flatnonzero(~same)
    ends = np.append(begins[1:], len(order))
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            seen: dict[bytes, int] = {}
            for i in order[a:b].tolist():
                first[i] = seen.setdefault(strings[i], i)
    return first


class Sender:
    """Gathers super-k-mers of several parts by bucket, then gives one row per bucket."""

    def __init__(self, buckets: int, window: int, gram: int) -> None:
        self.buckets, self.window, self.gram = buckets, window, gram
        self.held: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []
        self.bytes = 0

    def add(self, docs: np.ndarray, rids: np.ndarray, texts: list[bytes]) -> None:
        packed = Packed(texts)
        owner, word, n, least = super_kmers(packed, self.window, self.gram)
        if not len(owner):
            return
        raw = packed.buf.tobytes()
        low, high = packed.start[word], packed.end[word + n - 1]
        strings = [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        hashes = packed.prefix().of(low, high)
        bucket = (mix(least ^ np.uint64(0xA5A5)) % np.uint64(self.buckets)).astype(np.int64)
        self.held.append((np.stack([docs[owner], rids[owner], word - packed.first[owner], n, hashes.view(np.int64)]), strings, bucket))
        self.bytes += len(raw)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        head = np.concatenate([h for h, _, _ in self.held], axis=1)
        strings = [s for _, x, _ in self.held for s in x]
        bucket = np.concatenate([b for _, _, b in self.held])
        self.held, self.bytes = [], 0
        doc, rid, word, n, hashes = head
        # in document order, so that the first of equal strings is the earliest
        rank = np.lexsort((word, rid, doc))
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        order = np.lexsort((place, hashes))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = hashes[order[1:]] == hashes[order[:-1]]
        first = _first_equal(strings, order, same)
        own = np.arange(len(first))
        again = (doc == doc[first]) & (rid == rid[first]) & (word == word[first]) & (first != own)
        # a later equal one travels without text: its words are all covered by later occurrences
        later = (first != own) & ~again
        keep = np.flatnonzero((first == own) | later)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[keep], prepend=-1, append=-1))
        ids, loads = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = keep[a:b]
            ids.append(int(bucket[rows[0]]))
            loads.append(_pack_bucket((doc[rows], rid[rows], word[rows], n[rows], later[rows]), [b"" if later[i] else strings[i] for i in rows.tolist()]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(loads, pa.binary())], schema=_SENT)


def _equal_ranges(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ranges of n bytes at a and at b are equal, for each pair."""
    out = np.empty(len(n), dtype=bool)
    for i, j in parts(n.tolist(), 1 << 20):
        size = n[i:j]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        equal = buf[np.repeat(a[i:j], size) + step] == buf[np.repeat(b[i:j], size) + step]
        out[i:j] = np.logical_and.reduceat(equal, begin)
    return out


def repeats(load: np.ndarray, text: bytes, window: int) -> tuple[np.ndarray, ...]:
    """Covered words (doc, rid, first word, last word) of the bucket's later occurrences.

    load: rows doc, rid, word, number of words, later; text: the strings, one per line.
    """
    done = load[4] == 1
    out = [load[0][done], load[1][done], load[2][done], load[2][done] + load[3][done] - 1]
    order = np.lexsort((load[2], load[1], load[0]))
    order = order[~done[order]]
    if not len(order):
        return tuple(out)
    buf = np.frombuffer(text + b"\n", dtype=np.uint8)
    gap = np.flatnonzero((buf == 0x20) | (buf == 0x0A))  # what Packed and the lines write; other control bytes are of words
    start = np.concatenate([[0], gap[:-1] + 1])
    lines = np.flatnonzero(buf[gap] == 0x0A)
    # lines without text are single empty words; the others' words are start..gap
    line_first = np.concatenate([[0], lines[:-1] + 1])
    doc, rid, word, n, first = load[0][order], load[1][order], load[2][order], load[3][order], line_first[order]
    count = n - window + 1
    begin = np.cumsum(count) - count
    step = np.arange(int(count.sum())) - np.repeat(begin, count)
    at = np.repeat(first, count) + step
    low, high = start[at], gap[at + window - 1]
    hashes = Prefix(buf).of(low, high)
    by_hash = np.argsort(hashes, kind="stable")  # of equal ones the earliest stands first
    same = np.zeros(len(by_hash), dtype=bool)
    same[1:] = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
    run = np.flatnonzero(~same)
    head = by_hash[np.repeat(run, np.diff(np.append(run, len(by_hash))))]
    later = np.flatnonzero(same)
    mine, theirs = by_hash[later], head[later]
    size = high[mine] - low[mine]
    equal = size == high[theirs] - low[theirs]
    equal[equal] = _equal_ranges(buf, low[mine[equal]], low[theirs[equal]], size[equal])
    first_of = np.arange(len(hashes))
    first_of[mine[equal]] = theirs[equal]
    if not equal.all():  # a hash shared by unequal windows: compare all of its windows as bytes
        raw = buf.tobytes()
        seen: dict[bytes, int] = {}
        shared = np.isin(hashes, hashes[mine[~equal]])
        for i in np.flatnonzero(shared).tolist():
            first_of[i] = seen.setdefault(raw[low[i] : high[i]], i)
    owner = np.repeat(np.arange(len(order)), count)
    head_owner = owner[first_of]
    again = (doc[owner] == doc[head_owner]) & (rid[owner] == rid[head_owner]) & (word[owner] + step == word[head_owner] + step[first_of])
    hit = np.flatnonzero((first_of != np.arange(len(first_of))) & ~again)
    if len(hit):  # runs of neighbouring windows become one range
        begins = np.ones(len(hit), dtype=bool)
        begins[1:] = (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        a = hit[begins]
        b = hit[np.append(np.flatnonzero(begins)[1:] - 1, len(hit) - 1)]
        found = (doc[owner[a]], rid[owner[a]], word[owner[a]] + step[a], word[owner[a]] + step[b] + window - 1)
        out = [np.concatenate([x, y]) for x, y in zip(out, found, strict=True)]
    return tuple(out)


def repeated_ranges(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """Rows (doc, rid, low, high): words low..high lie in windows that also start earlier."""
    rows = docs.select(doc_key(F.col(doc_id)).alias("doc"), row_key(F.col(text)).alias("rid"), F.col(text).alias("text"))
    if buckets is None:
        total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
        buckets = max(1, -(-total // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, window, gram)
        for whole in batches:
            for batch in slices(whole, 2):
                doc, rid = (batch.column(i).to_numpy() for i in (0, 1))
                sender.add(doc, rid, [(t.as_py() or "").encode() for t in batch.column(2)])
                if sender.bytes >= SEND_BYTES:
                    yield from sender.send()
        yield from sender.send()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket"]):
            loads, texts = zip(*(_unpack_bucket(b.as_py()) for b in group.column("load")), strict=True)
            found = repeats(np.concatenate(loads, axis=1), b"\n".join(texts), window)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_FOUND)

    sent = rows.mapInArrow(tidy(send), "bucket int, load binary").repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(tidy(find), "doc long, rid long, low long, high long")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, kept_text (kept words joined by one space), n_words, n_removed.

    Windows are judged on the input; the earliest occurrence is that with the smaller doc_id, or
    the earlier start. Null ids come before all others. A null text has no words. Rows that
    repeat both id and text count as one document and get equal results; of rows that share only
    the id, a hash of the text tells which comes first. Texts shorter than a window stay whole.
    """
    ranges = repeated_ranges(docs, doc_id=doc_id, text=text, window=window, gram=gram, buckets=buckets)
    lists = ranges.groupBy("doc", "rid").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), doc_key(F.col(doc_id)).alias("doc"), row_key(F.col(text)).alias("rid"))
    joined = rows.join(lists, ["doc", "rid"], "left").select("doc_id", "text", "low", "high")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            kept, n, gone = [], [], []
            packed = Packed([(t.as_py() or "").encode() for t in batch.column(1)])
            raw = packed.buf.tobytes()
            for i, (first, last) in enumerate(zip(packed.first[:-1].tolist(), packed.first[1:].tolist(), strict=True)):
                n.append(last - first)
                if batch.column(2)[i].is_valid and first < last:
                    change = np.zeros(last - first + 1, dtype=np.int64)
                    np.add.at(change, np.asarray(batch.column(2)[i].values), 1)
                    np.add.at(change, np.asarray(batch.column(3)[i].values) + 1, -1)
                    stay = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                    gone.append(last - first - len(stay))
                    # runs of kept words are slices of the packed text
                    cut = np.flatnonzero(np.diff(stay, prepend=-2) != 1)
                    ends = np.append(cut[1:] - 1, len(stay) - 1) if len(stay) else cut
                    runs = zip(packed.start[first + stay[cut]].tolist(), packed.end[first + stay[ends]].tolist(), strict=True)
                    kept.append(b" ".join([raw[x:y] for x, y in runs]))
                else:
                    gone.append(0)
                    kept.append(raw[packed.start[first] : packed.end[last - 1]] if first < last else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "kept_text", "n_words", "n_removed"])

    return joined.mapInArrow(tidy(drop), "doc_id long, kept_text string, n_words long, n_removed long")
