"""N-gram Jaccard join by MinHash banding, links verified on the full n-gram sets.

1. Texts with the same words form a class; only its representative goes on.
2. MinHash signatures are cut into bands; band and row counts follow from the target recall.
   Representatives are shuffled on band hashes, packed, and those that share a band hash are
   joined in a star around the smallest, so rows stay in proportion to the signatures. Of those
   that share one within a part of a task only one is sent, so a hot band loads no task.
3. The components of these stars are clusters of candidates. Each representative's n-gram set
   goes to its cluster, where blocks of sets are compared all with all and the pairs at the
   threshold counted; only counts and a spanning forest of the links leave a block.
4. The components of the verified links are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deal import Dealer, batch_of, dealt, local_stars, received
from .graph import block_tasks, components, grouped, linked_rows, task_order
from .substrings import doc_key, row_key
from .tables import cut, forget, written
from .words import Packed, groups, mix, separators, slices, texts_of, tidy

GRAM, SIMILARITY, RECALL, HASHES = 5, 0.8, 0.9999, 300
#: Sets in a block, and n-grams handled at once within a pair of blocks.
BLOCK, COLUMNS = 192, 4096
NO_ID = -(1 << 63)
#: Band keys per bucket; kinds of rows: documents, loads of band keys, links.
KEYS, ROW, LOADS, LINK = 1 << 19, 0, 1, 2
_SIGNED = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("rid", pa.int64()), ("low", pa.int64()), ("bucket", pa.int32()), ("load", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
_WORD = separators(bytes(b for b in range(128) if not chr(b).isalnum()))


def bands(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding within `hashes` that finds a pair at `similarity`
    with probability `recall`: 1 - (1 - s^rows)^bands >= recall."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)) if similarity < 1 else 1, 1)
    for rows in range(2, 64):
        n = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if n * rows <= hashes:
            best = (n, rows)
    return best


def shingles(texts: list[str], gram: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all word n-grams, where each text's begin (and the end), and a digest of its words.

    Words are lower-cased runs of letters and digits. A text of fewer words than `gram` has one
    n-gram, of all its words; one without words has none and an empty digest.
    """
    packed = Packed([t.lower().encode() for t in texts], _WORD)
    word = packed.hashes()
    raw = packed.buf.tobytes()
    first = packed.first
    n = np.diff(first)
    digests = [hashlib.blake2b(raw[packed.start[a] : packed.end[b - 1]], digest_size=8).digest() if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    count = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    end = np.repeat(first[1:], count)
    padded = np.append(word, np.zeros(gram, dtype=np.uint64))
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(gram):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += np.where(at + j < end, padded[at + j], np.uint64(0))
    return mix(total), begin, digests


def _signatures(grams: np.ndarray, begin: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """Band hashes (text, band) of texts that have n-grams."""
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 32, n_bands * rows, dtype=np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, n_bands * rows, dtype=np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    cuts = begin[:-1]
    out = np.zeros((len(cuts), n_bands), dtype=np.uint64)
    buf = np.empty_like(low)
    for k in range(n_bands * rows):
        np.bitwise_xor(low, flip[k], out=buf)
        np.multiply(buf, odd[k], out=buf)
        band = out[:, k // rows]
        out[:, k // rows] = mix(band + np.minimum.reduceat(buf, cuts).astype(np.uint64) + np.uint64(k))
    return out


def _signed(gram: int, n_bands: int, rows: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_SIGNED`: each document with its class, null if it has no words; loads of band keys
    with their classes; links of classes that share a band here already, of which one is sent."""
    dealer = Dealer(buckets)

    def sent() -> Iterator[pa.RecordBatch]:
        for bucket, load in dealer.send():
            yield batch_of(_SIGNED, kind=[LOADS], bucket=[bucket], load=[load])

    for whole in batches:
        for batch in slices(whole, 2):
            grams, begin, digests = shingles(texts_of(batch.column(2)), gram)
            live = np.flatnonzero(np.diff(begin))
            low = np.zeros(batch.num_rows, dtype=np.int64)
            low[live] = np.frombuffer(b"".join(digests[i] for i in live.tolist()), dtype=np.int64)
            silent = np.ones(len(low), dtype=bool)
            silent[live] = False
            yield batch_of(_SIGNED, kind=np.full(len(low), ROW, np.int32), doc=batch.column(0), rid=batch.column(1), low=pa.array(low, mask=silent))
            if not len(live):
                continue
            _, once = np.unique(low[live], return_index=True)
            key = _signatures(grams, np.append(begin[live], begin[-1]), n_bands, rows)[once] & np.uint64((1 << 48) - 1)
            key, node, x, y = local_stars(key.ravel(), np.repeat(low[live[once]], n_bands))
            yield batch_of(_SIGNED, kind=np.full(len(x), LINK, np.int32), a=x, b=y)
            dealer.add(mix(key), [key, node])
            if dealer.full():
                yield from sent()
    yield from sent()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the classes that share a key with the smallest that has it."""
    for _, (key, node), _ in received(batches):
        _, _, x, y = local_stars(key, node)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def among(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose (doc, rid) may be among the n wanted ones: all that are and few others.

    Bits of hashes, 8 a wanted row and 1 << 26 at most, so what is broadcast never passes a
    million rows. It keeps what is not wanted out of the shuffle of an exact join after it.
    """
    bits = max(64, min(1 << 26, 8 * n))
    at = F.pmod(F.xxhash64(F.lit(5), "doc", "rid"), F.lit(bits))
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("__bits"))
    marked = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word")
    return marked.where("getbit(__bits, cast(__at & 63 as int)) = 1").select(*rows.columns)


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of the sets in a with those in b (or in a)."""
    sets = a if b is None else [*a, *b]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begins = np.ones(len(values), dtype=bool)
    begins[1:] = values[1:] != values[:-1]
    column = np.cumsum(begins) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    total = np.zeros((len(a), len(sets) - (0 if b is None else len(a))), dtype=np.float32)
    if not len(column):
        return total
    column = np.cumsum(np.diff(column, prepend=column[0]) > 0)
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        hot = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), dtype=np.float32)
        hot[owner[i:j], column[i:j] - low] = 1
        total += hot[: len(a)] @ (hot if b is None else hot[len(a) :]).T
    return total


def _verify(similarity: float):  # noqa: ANN202
    """Counts links within each pair of blocks; rows (node, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for group in groups(batches, ["cluster", "task_i", "task_j"]):
            node, weight, side = (group.column(c).to_numpy() for c in ("node", "weight", "side"))
            _, once = np.unique(node, return_index=True)  # rows that repeat a document bring its set again
            node, weight, side = node[once], weight[once], side[once]
            sets = [np.frombuffer(group.column("grams")[i].as_py(), dtype=np.uint64) for i in once.tolist()]
            same = group.column("task_i")[0] == group.column("task_j")[0]
            left = np.arange(len(node)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            common = _common([sets[i] for i in left], None if same else [sets[i] for i in right]).astype(np.float64)
            size = np.array([len(s) for s in sets], dtype=np.float64)
            linked = common >= similarity * (size[left][:, None] + size[right][None] - common)
            if same:
                np.fill_diagonal(linked, False)
            if out := linked_rows(node, weight, left, right, linked):
                held.append(out)
                rows += len(out[0])
            if rows > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["node", "links", "root"])
                held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["node", "links", "root"])

    return run


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, component_id, n_links.

    class_id is the smallest doc_id with the same words, component_id the smallest reachable by
    links of Jaccard similarity >= `similarity`, n_links the number of other documents linked
    directly, copies included. A text without words (null, empty, punctuation only) links with
    nothing. Rows that repeat an id are documents of their own; a null id counts as the smallest
    and comes back null.
    """
    each, classes = _linked(docs, doc_id, text, gram, similarity, recall, hashes, block)
    known = each.join(classes, "low", "left")  # rows without words are in no class
    shown = {"doc_id": F.col("doc"), "class_id": F.coalesce("class", "doc"), "component_id": F.coalesce("component", "doc")}
    return known.select(*[F.when(c != NO_ID, c).alias(n) for n, c in shown.items()], F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """Rows (doc, rid) of all documents but the first of each group of near copies, each once.

    The first has the smallest doc, then rid; `substrings.doc_key` and `row_key` give both.
    """
    each, classes = _linked(docs, doc_id, text, gram, similarity, recall, hashes, block)
    rows = each.join(classes.select("low", "group"), "low")
    first = rows.groupBy("group").agg(F.min(F.struct("doc", "rid")).alias("first"))
    return rows.join(first, "group").where("struct(doc, rid) <> first").select("doc", "rid").distinct()


def _linked(docs: DataFrame, doc_id: str, text: str, gram: int, similarity: float, recall: float, hashes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc, rid, low: null without words) and their classes with links and groups."""
    n_bands, rows = bands(similarity, recall, hashes)
    buckets = max(1, -(-docs.count() * n_bands // KEYS))
    texts = docs.select(doc_key(F.col(doc_id)).alias("doc"), row_key(F.col(text)).alias("rid"), F.col(text).alias("text"))
    signed, signed_at = written(texts.mapInArrow(tidy(partial(_signed, gram, n_bands, rows, buckets)), "kind int, doc long, rid long, low long, bucket int, load binary, a long, b long"), "signatures", "kind")
    links = dealt(signed.where(f"kind = {LOADS}"), buckets).mapInArrow(tidy(_shared), "a long, b long").union(signed.where(f"kind = {LINK}").select("a", "b"))
    clusters = components(links).toDF("low", "cluster")
    forget(docs.sparkSession, f"{signed_at}/kind={LOADS}", f"{signed_at}/kind={LINK}")
    each = signed.where(f"kind = {ROW}").select("doc", "rid", "low")
    classes = each.where("low is not null").groupBy("low").agg(F.min(F.struct("doc", "rid")).alias("first"), F.count(F.lit(1)).alias("weight"))
    members = cut(classes.join(clusters, "low").select("low", "first.doc", "first.rid", "cluster", "weight"), "members")
    sets = among(texts, members, members.count()).join(members, ["doc", "rid"]).select("low", "cluster", "weight", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                grams, begin, _ = shingles(texts_of(batch.column("text")), gram)
                packed = [np.unique(grams[a:b]).tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["node", "cluster", "weight", "grams"])

    grams = sets.mapInArrow(tidy(gather), "node long, cluster long, weight long, grams binary")
    tasks = task_order(block_tasks(grams, "cluster", F.col("node"), block, sizes=members), "cluster")
    found = cut(tasks.mapInArrow(tidy(_verify(similarity)), "node long, links long, root long"), "links")
    return each, grouped(classes.select("low", "first.doc", "weight"), found)
