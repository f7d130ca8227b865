"""Connected components and blocked all-pairs work, shared by the near-duplicate operators.

Components come from hooking and pointer jumping over written edge tables, in packed form; no
link, label or component is ever gathered on the driver. All-pairs work within a cluster is cut
into blocks of bounded size, and pairs of blocks are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deal import MOST_PARTITIONS, Dealer, batch_of, pack, runs_of, unpack
from .tables import cut, forget, written
from .words import groups, mix, tidy


_EDGES = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("load", pa.binary())])
#: Kinds of loads: a bucket's own edges, edges for other buckets, asked nodes with the asking bucket, their answers.
OWN, MOVED, ASKED, TOLD = range(4)
#: Edges contracted at once before they are dealt out.
CONTRACTED = 1 << 20


def _bucket_key(node: np.ndarray) -> np.ndarray:
    return mix(node.view(np.uint64) ^ np.uint64(0x5BD1E995))


def _loads(kind: int, dealer: Dealer) -> Iterator[pa.RecordBatch]:
    for bucket, load in dealer.send():
        yield batch_of(_EDGES, kind=[kind], bucket=[bucket], load=[load])


def _contract(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars of what this task sees, dealt by their larger end."""
    dealer, held, n = Dealer(buckets), [], 0

    def stars() -> None:
        x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        at, root = forest(place[: len(x)], place[len(x) :], len(nodes))
        dealer.add(_bucket_key(nodes[at]), [nodes[at], nodes[root]])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CONTRACTED:
            stars()
            held, n = [], 0
            yield from _loads(MOVED, dealer)
    if n:
        stars()
    yield from _loads(MOVED, dealer)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[np.ndarray]]]]:
    """Each bucket with the columns of each kind of its loads."""
    for group in groups(batches, ["bucket"]):
        loads: dict[int, list] = {}
        for kind, load in zip(group.column("kind").to_pylist(), group.column("load"), strict=True):
            loads.setdefault(kind, []).append(unpack(load.as_py())[0])
        yield group.column("bucket")[0].as_py(), {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in loads.items()}


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest partner of each node a, and what its other partners b then hang from."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    cuts = runs_of(a)
    head = np.repeat(b[cuts[:-1]], np.diff(cuts))
    other = b != head
    return a[cuts[:-1]], b[cuts[:-1]], b[other], head[other]


def _hook(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces partners by what was told of them, keeps the smallest for each node, links the
    others to it and asks for the smallest's own partner, once a bucket."""
    moved, asked = Dealer(buckets), Dealer(buckets)
    for bucket, kinds in _by_bucket(batches):
        a, b = (np.concatenate(c) for c in zip(*(kinds[k] for k in (OWN, MOVED) if k in kinds), strict=True))
        if TOLD in kinds:
            node, up = kinds[TOLD]
            order = np.argsort(node)
            node, up = node[order], up[order]
            at = np.minimum(np.searchsorted(node, b), len(node) - 1)
            b = np.where(node[at] == b, up[at], b)
        a, b, x, y = _least(a, b)
        yield batch_of(_EDGES, kind=[OWN], bucket=[bucket], load=[pack([a, b])])
        moved.add(_bucket_key(x), [x, y])
        ask = np.unique(b)
        asked.add(_bucket_key(ask), [ask, np.full(len(ask), bucket, np.int64)])
        if moved.full() or asked.full():
            yield from _loads(MOVED, moved)
            yield from _loads(ASKED, asked)
    yield from _loads(MOVED, moved)
    yield from _loads(ASKED, asked)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket's edges, and for each asked node that has a partner the smallest."""
    for bucket, kinds in _by_bucket(batches):
        some = [kinds[k] for k in (OWN, MOVED) if k in kinds]
        if not some:
            continue
        a, b = (np.concatenate(c) for c in zip(*some, strict=True))
        yield batch_of(_EDGES, kind=[OWN], bucket=[bucket], load=[pack([a, b])])
        if ASKED in kinds:
            node, up, _, _ = _least(a, b)
            ask, asker = kinds[ASKED]
            at = np.minimum(np.searchsorted(node, ask), len(node) - 1)
            known = node[at] == ask
            ask, asker, up = ask[known], asker[known], up[at[known]]
            order = np.argsort(asker, kind="stable")
            cuts = runs_of(asker[order])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = order[i:j]
                yield batch_of(_EDGES, kind=[TOLD], bucket=[int(asker[rows[0]])], load=[pack([ask[rows], up[rows]])])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for load in batch.column(0):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, unpack(load.as_py())[0])), ["a", "b"])


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes on edges (a, b): the component is its smallest node.

    Loops, repeated edges and either direction are fine. Each node hooks to its smallest partner
    and jumps to that one's, until none moves. Edges lie with their larger end, a node is asked
    for once a bucket, so a hub of any size loads no task.
    """
    spark = edges.sparkSession
    schema = "kind int, bucket int, load binary"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def together(loads: DataFrame) -> DataFrame:
        return loads.select(*_EDGES.names).repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")

    now, at = written(edges.toDF("a", "b").where("a <> b").mapInArrow(tidy(partial(_contract, buckets)), schema), "edges", "kind")
    for _ in range(rounds):
        hooked, hooked_at = written(together(now).mapInArrow(tidy(partial(_hook, buckets)), schema), "hooked", "kind")
        forget(spark, at)
        now, at = written(together(hooked).mapInArrow(tidy(_answer), schema), "edges", "kind")
        moved = hooked.where(f"kind = {MOVED}").union(now.where(f"kind = {TOLD}"))
        settled = moved.isEmpty()
        forget(spark, hooked_at)
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.where(f"kind = {OWN}").select("load").mapInArrow(_rows, "a long, b long")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of links (i, j) among n places: each linked place with its root.

    Label propagation with pointer jumping, so that cliques need two or three passes.
    """
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        if np.array_equal(before, label):
            break
    hit = np.flatnonzero(label != np.arange(n))
    return hit, label[hit]


def block_tasks(members: DataFrame, cluster: str, key: Column, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """Members repeated for each pair of blocks they take part in, with columns task_i, task_j, side.

    A cluster of n members has ceil(n / block) blocks, dealt by a hash of `key`; a task (i, j) with
    i <= j compares block i with block j, side telling which of both the row is of (0 where i = j).
    Copies of a member: one per block of its cluster, so one for all but the largest clusters.
    sizes: rows whose counts a cluster give its size, where making `members` twice is dear.
    """
    counted = (members if sizes is None else sizes).groupBy(cluster).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.join(counted, cluster).withColumn("own", F.pmod(F.xxhash64(F.lit(11), key), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        *members.columns,
        F.least("own", "other").alias("task_i"),
        F.greatest("own", "other").alias("task_j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def task_order(tasks: DataFrame, cluster: str) -> DataFrame:
    """Rows of a task together, in order, ready for `words.groups`."""
    return tasks.repartition(cluster, "task_i", "task_j").sortWithinPartitions(cluster, "task_i", "task_j", "side")


def grouped(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes (low, doc, weight) with what verification found: low, class, component, links, group.

    found: rows (node, links, root), partial link counts and forest links of classes' keys. class
    is the class's smallest document, component the smallest of all classes linked with it,
    links the number of other documents linked, copies included.
    """
    of_group = components(found.select("node", "root")).toDF("low", "group")
    links = found.groupBy(F.col("node").alias("low")).agg(F.sum("links").alias("links"))
    classes = classes.join(links, "low", "left").join(of_group, "low", "left").withColumn("group", F.coalesce("group", "low"))
    first = classes.groupBy("group").agg(F.min("doc").alias("component"))
    return classes.join(first, "group").select("low", F.col("doc").alias("class"), "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "group")


def linked_rows(node: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(node, links, root) of the places that have links, from the matrix left x right.

    left is right, as the same object, for a block with itself; the matrix is symmetric then.
    """
    i, j = np.nonzero(linked)
    if not len(i):
        return None
    links = np.zeros(len(node), dtype=np.int64)
    links[left] += linked @ weight[right]
    if left is not right:
        links[right] += linked.T @ weight[left]
    root = np.arange(len(node))
    a, b = forest(left[i], right[j], len(node))
    root[a] = b
    hit = np.flatnonzero(links)
    return node[hit], links[hit], node[root[hit]]


__all__ = ["block_tasks", "components", "cut", "forest", "grouped", "linked_rows", "task_order"]
