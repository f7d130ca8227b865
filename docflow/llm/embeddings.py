"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Equal vectors form a class; only one of each goes on. A vector's home is the centroid with the
largest dot product. Two unit vectors with cosine t are sqrt(2 - 2t) apart, so if they have
different homes, one of them lies within half of that of the plane between both centroids. Each
vector therefore also visits every cell whose plane is that near: no link is lost, and only
home-home and home-visitor pairs are compared. A pair that meets in two cells counts in the
smaller one. Cells are cut into blocks, pairs of blocks are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import grouped, linked_rows, task_order
from .tables import cut
from .words import groups, tidy

COSINE = 0.95
#: Vectors in a cell on average, cells at most, vectors that training reads at most, rows in a block.
CELL, CELLS, SAMPLE, BLOCK = 1000, 1024, 8192, 1024
#: Blocks' worth of visitors in a lot, and vectors compared with a block at once.
VISITORS, ROWS = 8, 2048
_PLACED = {"cell": pa.int64(), "visit": pa.bool_(), "home": pa.int64(), "cells": pa.list_(pa.int64()), "node": pa.int64(), "weight": pa.int64(), "x": pa.binary()}


def spherical_kmeans(unit: np.ndarray, k: int, *, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors. Deterministic; an empty cell takes the worst placed vector."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        dots = unit @ centres.T
        home = dots.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        empty = np.flatnonzero(np.bincount(home, minlength=len(centres)) == 0)
        sums[empty] = unit[np.argsort(dots.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)  # cosines are taken in double precision
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def join(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their cosine, in double precision, is `cosine` or more; those of different
    lengths never do. Null, empty and zero vectors and those with null or non-finite components
    link with nothing, and neither does a row with a null id (component null, kept false). Rows
    that repeat an id are vectors of their own.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("doc"), F.col(embedding).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("doc").isNotNull() & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("low", F.when(sound, F.xxhash64("x")))
    classes = cut(rows.where("low is not null").groupBy("low").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x")), "vectors")
    lengths = classes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    centres = np.zeros((0, 0))
    if lengths:
        d, n = lengths[0]["d"], lengths[0]["n"]
        some = classes.where(F.size("x") == d).where(F.pmod(F.xxhash64(F.lit(7), "low"), F.lit(1 << 30)) < int(min(1.0, 0.95 * SAMPLE / n) * (1 << 30)))
        drawn = some.select("low", "x").collect()
        if drawn:
            drawn.sort(key=lambda r: r["low"])
            centres = spherical_kmeans(_unit(np.array([r["x"] for r in drawn])), max(1, min(CELLS, round(n / cell))))
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 256 else None
    half = np.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-9
    shared = spark.sparkContext.broadcast((centres, gap))
    kind = np.float32 if "array<float>" in dict(vectors.dtypes)[embedding] else np.float64  # floats travel as they are

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, gap = shared.value
        for batch in batches:
            low, weight, vectors = (batch.column(c) for c in ("low", "weight", "x"))
            for i in range(0, len(low), 2048):
                out: list[list] = [[] for _ in _PLACED]
                values = [np.asarray(v.values, dtype=kind) for v in vectors[i : i + 2048]]
                fits = np.array([len(v) == centres.shape[1] and len(centres) > 0 for v in values])
                sees: list[np.ndarray] = [np.array([-len(v)]) for v in values]  # other lengths: a cell for each
                if fits.any():
                    at = np.flatnonzero(fits)
                    dots = _unit(np.stack([values[j] for j in at])) @ centres.T
                    home = dots.argmax(axis=1)
                    apart = gap[home] if gap is not None else np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T)) + 1e-7
                    near = dots[np.arange(len(at)), home][:, None] - dots <= half * apart
                    near[np.arange(len(at)), home] = False
                    for j, h, cells in zip(at.tolist(), home.tolist(), near, strict=True):
                        sees[j] = np.append(h, np.flatnonzero(cells))
                for j, cells in enumerate(sees):
                    own = (low[i + j].as_py(), weight[i + j].as_py(), values[j].tobytes())
                    for k, cell_ in enumerate(cells.tolist()):  # only at home is the list of visited cells of use
                        for column, v in zip(out, (cell_, k > 0, int(cells[0]), None if k else cells.tolist(), *own), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PLACED.values(), strict=True)], list(_PLACED))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_centres = max(1, len(shared.value[0]))
        for group in groups(batches, ["cell", "task_i", "task_j"]):
            node, weight, side, home = (group.column(c).to_numpy() for c in ("node", "weight", "side", "home"))
            cell_ = group.column("cell")[0].as_py()
            same = group.column("task_i")[0] == group.column("task_j")[0]
            left = np.arange(len(node)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            unit = _unit(np.stack([np.frombuffer(x.as_py(), dtype=kind) for x in group.column("x")]))
            sees = np.zeros((len(node), n_centres), dtype=bool)
            if group.column("task_j")[0].as_py() < 0:
                for i, c in enumerate(group.column("cells").to_pylist()):
                    if c:
                        sees[i, c] = True
            for a in range(0, len(right), ROWS):
                some = left if same else right[a : a + ROWS]
                linked = unit[left] @ unit[some].T >= cosine
                if same:
                    np.fill_diagonal(linked, False)
                    linked |= linked.T
                elif group.column("task_j")[0].as_py() < 0:
                    # visitors: a pair whose home row also visits the visitor's home counts in the smaller cell
                    linked &= ~(sees[left][:, home[some]] & (home[some] < cell_)[None])
                if out := linked_rows(node, weight, left, some, linked):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["node", "links", "root"])
                if same:
                    break

    placed = cut(classes.select("low", "weight", "x").mapInArrow(tidy(place), "cell long, visit boolean, home long, cells array<long>, node long, weight long, x binary"), "cells")
    sizes = placed.groupBy("cell").agg(F.count_if("visit").alias("visitors"), F.count_if(~F.col("visit")).alias("homes"))
    sizes = sizes.select("cell", F.ceil(F.col("homes") / block).cast("int").alias("blocks"), F.ceil(F.col("visitors") / (VISITORS * block)).cast("int").alias("lots"))
    known_sizes = placed.join(sizes, "cell")
    homes = known_sizes.where(~F.col("visit")).withColumn("own", F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int"))
    # home blocks with each other, then home blocks with lots of visitors, numbered -1, -2, ..
    pairs = homes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*placed.columns, F.least("own", "other").alias("task_i"), F.greatest("own", "other").alias("task_j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    hosts = homes.where("lots > 0").select(*placed.columns, F.col("own").alias("task_i"), F.explode(F.sequence(-F.col("lots"), F.lit(-1))).alias("task_j"), F.lit(0).alias("side"))
    lot = (F.lit(-1) - F.pmod(F.xxhash64(F.lit(12), "node"), F.col("lots"))).cast("int")
    guests = known_sizes.where(F.col("visit") & (F.col("blocks") > 0)).select(*placed.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("task_i"), lot.alias("task_j"), F.lit(1).alias("side"))
    tasks = task_order(pairs.union(hosts).union(guests).select("cell", "task_i", "task_j", "side", "home", "cells", "node", "weight", "x"), "cell")
    found = cut(tasks.mapInArrow(tidy(compare), "node long, links long, root long"), "links")
    known = grouped(classes.select("low", "doc", "weight"), found)
    out = rows.select("doc", "low").join(known, "low", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))
