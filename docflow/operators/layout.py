"""Layout: bounds, columns, lines, headings and sections of positioned blocks, by windows and banded joins.

Blocks: doc_id, page, block_id, x0, y0, x1, y1, text and, where stated, font_size. Joins are
always on document and page, and on bands of the coordinate they compare, so none is all-pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# ---- fixed values ------------------------------------------------------------------------------
COLUMN_GAP, COLUMN_SHARE = 32.0, 0.08
OVERLAP, WIDTHS, WIDE, PENALTY, SCORE, AMBIGUOUS = 0.28, 0.35, 0.55, 0.35, 0.20, 0.12
HEADING_REACH, BOX_SLACK, CLUSTER_GAP, CLUSTER_FACTOR, SHARE_COVERED = 120.0, 6.0, 36.0, 2.5, 0.45
KEYS = ["doc_id", "page"]


def bounds(blocks: DataFrame, by: list[str]) -> DataFrame:
    return blocks.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def gap_columns(blocks: DataFrame) -> DataFrame:
    """Adds `column` from 1: a new one at every x0 gap of max(32, 8 % of the span)."""
    w, by_x = W.partitionBy(*KEYS), W.partitionBy(*KEYS).orderBy("x0", "block_id")
    span = F.greatest(F.max("x1").over(w) - F.min("x0").over(w), F.lit(1.0))
    rows = blocks.withColumn("__new", ((F.col("x0") - F.lag("x0").over(by_x)) >= F.greatest(F.lit(COLUMN_GAP), span * COLUMN_SHARE)).cast("int"))
    return rows.withColumn("column", (F.coalesce(F.sum("__new").over(by_x.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + 1).cast("int")).drop("__new")


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The shared part of two spans as a share of the narrower one."""
    narrow = F.least(a1 - a0, b1 - b0)
    return F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / narrow).otherwise(0.0)


def geometry_score(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap less a penalty for the centres' distance; null if the spans don't fit each other."""
    share = overlap_ratio(a0, a1, b0, b1)
    wa, wb = F.greatest(a1 - a0, F.lit(1e-6)), F.greatest(b1 - b0, F.lit(1e-6))
    ratio = F.least(wa, wb) / F.greatest(wa, wb)
    score = share - F.lit(PENALTY) * F.abs((a0 + a1) / 2 - (b0 + b1) / 2) / ((wa + wb) / 2)
    return F.when((share >= OVERLAP) & ((ratio >= WIDTHS) | (share >= WIDE)) & (score >= SCORE), score)


def continued_from(parents: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of a page with the section of the page before that they go on from, or null: the best
    score, unless another section in a column apart comes within 0.12 of it.

    parents: doc_id, page, section_id, x0, x1, y1; paths: doc_id, page, path_id, x0, x1.
    """
    up = parents.select("doc_id", (F.col("page") + 1).alias("page"), "section_id", F.col("x0").alias("p0"), F.col("x1").alias("p1"), "y1")
    scored = paths.join(up, KEYS).withColumn("score", geometry_score(F.col("p0"), F.col("p1"), F.col("x0"), F.col("x1"))).where("score is not null")
    w = W.partitionBy(*KEYS, "path_id")
    top = scored.withColumn("best", F.max(F.struct("score", "p0", "p1")).over(w))
    apart = overlap_ratio(F.col("p0"), F.col("p1"), F.col("best.p0"), F.col("best.p1")) < 0.5
    rival = F.max(F.when(apart, F.col("score")))
    low = F.max_by("section_id", F.when(~apart, F.struct("y1", "section_id")))
    found = top.groupBy(*KEYS, "path_id", "best").agg(rival.alias("rival"), low.alias("section_id"))
    clear = F.col("rival").isNull() | (F.col("best.score") - F.col("rival") >= AMBIGUOUS)
    return paths.select(*KEYS, "path_id").join(found.where(clear).select(*KEYS, "path_id", "section_id"), [*KEYS, "path_id"], "left")


def heading_above(blocks: DataFrame, headings: DataFrame, *, reach: float = HEADING_REACH) -> DataFrame:
    """Blocks with the nearest heading above them, `reach` at most away, that overlaps in x; ties to
    the smaller id. headings: doc_id, page, heading_id, x0, x1, y1."""
    band = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    up = headings.select(*KEYS, "heading_id", F.col("x0").alias("h0"), F.col("x1").alias("h1"), F.col("y1").alias("hy"), F.explode(F.array(band("y1"), band("y1") + 1)).alias("band"))
    pairs = blocks.withColumn("band", band("y0")).join(up, [*KEYS, "band"]).where("hy <= y0 and y0 - hy < " + str(reach) + " and least(x1, h1) > greatest(x0, h0)")
    best = pairs.groupBy(*KEYS, "block_id").agg(F.min(F.struct((F.col("y0") - F.col("hy")).alias("distance"), "heading_id")).alias("best"))
    return blocks.join(best, [*KEYS, "block_id"], "left").select(*KEYS, "block_id", "best.heading_id")


def nearest_before(paths: DataFrame, parents: DataFrame) -> DataFrame:
    """Paths with the section of the page before whose centre is nearest; ties to the smaller id."""
    centre = (F.col("x0") + F.col("x1")) / 2
    up = parents.select("doc_id", (F.col("page") + 1).alias("page"), "section_id", centre.alias("c"))
    best = paths.withColumn("__c", centre).join(up, KEYS).groupBy(*KEYS, "path_id").agg(F.min(F.struct(F.abs(F.col("__c") - F.col("c")).alias("distance"), "section_id")).alias("best"))
    return paths.select(*KEYS, "path_id").join(best, [*KEYS, "path_id"], "left").select(*KEYS, "path_id", "best.section_id")


def inside(boxes: DataFrame, outer: DataFrame, *, slack: float = BOX_SLACK, band: float = 200.0) -> DataFrame:
    """Pairs (block_id, box_id) of blocks that lie in a box, give or take `slack`; joined on the bands
    of y that a box covers."""
    covered = F.sequence(F.floor((F.col("oy0") - slack) / band), F.floor((F.col("oy1") + slack) / band))
    out = outer.select(*KEYS, "box_id", *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("band", F.explode(covered))
    pairs = boxes.withColumn("band", F.floor(F.col("y0") / band)).join(out, [*KEYS, "band"])
    return pairs.where(f"x0 >= ox0 - {slack} and x1 <= ox1 + {slack} and y0 >= oy0 - {slack} and y1 <= oy1 + {slack}").select(*KEYS, "block_id", "box_id")


def clusters(blocks: DataFrame) -> DataFrame:
    """Adds `cluster` from 1: a new one where the y0 gap is max(36, 2.5 times the page's median gap)."""
    by_y = W.partitionBy(*KEYS).orderBy("y0", "block_id")
    rows = blocks.withColumn("__gap", F.col("y0") - F.lag("y0").over(by_y))
    typical = rows.groupBy(*KEYS).agg(F.median("__gap").alias("__typical"))
    rows = rows.join(typical, KEYS).withColumn("__new", (F.col("__gap") >= F.greatest(F.lit(CLUSTER_GAP), F.col("__typical") * CLUSTER_FACTOR)).cast("int"))
    return rows.withColumn("cluster", (F.coalesce(F.sum("__new").over(by_y.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + 1).cast("int")).drop("__gap", "__typical", "__new")


def boundary_intervals(lines: DataFrame, is_heading: Column) -> DataFrame:
    """Rows (doc_id, first, last, n): from each heading to the line before the next."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("interval", F.sum(F.when(is_heading, 1).otherwise(0)).over(w)).where("interval > 0")
    return rows.groupBy("doc_id", "interval").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count(F.lit(1)).alias("n")).drop("interval")


def merged_segments(segments: DataFrame, by: list[str]) -> DataFrame:
    """Collinear segments (x0, x1) joined where they touch or overlap: rows by, x0, x1, n."""
    order = W.partitionBy(*by).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = segments.withColumn("__new", F.when(F.col("x0") <= reach, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n")).drop("__run")


def covered_share(segments: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """Rows by, share, enough: how much of low..high the merged segments cover, and whether 45 %."""
    part = F.greatest(F.lit(0.0), F.least(F.col("x1"), high) - F.greatest(F.col("x0"), low))
    share = merged_segments(segments, by).groupBy(*by).agg((F.sum(part) / F.first(high - low)).alias("share"))
    return share.withColumn("enough", F.col("share") >= SHARE_COVERED)


def relative_box(x0: Column, y0: Column, x1: Column, y1: Column, t0: Column, u0: Column, t1: Column, u1: Column) -> Column:
    """struct<x, y, width, height> in percent of a table's box, two decimals, 0 to 100."""
    w, h = F.greatest(t1 - t0, F.lit(1e-9)), F.greatest(u1 - u0, F.lit(1e-9))
    percent = lambda c: F.least(F.greatest(F.round(c * 100, 2), F.lit(0.0)), F.lit(100.0))
    return F.struct(percent((x0 - t0) / w).alias("x"), percent((y0 - u0) / h).alias("y"), percent((x1 - x0) / w).alias("width"), percent((y1 - y0) / h).alias("height"))


def x_bucket(x0: Column) -> Column:
    return F.floor(F.coalesce(x0, F.lit(0.0)) / 200).cast("int")


def skill_context(lines: DataFrame, heading: Column, role: Column) -> Column:
    """Roles of lines; within a skills heading each other line is a SKILL."""
    last = F.last(F.when(role == "HEADING", heading), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return F.when((last == "SKILLS") & (role != "HEADING"), "SKILL").otherwise(role)


def slices(blocks: DataFrame, *, top: float = 3.0) -> DataFrame:
    """Adds `slice` from 1 down each page: a new one where a block's top lies more than `top` below
    the block before it."""
    by_y = W.partitionBy(*KEYS).orderBy("y0", "block_id")
    rows = blocks.withColumn("__new", F.when(F.col("y0") - F.lag("y0").over(by_y) > top, 1).otherwise(0))
    return rows.withColumn("slice", (F.sum("__new").over(by_y.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("int")).drop("__new")


def entry_starts(lines: DataFrame) -> DataFrame:
    """Adds `entry` from 1 in each section: a title opens one if a body line stands between it and the
    title or section start before. Two running maxima; nothing folds row by row.

    lines: doc_id, section, line_no, is_title, is_body.
    """
    before = W.partitionBy("doc_id", "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = lines.withColumn("__title", F.max(F.when(F.col("is_title"), F.col("line_no"))).over(before)).withColumn("__body", F.max(F.when(F.col("is_body"), F.col("line_no"))).over(before))
    opens = F.col("is_title") & F.col("__body").isNotNull() & (F.col("__title").isNull() | (F.col("__body") > F.col("__title")))
    upto = W.partitionBy("doc_id", "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("entry", (F.sum(opens.cast("int")).over(upto) + 1).cast("long")).drop("__title", "__body")


def cell_bind(blocks: DataFrame, cells: DataFrame, semantics: DataFrame) -> DataFrame:
    """Blocks with their cells (by parent id; several if split) and their columns' meanings."""
    bound = blocks.join(cells, blocks["block_id"] == cells["parent_block_id"], "left").drop("parent_block_id")
    return bound.join(semantics, ["table_id", "column_index"], "left")
