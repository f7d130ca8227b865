"""Relational, sequence, matching, grounding and evaluation operators on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# ---- store -----------------------------------------------------------------------------------
def filtered(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """AND of the predicates that are given."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in a total order; plans as a top-k, not as a full sort."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest `order` per key, as a map-side combined aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def with_is_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows with `is_latest` derived, never updated in place."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__best"))
    return df.join(best, keys).withColumn("is_latest", F.struct(*order) == F.col("__best")).drop("__best")


def new_content(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the store lacks, one per key."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


# ---- sequences -------------------------------------------------------------------------------
def islands(df: DataFrame, by: list[str], order: str, starts: Column, name: str) -> DataFrame:
    """Numbers runs from 1: a run begins where `starts` holds (null: it doesn't) and at the first row."""
    w = W.partitionBy(*by).orderBy(order)
    flag = F.when(F.lag(F.lit(1)).over(w).isNull() | F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__flag", flag).withColumn(name, F.sum("__flag").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__flag")


def gap(by: list[str], order: str, value: Column) -> Column:
    return value - F.lag(value).over(W.partitionBy(*by).orderBy(order))


def carried(by: list[str], order: str, value: Column) -> Column:
    """The last non-null value up to here."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def ahead(by: list[str], order: str, value: Column, n: int) -> Column:
    """The next n values, in order."""
    return F.collect_list(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(1, n))


def reading_order(blocks: DataFrame, *, least: float = 60.0, share: float = 0.18) -> DataFrame:
    """Two columns where the widest x gap reaches max(least, share of the width), then top down.

    blocks: doc_id, page, block_id, x0, x1, y0 and, if there, text. Adds `column` and `position`
    from 1. Artifacts (lone bullets, punctuation) take no part in the search for the gap; a page
    of two columns loses them, one of one column keeps them.
    """
    from ..functions.fields import artifact

    keys = ["doc_id", "page"]
    w = W.partitionBy(*keys)
    marked = blocks.withColumn("__artifact", artifact(F.col("text")) if "text" in blocks.columns else F.lit(False))
    clean, by_x = ~F.col("__artifact"), W.partitionBy(*keys, "__artifact").orderBy("x0", "block_id")
    rows = marked.withColumn("__gap", F.lead("x0").over(by_x) - F.col("x0"))
    width = F.max(F.when(clean, F.col("x1"))).over(w) - F.min(F.when(clean, F.col("x0"))).over(w)
    rows = rows.withColumn("__width", width).withColumn("__cut", F.max(F.when(clean, F.struct("__gap", (-F.col("x0")).alias("__left")))).over(w))
    two = F.coalesce(F.col("__cut.__gap") >= F.greatest(F.lit(least), F.lit(share) * F.col("__width")), F.lit(False))
    rows = rows.withColumn("__two", two).where("not __artifact or not __two")
    rows = rows.withColumn("column", F.when(F.col("__two") & (F.col("x0") > -F.col("__cut.__left")), 2).otherwise(1))
    place = F.row_number().over(w.orderBy("column", "y0", "x0", "block_id"))
    return rows.withColumn("position", place.cast("long")).drop("__gap", "__width", "__cut", "__two", "__artifact")


#: Fixed value: what makes a fragment a list item.
_MARKED = r"^\s*(?:[•●▪‣◦·*]|[-–—](?=\s|$)|\d+\.\s)"


def merge_lines(blocks: DataFrame, *, drift: float = 1.0, reach: float = 1.5) -> DataFrame:
    """Joins neighbouring fragments of one baseline. Sequential by nature: each fragment is held
    against the run's first y0, its last x0 and its right edge so far, so it folds over sorted
    partitions, many pages a batch, and holds one run at a time. A list item neither joins a run nor
    is joined; fragments go left to right; without a font size on either side none is joined over a gap.
    """
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    marked = re.compile(_MARKED)
    nan = float("nan")
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("line", pa.int64()), ("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64()), ("y0", pa.float64()), ("n_parts", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, run = None, 0, None  # run: texts, least x0, right edge, first y0, least y0, parts, first size
        last_x0 = last_size = 0.0
        last_item = False
        out: list[tuple] = []

        def end() -> None:
            texts, x0, right, _, y0, n, _ = run
            out.append((*key, line, " ".join(texts), x0, right, y0, n))

        for batch in batches:
            for doc, page, x0, x1, y0, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x0, x1, y0 = (nan if v is None else v for v in (x0, x1, y0))
                size = 0.0 if size is None or size != size else size
                item = bool(marked.match(text or ""))
                if run is not None and key == (doc, page) and abs(y0 - run[3]) <= drift and x0 >= last_x0 and not item and not last_item and x0 - run[2] <= reach * (size or last_size or run[6]):
                    if text:
                        run[0].append(text)
                    run[1], run[2], run[4], run[5] = min(run[1], x0), max(run[2], x1), min(run[4], y0), run[5] + 1
                else:
                    if run is not None:
                        end()
                    line = line + 1 if run is not None and key == (doc, page) else 1
                    key, run = (doc, page), [[text] if text else [], x0, x1, y0, y0, 1, size]
                last_x0, last_size, last_item = x0, size, item
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        if run is not None:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    order = [F.col(c).asc_nulls_last() for c in ("y0", "x0", "block_id")]
    placed = blocks.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", *order)
    rows = placed.select("doc_id", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0")], "text", F.col("font_size").cast("double").alias("font_size"))
    return rows.mapInArrow(fold, "doc_id long, page int, line long, text string, x0 double, x1 double, y0 double, n_parts long")


# ---- spatial and matching joins --------------------------------------------------------------
def right_of(blocks: DataFrame, *, tolerance: float = 1.0, band: float = 8.0) -> DataFrame:
    """Pairs on one baseline, the right one beginning behind the left one's end. Equi-joined on page and a band of y0
    (each left block looks into its own and the neighbouring bands), so no all-pairs join is planned."""
    left = blocks.select("doc_id", "page", F.col("block_id").alias("left_id"), F.col("x1").alias("lx"), F.col("y0").alias("ly"), F.explode(F.sequence(F.floor(F.col("y0") / band) - 1, F.floor(F.col("y0") / band) + 1)).alias("band"))
    right = blocks.select("doc_id", "page", F.col("block_id").alias("right_id"), F.col("x0").alias("rx"), F.col("y0").alias("ry"), F.floor(F.col("y0") / band).alias("band"))
    return left.join(right, ["doc_id", "page", "band"]).where((F.abs(F.col("ly") - F.col("ry")) <= tolerance) & (F.col("rx") > F.col("lx"))).select("doc_id", "page", "left_id", "right_id")


def last_before(rows: DataFrame, by: list[str], order: str, is_anchor: Column, value: Column) -> DataFrame:
    """As-of join within one table: each row with the last anchor's value before it."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("anchor", F.last(F.when(is_anchor, value), ignorenulls=True).over(w))


def best_overlap(left: DataFrame, right: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """For each a the b that shares most items; ties to the smaller b. Rows a, b, shared."""
    counts = left.select(a, item).distinct().join(right.select(b, item).distinct(), item).groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"))
    best = F.max_by(F.struct(b, "shared"), F.struct("shared", -F.col(b)))
    return counts.groupBy(a).agg(best.alias("best")).select(a, f"best.{b}", "best.shared")


# ---- evidence --------------------------------------------------------------------------------
def evidence(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Claims with their evidence texts in cited order. claims: claim_id, doc_id, ids array; blocks: doc_id, block_id, text."""
    cited = claims.select("claim_id", "doc_id", F.posexplode("ids").alias("pos", "block_id"))
    found = cited.join(blocks.select("doc_id", "block_id", "text"), ["doc_id", "block_id"])
    return found.groupBy("claim_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("texts")).withColumn("texts", F.col("texts.text"))


def unknown_ids(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    return claims.select("claim_id", "doc_id", F.explode("ids").alias("block_id")).join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")


def duplicate_owners(owned: DataFrame, item: list[str], owner: str) -> DataFrame:
    return owned.groupBy(*item).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


# ---- records ---------------------------------------------------------------------------------
def unpivot_record(df: DataFrame, key: str, fields: list[str], items: str | None = None) -> DataFrame:
    """Long form (key, section, item_index, field, value); null and blank values dropped."""
    pairs = F.array(*[F.struct(F.lit("record").alias("section"), F.lit(0).alias("item_index"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    if items:
        pairs = F.concat(pairs, F.transform(items, lambda x, i: F.struct(F.lit(items).alias("section"), i.alias("item_index"), F.lit("value").alias("field"), x.cast("string").alias("value"))))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.section", F.col("p.item_index").cast("long").alias("item_index"), "p.field", "p.value").where("value is not null and trim(value) <> ''")


def diff_records(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Positions whose value differs, with what happened."""
    a, b = before.withColumnRenamed("value", "old"), after.withColumnRenamed("value", "new")
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", what)


# ---- evaluation ------------------------------------------------------------------------------
def gate(row: dict[str, Column], limits: dict[str, tuple[str, float]]) -> Column:
    """Reasons why a gate fails: names whose value is beyond its limit, in order."""
    tests = [F.when(row[n] < v if op == ">=" else row[n] > v, F.lit(f"{n} {op} {v:g}")) for n, (op, v) in limits.items()]
    return F.array_compact(F.array(*tests))
