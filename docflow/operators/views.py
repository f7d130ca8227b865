"""Views and orders: entries with their sections and blocks, total orders with substitutes for nulls, ranked picks, unions of differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: the place of a region that has none, behind all others.
LAST = 10**9


def entry_view(entries: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries (entry_id, section_id, ids) with their section's label and their blocks' texts, in the ids' order."""
    each = entries.select("entry_id", "section_id", F.posexplode("ids").alias("pos", "block_id")).join(blocks.select("block_id", "text"), "block_id")
    texts = each.groupBy("entry_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return texts.join(sections.select("section_id", "label"), "section_id", "left").select("entry_id", "label", F.col("x.text").alias("texts"))


def with_roles(lines: DataFrame, roles: DataFrame, keys: list[str], default: str) -> DataFrame:
    """Lines with their role; those without one have the default."""
    return lines.join(roles.select(*keys, "role"), keys, "left").withColumn("role", F.coalesce("role", F.lit(default)))


def numbered(rows: DataFrame, by: list[str], order: list[tuple[Column, object]], tie: str) -> DataFrame:
    """Adds `place` from 1 in a total order: columns with what stands for their nulls, then the tie-breaker."""
    keys = [F.coalesce(c, F.lit(substitute)) for c, substitute in order]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*keys, tie)).cast("long"))


def best_first_seen(rows: DataFrame, by: list[str], score: Column, order: str, value: str) -> DataFrame:
    """The value with the highest score, the earliest of equal ones."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(score, -F.col(order))).alias(value))


def top_ranked(rows: DataFrame, by: list[str], score: str, name: str, n: int) -> DataFrame:
    """The n rows with the highest score, ties by name, with `rank`."""
    w = W.partitionBy(*by).orderBy(F.desc(score), name)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def all_differences(parts: dict[str, DataFrame]) -> DataFrame:
    """Differences of several kinds as one table: columns that a kind lacks are null, `kind` tells which."""
    out = None
    for kind, df in parts.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def preamble_split(lines: DataFrame, opens: Column) -> DataFrame:
    """Adds `part`: PREAMBLE up to the first line that opens an entry in its section, then the entry's number."""
    w = W.partitionBy("doc_id", "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    n = F.sum(F.when(opens, 1).otherwise(0)).over(w)
    return lines.withColumn("part", F.when(n == 0, "PREAMBLE").otherwise(n.cast("string")))


def item_headings(lines: DataFrame, short: Column, body: Column) -> DataFrame:
    """Adds `is_heading`: a short line after which, among the next three lines, a body line comes."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, 3)
    rows = lines.withColumn("__body", body)
    return rows.withColumn("is_heading", short & F.coalesce(F.bool_or("__body").over(w), F.lit(False))).drop("__body")


def vocabulary(pairs: DataFrame, alias: str, canonical: str) -> DataFrame:
    """Aliases, lower-case and trimmed, with one canonical name each: the first by name if they disagree."""
    return pairs.where(F.trim(alias) != "").groupBy(F.lower(F.trim(alias)).alias("alias")).agg(F.min(canonical).alias("canonical"))
