"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash. Pass two puts one
bucket at a time through a seeded Fisher-Yates shuffle (Spark's `shuffle` of an array draws its
indices that way). A record's place in the whole order is its bucket's offset plus its place in
the bucket; its shard is that place modulo the shard count, so shard sizes differ by one at most.

The scattering is written to the shared folder first. The driver learns only the sum of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import cut

#: Bytes of text that a bucket holds on average; a task holds one bucket at a time.
BUCKET_BYTES = 8 << 20
MOST_PARTITIONS = 1 << 15


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def two_pass_shuffle(
    df: DataFrame, shards: int, *, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES, buckets: int | None = None
) -> DataFrame:
    """All records of `df` with `shard` (0 to shards-1) and `slot` (gapless from 0 in its shard).

    Null texts and keys, empty texts, repeated rows and equal texts are records like any other:
    scattering goes by each record's own place in the input, so a key that holds a third of all
    rows spreads over all buckets. An empty table gives an empty result. Columns named `shard` or
    `slot` (in any case) are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    record = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    ticket = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    # written, so that both readings below see one scattering whatever made the input
    tickets = cut(df.select(ticket.alias("ticket"), record.alias("record"), record_bytes(F.col(f"`{text}`")).alias("bytes")), "scatter")
    if buckets is None:
        total = tickets.select(F.sum("bytes").alias("n")).first()["n"] or 0
        buckets = max(1, -(-total // bucket_bytes))
    scattered = tickets.select(F.pmod(F.shiftright("ticket", 7), F.lit(buckets)).alias("bucket"), F.struct("ticket", "record").alias("row"))
    # one count per bucket, summed up to the bucket's offset in the whole order
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("start"))

    # sorted before it is shuffled, so that a task that runs again deals out the same order
    # neighbouring buckets share a partition, of which there are not more than the cluster can hold
    n = min(buckets, MOST_PARTITIONS)
    dealt_out = scattered.withColumn("part", F.floor(F.col("bucket") * F.lit(n) / F.lit(buckets)).cast("int")).repartitionById(n, "part")
    held = dealt_out.groupBy("part", "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    dealt = held.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    place = F.col("start") + F.col("at")
    # broadcast, since a shuffled join would move all records once more; it has one row per bucket
    return dealt.join(F.broadcast(start), "bucket").select(
        *[F.col(f"row.record.c{i}").alias(c) for i, c in enumerate(kept)],
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / F.lit(shards)).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str, *, max_records_per_file: int = 1_000_000) -> None:
    """Writes the shards as folders shard=0, shard=1, ... whose files hold rows in slot order.

    A shard is written in runs of slots by several tasks, so that no task has to hold a shard.
    """
    run = F.floor(F.col("slot") / F.lit(max_records_per_file))
    (sharded.repartition("shard", run).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", max_records_per_file).partitionBy("shard").parquet(path))
