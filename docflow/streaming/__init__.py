"""Structured Streaming: parsed requests, idempotent replay, latest snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files as a stream; on a cluster the same frame comes from format('kafka')."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def split_requests(messages: DataFrame, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON messages (column value) as parsed rows, and those that are malformed or incomplete."""
    rows = messages.withColumn("request", F.from_json("value", schema))
    good = F.col("request").isNotNull()
    for name in required:
        good &= F.coalesce(F.col(f"request.{name}") != "", F.lit(False))
    return rows.where(good).select("request.*"), rows.where(~good).select("value")


def once_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Idempotency: the first event of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_end(result: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there now and gives its result as a batch frame.

    Each micro-batch is written to a table in `folder`: complete results replace it, others are
    appended under the batch's number, so that a batch that runs again replaces itself.
    """
    spark = result.sparkSession
    at = f"{folder}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        name = "all" if mode == "complete" else str(number)
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={name}")

    query = result.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{at}/table/*")


def events_of(requests: DataFrame, handle: Column, done: str, failed: str) -> DataFrame:
    """A stateless map of requests to events: (key, topic, value as JSON). `handle` gives a struct with
    `error`; rows without error go to the topic `done`, the others to `failed`."""
    rows = requests.withColumn("result", handle)
    topic = F.when(F.col("result.error").isNull(), F.lit(done)).otherwise(F.lit(failed))
    return rows.select(topic.alias("topic"), F.to_json("result").alias("value"))


def dead_letters(rejected: DataFrame, topic: str) -> DataFrame:
    """Malformed or incomplete messages as rows for a topic of their own, the message kept as it came."""
    return rejected.select(F.lit(topic).alias("topic"), F.to_json(F.struct(F.col("value").alias("message"), F.lit("malformed or incomplete").alias("reason"))).alias("value"))
