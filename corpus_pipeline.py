"""A training corpus from `documents`, in five stages; registered as query `pipeline`.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and all but the
last give back the columns of documents. `run` writes each stage as Parquet in the shared folder
and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import decontaminate, jaccard, lines, packing, substrings, tables, toxicity
from docflow.llm.queries import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below their language's threshold, and below 0.3.

    Null and empty texts have the score of no word; without a toxic label at hand all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.judge(toxicity.score(docs.select(*COLUMNS), model), model)
    return scored.where((F.col("score") < toxicity.CUT) & ~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; those of which nothing is left go.

    n_chars follows the text where lines went. Null and empty texts stay as they are.
    """
    kept = lines.drop_lines(docs.select(*COLUMNS))
    left = kept.where("removed is null or rlike(text, '[^\\\\s]')")
    changed = F.when(F.col("removed").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, then row key. Rows repeat no
    more; a null text and an empty one of the same id are different rows, and both stay."""
    copies = jaccard.copies(docs).select(F.col("doc").alias("__doc"), F.col("rid").alias("__rid"))
    rows = docs.select(*COLUMNS, substrings.doc_key(F.col("doc_id")).alias("__doc"), substrings.row_key(F.col("text")).alias("__rid"), F.col("text").isNull().alias("__null"))
    return rows.join(copies, ["__doc", "__rid"], "left_anti").dropDuplicates(["__doc", "__rid", "__null"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs; null and empty texts have none, an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; ids as little-endian uint32."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Classifier, SimHash, MinHash and tokenizer can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
