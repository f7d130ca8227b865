"""Queries of the view operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as O
from ..sources import line_blocks, table
from .registry import LINES, query


def _lines(spark, d):
    return line_blocks(table(spark, d, "documents")).select("doc_id", "line_no", "text")


@query("SELECT o_custkey AS entry_id, any_value(c_mktsegment) AS label, list(o_orderpriority ORDER BY o_orderkey) AS texts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def entry_views(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    entries = o.groupBy(F.col("o_custkey").alias("entry_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids")).withColumn("section_id", F.col("entry_id"))
    sections = c.select(F.col("c_custkey").alias("section_id"), F.col("c_mktsegment").alias("label"))
    return O.entry_view(entries, sections, o.select(F.col("o_orderkey").alias("block_id"), F.col("o_orderpriority").alias("text")))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' ELSE 'body' END AS role FROM documents LEFT JOIN labels USING (doc_id)")
def document_roles(spark, d):
    roles = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("role"))
    return O.with_roles(table(spark, d, "documents").select("doc_id"), roles, ["doc_id"], "body")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(quality, {O.LAST}), coalesce(-n_chars, 0), doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def total_order(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return O.numbered(rows, ["lang"], [(F.col("quality"), O.LAST), (-F.col("n_chars"), 0)], "doc_id").select("doc_id", "place")


@query("SELECT user_id, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END, -event_id)) AS event_id FROM events GROUP BY user_id")
def best_event(spark, d):
    score = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return O.best_first_seen(table(spark, d, "events"), ["user_id"], score, "event_id", "event_id")


@query("SELECT n_regionkey, n_name, rank FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_name) AS rank FROM (SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL)) WHERE rank <= 2")
def top_nations(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    counted = n.join(c, n.n_nationkey == c.c_nationkey).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return O.top_ranked(counted, ["n_regionkey"], "n", "n_name", 2).select("n_regionkey", "n_name", "rank")


@query("SELECT 'toxic' AS kind, doc_id, toxic, NULL::INT AS quality FROM labels WHERE toxic = 1 UNION ALL SELECT 'bad', doc_id, NULL, quality FROM labels WHERE quality = 0")
def union_of_differences(spark, d):
    labels = table(spark, d, "labels")
    return O.all_differences({"toxic": labels.where("toxic = 1").select("doc_id", "toxic"), "bad": labels.where("quality = 0").select("doc_id", "quality")})


@query(f"SELECT doc_id, line_no, CASE WHEN n = 0 THEN 'PREAMBLE' ELSE n::VARCHAR END AS part FROM (SELECT doc_id, line_no, sum(CASE WHEN length(text) < 120 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no // 10 ORDER BY line_no)::BIGINT AS n FROM {LINES})")
def preamble_parts(spark, d):
    lines = _lines(spark, d).withColumn("section", F.floor(F.col("line_no") / 10))
    return O.preamble_split(lines, F.length("text") < 120).select("doc_id", "line_no", "part")


@query(f"SELECT doc_id, line_no, length(text) < 120 AND coalesce(bool_or(length(text) > 300) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS is_heading FROM {LINES}")
def item_headings(spark, d):
    n = F.length("text")
    return O.item_headings(_lines(spark, d), n < 120, n > 300).select("doc_id", "line_no", "is_heading")


@query("SELECT lower(trim(w)) AS alias, min(lang) AS canonical FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE trim(w) <> '' GROUP BY 1")
def vocabulary_of_words(spark, d):
    pairs = table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("w"))
    return O.vocabulary(pairs, "w", "lang")
