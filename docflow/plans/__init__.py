"""Registered queries over the driver's tables, each beside its SQL.

`@query(sql)` registers a function (spark, folder) -> DataFrame under its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .. import functions as X
from .. import operators as O
from ..sources import line_blocks, page_tags, table, upload_guard
from .registry import LINES, QUERIES, SQL, query



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


JOINED = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"
ALIASES = {"the": "article_en", "and": "and", "with": "with", "der": "article_de", "die": "article_de", "les": "article_fr"}
LABEL = r"""CASE WHEN trim(text, ' ') = '' THEN 'UNKNOWN' WHEN regexp_matches(text, '^[^A-Za-z]*(19|20)[0-9]{2}[^A-Za-z]*$') THEN 'DATE'
 WHEN regexp_matches(text, '^[•●▪*\-–—]\s+') THEN 'BULLET' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'CONTACT'
 WHEN len(regexp_split_to_array(trim(text, ' '), '[ \t]+')) <= 3 AND NOT regexp_matches(text, '[.,;:]$') THEN 'SECTION_HEADER'
 WHEN len(regexp_split_to_array(trim(text, ' '), '[ \t]+')) <= 6 AND regexp_matches(text, '^[A-Z]') THEN 'TITLE'
 WHEN len(regexp_split_to_array(trim(text, ' '), '[ \t]+')) >= 8 THEN 'DESCRIPTION' ELSE 'UNKNOWN' END"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return line_blocks(table(spark, d, "documents"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")


# ---- sources ---------------------------------------------------------------------------------
@query(f"SELECT doc_id, line_no, 'b_p1_' || line_no AS block_id, text FROM {LINES}")
def line_blocks_scan(spark, d):
    return _lines(spark, d)


@query("SELECT page_id, pos, content FROM (SELECT page_id, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS content, unnest(range(len(regexp_extract_all(html, '<title>([^<]*)</title>', 1)))) AS pos FROM pages)")
def page_titles(spark, d):
    return page_tags(table(spark, d, "pages"), "title")


@query("SELECT page_id, CASE WHEN NOT ends_with(lower(url), '.pdf') THEN 'extension' WHEN length(html) > 5000 THEN 'too large' WHEN NOT starts_with(html, '%PDF-') THEN 'not a pdf' END AS reason FROM pages")
def upload_guard_report(spark, d):
    pages = table(spark, d, "pages").withColumn("n", F.length("html"))
    return upload_guard(pages, name="url", head="html", size="n", most=5000).select("page_id", "reason")


# ---- store -----------------------------------------------------------------------------------
_SEARCH = "o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2030-12-31' AND (n_name ILIKE '%n_1%' OR n_name IS NULL)"


def _searched(spark, d):
    return O.filtered(_orders(spark, d), F.col("o_orderstatus") == "O", F.col("o_orderdate").between(F.lit("2000-01-01").cast("timestamp"), F.lit("2030-12-31").cast("timestamp")), F.col("n_name").ilike("%n_1%") | F.col("n_name").isNull(), None)


@query(f"SELECT o_orderkey, c_name, n_name, o_totalprice FROM {JOINED} WHERE {_SEARCH} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 10")
def search_page(spark, d):
    return O.page(_searched(spark, d), [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 10).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query(f"SELECT count(*) AS total, count(*) > 30 AS has_more FROM {JOINED} WHERE {_SEARCH}")
def search_total(spark, d):
    return _searched(spark, d).agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > 30)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) ON c_custkey = o_custkey GROUP BY c_custkey")
def search_optional_side(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("spent"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def json_path_filter(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k = 7")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda s: s ILIKE '%ation%')) > 0")
def any_element_filter(spark, d):
    return table(spark, d, "documents").where(X.any_like(F.split("text", " "), "ation")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split(text, ' '), lambda s: lower(s)), 'the') AND list_contains(list_transform(string_split(text, ' '), lambda s: lower(s)), 'with')")
def all_terms_filter(spark, d):
    wanted = X.terms(F.lit(" The , with,the,, with"))
    return table(spark, d, "documents").where(X.has_all(F.split("text", " "), wanted)).select("doc_id")


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return O.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events")
def latest_flag(spark, d):
    return O.with_is_latest(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "is_latest")


@query("SELECT user_id, k, event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('click', 'view', 'purchase')) WHERE rn = 1")
def reusable_latest(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint") % 10)
    return O.latest(e.select("user_id", "k", "event_id", "ts"), ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id")


@query("SELECT 'doc_' || left(sha256(text), 24) AS content_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedupe(spark, d):
    docs = table(spark, d, "documents").select(X.content_id(F.col("text")).alias("content_id"), "doc_id")
    return docs.groupBy("content_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("SELECT count(*) AS n_new FROM (SELECT DISTINCT text FROM documents WHERE source IN ('src1', 'src2')) a WHERE text NOT IN (SELECT text FROM documents WHERE source NOT IN ('src1', 'src2'))")
def idempotent_insert(spark, d):
    docs = table(spark, d, "documents").withColumn("id", X.content_id(F.col("text")))
    new = O.new_content(docs.where(F.col("source").isin("src1", "src2")), docs.where(~F.col("source").isin("src1", "src2")), ["id"])
    return new.agg(F.count(F.lit(1)).alias("n_new"))


@query("SELECT c_custkey, sha256(lower(trim(c_name)) || '|' || lower(trim(c_mktsegment)) || '|v1') AS hash FROM customer")
def config_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.config_hash(F.col("c_name"), F.upper("c_mktsegment"), F.lit(" V1 ")).alias("hash"))


# ---- evaluation ------------------------------------------------------------------------------
@query("SELECT lang, coalesce(sum(CASE WHEN toxic = 0 THEN 1 END), 0)::BIGINT AS n_clean, coalesce(sum(CASE WHEN toxic = 1 THEN 1 END), 0)::BIGINT AS n_toxic FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS lang) l LEFT JOIN (SELECT lang AS g, toxic FROM documents JOIN labels USING (doc_id)) ON lang = g GROUP BY lang")
def status_crosstab(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("toxic") == 0).alias("n_clean"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    domain = spark.sql("SELECT explode(array('de', 'en', 'es', 'fr', 'xx')) AS lang")
    return domain.join(rows, "lang", "left").na.fill(0)


@query("SELECT lang, source, quality, count(*) AS n, CAST(4 * grouping(lang) + 2 * grouping(source) + grouping(quality) AS BIGINT) AS level FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (source, quality), (quality))")
def multi_dim_rollup(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    lang, source, quality = (F.col(c) for c in ("lang", "source", "quality"))
    level = 4 * F.grouping("lang").cast("bigint") + 2 * F.grouping("source") + F.grouping("quality")
    return rows.groupingSets([[lang, quality], [source, quality], [quality]], lang, source, quality).agg(F.count(F.lit(1)).alias("n"), level.cast("bigint").alias("level"))


@query("SELECT a.conv_id, list_sort(list_distinct(list_filter(a.w, lambda x: NOT list_contains(b.w, x)))) AS reduced, list_sort(list_distinct(list_filter(b.w, lambda x: NOT list_contains(a.w, x)))) AS introduced FROM (SELECT conv_id, string_split(text, ' ') AS w FROM conversations WHERE turn = 0) a JOIN (SELECT conv_id, string_split(text, ' ') AS w FROM conversations WHERE turn = 1) b USING (conv_id)")
def anomaly_set_diff(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    a, b = c.where("turn = 0").select("conv_id", F.col("w").alias("a")), c.where("turn = 1").select("conv_id", F.col("w").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.array_sort(F.array_except("a", "b")).alias("reduced"), F.array_sort(F.array_except("b", "a")).alias("introduced"))


@query("SELECT source, median(abs(n_chars - med)) AS mad FROM (SELECT source, n_chars, median(n_chars) OVER (PARTITION BY source) AS med FROM documents) GROUP BY source")
def median_deviation(spark, d):
    docs = table(spark, d, "documents").select("source", "n_chars")
    med = docs.groupBy("source").agg(F.median("n_chars").alias("med"))
    return docs.join(med, "source").groupBy("source").agg(F.median(F.abs(F.col("n_chars") - F.col("med"))).alias("mad"))


@query("SELECT lang, list_filter([CASE WHEN good < 0.9 THEN 'good >= 0.9' END, CASE WHEN toxic > 0.1 THEN 'toxic <= 0.1' END, CASE WHEN n < 50 THEN 'n >= 50' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT lang, avg(quality) AS good, avg(toxic) AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def gate_report(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("good"), F.avg("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    return rows.select("lang", O.gate({"good": F.col("good"), "toxic": F.col("bad"), "n": F.col("n")}, {"good": (">=", 0.9), "toxic": ("<=", 0.1), "n": (">=", 50)}).alias("reasons"))


@query("SELECT round(avg(covered), 4) AS mean, min(covered) AS least, max(covered) AS most FROM (SELECT source, count(l.doc_id) * 1.0 / count(*) AS covered FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source)")
def coverage_totals(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("hit", F.lit(1)), "doc_id", "left")
    each = docs.groupBy("source").agg((F.count("hit") / F.count(F.lit(1))).alias("covered"))
    return each.agg(F.round(F.avg("covered"), 4).alias("mean"), F.min("covered").alias("least"), F.max("covered").alias("most"))


@query("SELECT a.conv_id, round(len(list_filter(list_distinct(a.w), lambda x: list_contains(b.w, x))) * 1.0 / len(list_distinct(a.w)), 6) AS recall FROM (SELECT conv_id, string_split(lower(text), ' ') AS w FROM conversations WHERE turn = 0) a JOIN (SELECT conv_id, string_split(lower(text), ' ') AS w FROM conversations WHERE turn = 1) b USING (conv_id)")
def term_recall(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    a, b = c.where("turn = 0").select("conv_id", F.col("w").alias("a")), c.where("turn = 1").select("conv_id", F.col("w").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_distinct("a")), 6).alias("recall"))


# ---- text ------------------------------------------------------------------------------------
@query(r"SELECT doc_id, min_by(email, line_no) AS email FROM (SELECT doc_id, line_no, nullif(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '') AS email FROM " + LINES + ") GROUP BY doc_id")
def first_contact(spark, d):
    email = X.first_match(F.col("text"), X.EMAIL)
    rows = _lines(spark, d).select("doc_id", "line_no", email.alias("email"))
    found = rows.groupBy("doc_id").agg(F.min_by("email", F.when(F.col("email").isNotNull(), F.col("line_no"))).alias("email"))
    return found


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS folded FROM documents")
def alnum_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.alnum_fold(F.col("text"))).alias("folded"))


@query()
def alias_match(spark, d):
    """All documents; DuckDB's word boundary is ASCII, so the tests hold a brute-force version."""
    return table(spark, d, "documents").select("doc_id", F.array_sort(X.alias_matches(F.col("text"), ALIASES)).alias("found"))


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '', 'g') AS name, CASE WHEN length(html) > 40 THEN left(html, 40) || '...' ELSE html END AS head FROM pages")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"), X.shortened(F.col("html"), 40).alias("head"))


@query("SELECT doc_id, (CASE WHEN text ILIKE '% the %' THEN 1 ELSE 0 END + CASE WHEN text ILIKE '% and %' THEN 1 ELSE 0 END + CASE WHEN text ILIKE '% with %' THEN 1 ELSE 0 END)::INTEGER AS signals, CASE WHEN text ILIKE '% the %' AND text ILIKE '% and %' AND text ILIKE '% with %' THEN 'sure' WHEN text ILIKE '% the %' OR text ILIKE '% and %' OR text ILIKE '% with %' THEN 'likely' ELSE 'no' END AS archetype FROM documents")
def signal_archetype(spark, d):
    n = sum((F.col("text").ilike(f"% {w} %").cast("int") for w in ("the", "and", "with")), F.lit(0))
    docs = table(spark, d, "documents").select("doc_id", n.alias("signals"))
    return docs.withColumn("archetype", F.when(F.col("signals") >= 3, "sure").when(F.col("signals") >= 1, "likely").otherwise("no"))


# ---- sequences -------------------------------------------------------------------------------
@query(f"SELECT doc_id, line_no, last_value(CASE WHEN label = 'SECTION_HEADER' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM (SELECT *, {LABEL} AS label FROM {LINES})")
def section_carry_forward(spark, d):
    header = F.when(X.block_label(F.col("text")) == "SECTION_HEADER", F.col("text"))
    return _lines(spark, d).select("doc_id", "line_no", O.carried(["doc_id"], "line_no", header).alias("section"))


@query("SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS flag FROM events)) GROUP BY user_id, run")
def run_islands(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    starts = F.lag("event_type").over(W.partitionBy("user_id").orderBy("at")) != F.col("event_type")
    return O.islands(e, ["user_id"], "at", starts, "run").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, cluster, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN epoch(ts) - epoch(prev) > 36000 THEN 1 WHEN prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS cluster FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, cluster")
def gap_clusters(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    wide = O.gap(["user_id"], "at", F.col("ts").cast("timestamp").cast("double")) > 36000
    return O.islands(e, ["user_id"], "at", wide, "cluster").groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_links(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("prev"), F.lead("role").over(w).alias("next"))


@query(f"SELECT doc_id, line_no, list(label) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM (SELECT *, {LABEL} AS label FROM {LINES})".replace("list(label) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", "coalesce(list(label) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), [])"))
def lookahead_context(spark, d):
    rows = _lines(spark, d).select("doc_id", "line_no", X.block_label(F.col("text")).alias("label"))
    return rows.select("doc_id", "line_no", O.ahead(["doc_id"], "line_no", F.col("label"), 3).alias("ahead"))


@query(f"SELECT doc_id, line_no, last_value(CASE WHEN label = 'TITLE' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM (SELECT *, {LABEL} AS label FROM {LINES})")
def nearest_heading_above(spark, d):
    rows = _lines(spark, d).withColumn("label", X.block_label(F.col("text")))
    return O.last_before(rows, ["doc_id"], "line_no", F.col("label") == "TITLE", F.col("line_no")).select("doc_id", "line_no", "anchor")


def _boxes(spark, d):
    """Synthetic geometry: lineitem as blocks, order as document."""
    x0 = (F.col("l_partkey") % 500).cast("double")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("b"), F.col("l_linenumber"), F.lit("_"), F.col("l_partkey"), F.lit("_"), F.col("l_suppkey")).alias("block_id"), x0.alias("x0"), (x0 + 40).alias("x1"), (F.col("l_suppkey") % 5).cast("double").alias("y0"), F.col("l_returnflag").alias("text"), F.lit(10.0).alias("font_size")).distinct()


BOXES = "(SELECT DISTINCT l_orderkey AS doc_id, 'b' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS block_id, (l_partkey % 500)::DOUBLE AS x0, (l_partkey % 500 + 40)::DOUBLE AS x1, (l_suppkey % 5)::DOUBLE AS y0 FROM lineitem)"


@query(f"WITH b AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id ORDER BY x0, block_id) - x0 AS gap, max(x1) OVER (PARTITION BY doc_id) - min(x0) OVER (PARTITION BY doc_id) AS width FROM {BOXES}), c AS (SELECT doc_id, max(width) AS width, max(gap) AS gap, arg_max(x0, (coalesce(gap, -1), -x0)) AS cut FROM b GROUP BY doc_id) SELECT b.doc_id, block_id, CASE WHEN c.gap >= greatest(60, 0.18 * c.width) AND x0 > cut THEN 2 ELSE 1 END AS \"column\", row_number() OVER (PARTITION BY b.doc_id ORDER BY CASE WHEN c.gap >= greatest(60, 0.18 * c.width) AND x0 > cut THEN 2 ELSE 1 END, y0, x0, block_id) AS position FROM b JOIN c ON b.doc_id = c.doc_id".replace("arg_max(x0, (coalesce(gap, -1), -x0))", "max(CASE WHEN gap IS NOT NULL THEN x0 END)").replace("max(CASE WHEN gap IS NOT NULL THEN x0 END) AS cut FROM b GROUP BY doc_id", "min(CASE WHEN gap = top THEN x0 END) AS cut FROM (SELECT *, max(gap) OVER (PARTITION BY doc_id) AS top FROM b) GROUP BY doc_id"))
def x_gap_columns(spark, d):
    return O.reading_order(_boxes(spark, d)).select("doc_id", "block_id", "column", "position")


@query(f"SELECT a.doc_id, 1 AS page, a.block_id AS left_id, b.block_id AS right_id FROM {BOXES} a JOIN {BOXES} b ON a.doc_id = b.doc_id AND abs(a.y0 - b.y0) <= 1 AND b.x0 > a.x1")
def right_of_pairs(spark, d):
    return O.right_of(_boxes(spark, d))


@query()
def line_merge(spark, d):
    return O.merge_lines(_boxes(spark, d))


# ---- records and evidence --------------------------------------------------------------------
@query("SELECT c_custkey, section, item_index, field, value FROM (SELECT c_custkey, 'record' AS section, 0 AS item_index, unnest(['c_name', 'c_mktsegment', 'vip']) AS field, unnest([c_name, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END, CASE WHEN c_custkey % 9 = 0 THEN 'True' ELSE 'False' END]) AS value FROM customer UNION ALL SELECT c_custkey, 'parts', unnest(range(len(string_split(c_name, '#')))), 'value', unnest(string_split(c_name, '#')) FROM customer) WHERE value IS NOT NULL AND trim(value, ' ') <> ''")
def record_unpivot(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.initcap((F.col("c_custkey") % 9 == 0).cast("string")).alias("vip"), F.split("c_name", "#").alias("parts"))
    return O.unpivot_record(c, "c_custkey", ["c_name", "c_mktsegment", "vip"], "parts")


def _claims(spark, d):
    ids = F.transform(F.array(F.col("doc_id") % 4, F.lit(0), F.lit(900)), lambda i: F.concat(F.lit("b_p1_"), i))
    return table(spark, d, "documents").select(F.col("doc_id").alias("claim_id"), "doc_id", ids.alias("ids"))


CLAIMS = "(SELECT doc_id AS claim_id, doc_id, 'b_p1_' || unnest([doc_id % 4, 0, 900]) AS block_id, unnest([0, 1, 2]) AS pos FROM documents)"


@query(f"SELECT claim_id, c.doc_id, list(text ORDER BY pos) AS texts FROM {CLAIMS} c JOIN (SELECT doc_id, 'b_p1_' || line_no AS block_id, text FROM {LINES}) b ON c.doc_id = b.doc_id AND c.block_id = b.block_id GROUP BY claim_id, c.doc_id")
def evidence_join(spark, d):
    return O.evidence(_claims(spark, d), _lines(spark, d))


@query(f"SELECT c.doc_id, c.block_id, claim_id FROM {CLAIMS} c LEFT JOIN (SELECT doc_id, 'b_p1_' || line_no AS block_id FROM {LINES}) b ON c.doc_id = b.doc_id AND c.block_id = b.block_id WHERE b.block_id IS NULL")
def unknown_evidence(spark, d):
    return O.unknown_ids(_claims(spark, d), _lines(spark, d))


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS owners FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_orderkey) > 1")
def duplicate_ownership(spark, d):
    return O.duplicate_owners(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT a.conv_id, list_sort(string_split(a.text, ' ')) = list_sort(string_split(b.text, ' ')) AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 2")
def multiset_support(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    a, b = c.where("turn = 0").select("conv_id", F.col("w").alias("a")), c.where("turn = 2").select("conv_id", F.col("w").alias("b"))
    return a.join(b, "conv_id").select("conv_id", O.same_multiset(F.col("a"), F.col("b")).alias("same"))


@query("WITH c AS (SELECT a, b, count(*) AS shared FROM (SELECT DISTINCT l_suppkey AS a, l_partkey FROM lineitem) JOIN (SELECT DISTINCT l_shipdate::DATE AS b, l_partkey FROM lineitem) USING (l_partkey) GROUP BY a, b) SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rn FROM c) WHERE rn = 1".replace("l_shipdate::DATE AS b", "l_orderkey % 50 AS b"))
def best_overlap_match(spark, d):
    li = table(spark, d, "lineitem")
    return O.best_overlap(li.select(F.col("l_suppkey").alias("a"), "l_partkey"), li.select((F.col("l_orderkey") % 50).alias("b"), "l_partkey"), "l_partkey", "a", "b")


# ---- streaming -------------------------------------------------------------------------------
EVENTS = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id, event_type")
def stream_latest(spark, d):
    from ..streaming import file_stream, run_to_end

    stream = file_stream(spark, f"{d}/events.parquet", EVENTS)
    agg = stream.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    return run_to_end(agg, "complete", _folder(spark))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL GROUP BY event_type")
def stream_requests(spark, d):
    from ..streaming import file_stream, run_to_end, split_requests

    stream = file_stream(spark, f"{d}/events.parquet", EVENTS)
    messages = stream.select(F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").alias("k"))).alias("value"))
    good, _ = split_requests(messages, T.StructType([T.StructField("event_type", T.StringType()), T.StructField("k", T.StringType())]), ["event_type", "k"])
    return run_to_end(good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete", _folder(spark))


@query("SELECT topic, count(*) AS n FROM (SELECT CASE WHEN event_type IS NULL OR user_id IS NULL OR event_type = 'view' THEN 'dead' WHEN value < 0 OR event_type = 'refund' THEN 'failed' ELSE 'completed' END AS topic FROM events) GROUP BY topic")
def stream_events(spark, d):
    from ..streaming import dead_letters, events_of, file_stream, run_to_end, split_requests

    stream = file_stream(spark, f"{d}/events.parquet", EVENTS)
    name = F.when(F.col("event_type") != "view", F.col("event_type"))
    messages = stream.select(F.to_json(F.struct(name.alias("event_type"), F.col("user_id").cast("string").alias("user"), "value")).alias("value"))
    good, bad = split_requests(messages, T.StructType([T.StructField("event_type", T.StringType()), T.StructField("user", T.StringType()), T.StructField("value", T.DoubleType())]), ["event_type", "user"])
    error = F.when((F.col("value") < 0) | (F.col("event_type") == "refund"), F.lit("no parse"))
    events = events_of(good, F.struct("user", error.alias("error")), "completed", "failed").union(dead_letters(bad, "dead"))
    return run_to_end(events, "append", _folder(spark)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def stream_replays(spark, d):
    from ..streaming import file_stream, once_per_key, run_to_end

    stream = file_stream(spark, f"{d}/events.parquet", EVENTS)
    once = once_per_key(stream.select("user_id", "ts"), ["user_id"], "ts", "3650 days")
    return run_to_end(once, "append", _folder(spark)).agg(F.count(F.lit(1)).alias("n"))


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one in local runs only."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="docflow-")


from . import evaluation, fields, grounding, layout, records, store, views  # noqa: E402, F401  the other queries register themselves
