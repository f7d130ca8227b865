"""Queries of the record operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import line_blocks, table
from .fields import SECTIONS, sql_phone, sql_range
from .registry import LINES, query


def _lines(spark, d):
    return line_blocks(table(spark, d, "documents")).select("doc_id", "line_no", "text")


@query("SELECT o_custkey, o_orderstatus, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids FROM orders GROUP BY ALL")
def ids_by_status(spark, d):
    rows = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return R.ids_by_role(rows, "o_custkey", "o_orderstatus", "o_orderkey", "at")


@query("SELECT o_custkey, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '3-MEDIUM'), '3-MEDIUM') AS o_orderpriority FROM orders GROUP BY o_custkey")
def first_known_priority(spark, d):
    return R.first_known(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "3-MEDIUM")


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_orderpriority = '1-URGENT', o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey")
def last_priority(spark, d):
    return R.last_writer(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", "1-URGENT")


@query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS words FROM conversations WHERE text <> '' GROUP BY conv_id")
def concatenated_turns(spark, d):
    passes = table(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return R.concatenated(passes, "conv_id", "words", "turn").select("conv_id", F.md5(F.array_join("words", " ")).alias("words"))


@query("SELECT o_custkey, o_orderstatus, array_to_string(list_filter(list_transform(l, lambda p, i: CASE WHEN list_position(l, p) = i THEN p END), lambda p: p IS NOT NULL), ' / ') AS o_orderpriority, ids FROM (SELECT o_custkey, o_orderstatus, list(o_orderpriority ORDER BY o_orderkey) AS l, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY ALL)")
def merged_sections(spark, d):
    rows = table(spark, d, "orders").withColumn("ids", F.array("o_orderkey"))
    return R.merged_sections(rows, "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey", "ids")


@query("SELECT lang, count(DISTINCT w) AS n, min(w) AS low, max(w) AS high FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang")
def distinct_words(spark, d):
    docs = table(spark, d, "documents").select("lang", F.split("text", " ").alias("w"))
    return R.distinct_union(docs, "lang", "w").select("lang", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("low"), F.get("w", F.size("w") - 1).alias("high"))


@query("SELECT event_id, coalesce(a.c_name, b.c_name) AS c_name FROM events LEFT JOIN customer a ON user_id * 100 = a.c_custkey LEFT JOIN (SELECT c_nationkey, min(c_name) AS c_name FROM customer GROUP BY c_nationkey) b ON user_id = b.c_nationkey")
def first_of_keys(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") * 100).alias("far"), F.col("user_id").alias("near"))
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    return R.lookup_first(e, c, [("far", "c_custkey"), ("near", "c_nationkey")], "c_name").select("event_id", "c_name")


@query(f"SELECT doc_id, line_no FROM {LINES} l WHERE line_no = 0 OR EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = l.doc_id AND l.line_no = b.quality + 1)")
def kept_lines(spark, d):
    wanted = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).cast("long").alias("block_id"))
    lines = _lines(spark, d).withColumn("block_id", F.col("line_no"))
    return R.kept_blocks(lines, wanted, header=F.col("line_no") == 0).select("doc_id", "line_no")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS en, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS de FROM documents")
def isolated_collections(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.array("source").alias("en"), F.array("source").alias("de"))
    return R.isolated(docs, F.col("lang"), ["en", "de"]).select("doc_id", F.size("en").alias("en"), F.size("de").alias("de"))


@query("SELECT o_custkey, '[' || string_agg('{' || CASE WHEN o_orderstatus <> 'O' THEN '\"o_orderstatus\":\"' || o_orderstatus || '\",' ELSE '' END || '\"o_orderkey\":' || o_orderkey || '}', ',' ORDER BY o_orderpriority, o_orderkey) || ']' AS json FROM orders GROUP BY o_custkey")
def compact_orders(spark, d):
    return R.compact_json(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderkey"], ["o_orderpriority", "o_orderkey"], {"o_orderstatus": "O"})


_BODY = f"(SELECT doc_id, text, CASE WHEN length(text) > 400 THEN 'bullet' WHEN line_no = 0 THEN 'header' END AS role, CASE WHEN length(text) % 5 = 0 THEN doc_id END AS table_id, CASE WHEN line_no < 3 THEN 'HEADER' END AS cell_role, line_no AS row_index, CASE WHEN line_no = 0 THEN 'header' END AS region_kind FROM {LINES})"


@query(f"SELECT doc_id, CASE WHEN count(*) FILTER (upper(role) = 'BULLET') >= 2 THEN 'structural_body_roles' WHEN count(*) FILTER (table_id IS NOT NULL AND (coalesce(cell_role, '') <> 'HEADER' OR row_index > 0)) >= 2 THEN 'table_data_cells' WHEN count(*) FILTER (coalesce(region_kind, '') <> 'header' AND coalesce(upper(role), '') <> 'HEADER') >= 3 AND sum(CASE WHEN coalesce(region_kind, '') <> 'header' AND coalesce(upper(role), '') <> 'HEADER' THEN length(trim(text)) ELSE 0 END) >= 80 THEN 'dense_body_text' END AS evidence FROM {_BODY} GROUP BY doc_id")
def body_evidence(spark, d):
    n = F.col("line_no")
    rows = _lines(spark, d).withColumns({"role": F.when(F.length("text") > 400, "bullet").when(n == 0, "header"), "table_id": F.when(F.length("text") % 5 == 0, F.col("doc_id")), "cell_role": F.when(n < 3, "HEADER"), "row_index": n, "region_kind": F.when(n == 0, "header")})
    return R.body_evidence(rows, "doc_id")


_CELLS = "(SELECT o_orderkey AS table_id, l_linenumber - 1 AS row_index, 0 AS column_index, lower(o_orderpriority) AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT l_orderkey, l_linenumber - 1, 1, CASE WHEN l_returnflag = 'R' THEN 'rank: ' ELSE 'flag ' END || lower(l_linestatus) FROM lineitem)"


def _cells(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row_index"), F.lit(0).alias("column_index"), F.lower("o_orderpriority").alias("text"))
    b = li.select("l_orderkey", F.col("l_linenumber") - 1, F.lit(1), F.concat(F.when(F.col("l_returnflag") == "R", "rank: ").otherwise("flag "), F.lower("l_linestatus")))
    return a.union(b)


_FORM = f"(SELECT table_id, count(*) FILTER (contains(text, ':')) >= 3 OR (count(*) >= 4 AND count(*) FILTER (contains(text, ':')) * 1.0 / count(*) >= 0.2) AS is_form, string_agg(text, ' ' ORDER BY column_index, text) FILTER (row_index = 0) AS first_row, string_agg(text, ' ' ORDER BY row_index, column_index, text) AS cells FROM {_CELLS} GROUP BY table_id)"


@query(f"SELECT table_id, is_form FROM {_FORM}")
def form_tables(spark, d):
    return R.form_tables(_cells(spark, d))


_PURPOSES = {"service": {"strong": ["rank", "vessel"], "medium": ["flag"], "context": ["urgent"]}, "study": {"strong": ["high"], "medium": ["low"], "context": ["medium"]}}


def _points(own: dict) -> str:
    parts = ["0.0"]
    for kind, row, cell in (("strong", 4.0, 1.0), ("medium", 2.5, 0.5)):
        for p in own[kind]:
            parts.append(f"CASE WHEN regexp_matches(first_row, '{p}') THEN {row} WHEN regexp_matches(cells, '{p}') THEN {cell} ELSE 0 END")
    parts += [f"CASE WHEN regexp_matches(first_row, '{p}') OR (is_form AND regexp_matches(cells, '{p}')) THEN 0.5 ELSE 0 END" for p in own["context"]]
    return "(" + " + ".join(parts) + ")"


@query(f"SELECT table_id, CASE WHEN greatest(a, b) < 2 THEN 'unknown' WHEN a >= b THEN 'service' ELSE 'study' END AS purpose, CASE WHEN greatest(a, b) < 2 THEN 0 ELSE least(1, greatest(a, b) / 10) END::DOUBLE AS confidence FROM (SELECT table_id, {_points(_PURPOSES['service'])} AS a, {_points(_PURPOSES['study'])} AS b FROM (SELECT table_id, is_form, coalesce(first_row, '') AS first_row, cells FROM {_FORM}))")
def table_purposes(spark, d):
    cells = _cells(spark, d)
    text = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("row_index", "column_index", "text")))), lambda x: x["text"]), " ")
    tables = cells.groupBy("table_id").agg(text(F.col("row_index") == 0).alias("first_row"), text(F.lit(True)).alias("cells")).join(R.form_tables(cells), "table_id").withColumn("heading", F.lit(""))
    return R.table_purpose(tables, _PURPOSES).select("table_id", "purpose", "confidence")


@query(f"SELECT table_id, column_index, CASE WHEN regexp_matches(h, 'rank') THEN 'rank' WHEN regexp_matches(h, 'flag') THEN 'flag' WHEN regexp_matches(h, '[12]-') THEN 'early' ELSE 'unknown' END AS role FROM (SELECT table_id, column_index, string_agg(text, ' ') AS h FROM {_CELLS} WHERE row_index = 0 GROUP BY table_id, column_index)")
def column_roles(spark, d):
    cells = _cells(spark, d).withColumn("cell_role", F.lit(None).cast("string"))
    return R.column_roles(cells, [("rank", "rank"), ("flag", "flag"), ("[12]-", "early")])


_R0 = sql_range("text")[0]


@query(f"""WITH p AS (SELECT doc_id, line_no, len(regexp_split_to_array(trim(text), '\\s+')) AS w, length(text) < 60 AS o, len(regexp_split_to_array(trim(text), '\\s+')) >= 8 AND NOT regexp_matches(text, '^\\s*(?:[\\x{{2022}}\\x{{2023}}\\x{{25E6}}\\-*\\x{{00B7}}]|\\d+\\.)\\s+') AND ({_R0}) IS NULL AND length(text) >= 60 AS prose FROM {LINES}),
 q AS (SELECT *, sum(CASE WHEN prose THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS broken FROM p)
 SELECT doc_id, n FROM (SELECT doc_id, count(*) FILTER (broken = 0) AS n, sum(CASE WHEN broken = 0 THEN w ELSE 0 END) AS words, arg_min(o, line_no) FILTER (broken > 0) AS opened FROM q GROUP BY doc_id) WHERE n >= 3 AND words >= 30 AND opened""")
def leading_summaries(spark, d):
    return R.leading_summary(_lines(spark, d), F.length("text") < 60)


_V = "(SELECT l_suppkey AS doc_id, l_linenumber AS page, l_quantity * 10 AS x0, floor(l_discount * 100) * 8 AS y0, floor(l_discount * 100) * 8 + 50 AS y1 FROM lineitem)"
_H = "(SELECT l_suppkey AS doc_id, l_linenumber AS page, 0.0 AS x0, l_quantity * 20 AS x1, floor(l_tax * 100) * 8 + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END AS y0 FROM lineitem)"


@query(f"SELECT DISTINCT a.doc_id, a.page, a.x0, b.x0 AS x1, a.y0, a.y1 FROM {_V} a JOIN {_V} b ON a.doc_id = b.doc_id AND a.page = b.page AND b.x0 - a.x0 > 80 AND a.y0 = b.y0 WHERE EXISTS (SELECT 1 FROM {_H} h WHERE h.doc_id = a.doc_id AND h.page = a.page AND abs(h.y0 - a.y0) <= 4 AND h.x0 <= a.x0 + 4 AND h.x1 >= b.x0 - 4) AND EXISTS (SELECT 1 FROM {_H} h WHERE h.doc_id = a.doc_id AND h.page = a.page AND abs(h.y0 - a.y1) <= 4 AND h.x0 <= a.x0 + 4 AND h.x1 >= b.x0 - 4)")
def ruled_boxes(spark, d):
    li = table(spark, d, "lineitem").withColumns({"doc_id": F.col("l_suppkey"), "page": F.col("l_linenumber")})
    top = F.floor(F.col("l_discount") * 100) * 8
    v = li.select("doc_id", "page", (F.col("l_quantity") * 10).alias("x0"), top.cast("double").alias("y0"), (top + 50).cast("double").alias("y1"))
    h = li.select("doc_id", "page", F.lit(0.0).alias("x0"), (F.col("l_quantity") * 20).alias("x1"), (F.floor(F.col("l_tax") * 100) * 8 + F.when(F.col("l_returnflag") == "R", 50).otherwise(0)).cast("double").alias("y0"))
    return R.rule_boxes(v, h)


@query(f"""WITH l AS (SELECT doc_id, line_no, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM {LINES}), c AS (SELECT doc_id, lower(regexp_extract(text, '([a-zA-Z]+)[^a-zA-Z]*$', 1)) AS value FROM documents),
 r AS (SELECT a.doc_id, a.line_no, b.i - a.i + 1 AS n, (SELECT string_agg(x.text, ' ' ORDER BY x.i) FROM l x WHERE x.doc_id = a.doc_id AND x.i BETWEEN a.i AND b.i) AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 3)
 SELECT doc_id AS claim_id, arg_min(line_no, (n, line_no)) AS "first", min(n) AS n FROM r JOIN c USING (doc_id) WHERE contains(lower(t), value) GROUP BY doc_id""")
def covering_slices(spark, d):
    claims = table(spark, d, "documents").select(F.col("doc_id").alias("claim_id"), "doc_id", F.lower(F.regexp_extract("text", r"([a-zA-Z]+)[^a-zA-Z]*$", 1)).alias("value"))
    return R.covering_slice(claims, _lines(spark, d))


_J = "c_name || ' , ' || c_mktsegment || ',Land / Mar 2020 - ' || CASE WHEN c_acctbal < 0 THEN 'Present' ELSE '2021' END"


@query("SELECT c_custkey, c_name AS company, c_mktsegment || ', Land' AS location, '2020-03' AS \"start\", CASE WHEN c_acctbal >= 0 THEN '2021' END AS stop, c_mktsegment AS title, c_name || ', x' AS bare, c_mktsegment || ', fine. ' || c_name AS told, 'AB-' || c_custkey AS id, '2020-05' AS issued FROM customer")
def parsed_lines(spark, d):
    c = table(spark, d, "customer")
    job = R.company_line(F.expr(_J))
    title = R.title_line(F.concat("c_mktsegment", F.lit(" - 03/2020 to Present")))
    told = R.description(F.array(F.concat(F.lit("• "), "c_mktsegment", F.lit(" ,")), F.lit(" - "), F.lit("fine ."), F.col("c_name")))
    cert = R.certificate(F.concat(F.lit("Issued: May 2020, credential ID AB-"), F.col("c_custkey").cast("string")))
    rows = c.withColumns({"j": job, "t": title, "k": cert})
    return rows.select("c_custkey", "j.company", "j.location", "j.start", F.col("j.end").alias("stop"), "t.title", R.without_label(F.concat(F.lit("Company: "), "c_name", F.lit(" ,x ;"))).alias("bare"), told.alias("told"), "k.id", "k.issued")


_MAIL = "nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 0), '')"


@query(f"SELECT doc_id, email, CASE WHEN email IS NULL THEN 0 ELSE 0.99 END::DOUBLE AS sure, phone, coalesce(CASE WHEN lang = 'en' THEN lang END, email) AS filled FROM (SELECT doc_id, arg_min({_MAIL}, line_no) FILTER ({_MAIL} IS NOT NULL) AS email, arg_min({sql_phone('text')}, line_no) FILTER ({sql_phone('text')} IS NOT NULL) AS phone FROM {LINES} GROUP BY doc_id) JOIN documents USING (doc_id)")
def contact_records(spark, d):
    found = R.contact_records(_lines(spark, d))
    records = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).alias("email"))
    filled = R.supplemented(records, found).select("doc_id", F.col("email").alias("filled"))
    return found.join(filled, "doc_id").select("doc_id", "email.value", "email.confidence", F.col("phone.value").alias("phone"), "filled").toDF("doc_id", "email", "sure", "phone", "filled")


@query("SELECT doc_id, section, min(entry) AS \"first\", count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY section, u) AS unit FROM (SELECT o_custkey AS doc_id, o_orderstatus AS section, o_orderkey AS entry, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1) // 3 AS u FROM orders) GROUP BY doc_id, section, u")
def planned_passes(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("entry"))
    return R.planned_passes(rows)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS leader FROM events")
def single_flights(spark, d):
    return R.single_flight(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "leader")


@query(f"SELECT doc_id, CASE WHEN n_sections > 0 THEN 'sectioned' ELSE 'plain' END AS kind FROM (SELECT doc_id, count(*) FILTER (lower(trim(text)) IN ({', '.join(repr(a.lower()) for own in SECTIONS.values() for a in own)})) AS n_sections FROM {LINES} GROUP BY doc_id)")
def sectioned_documents(spark, d):
    names = [a.lower() for own in SECTIONS.values() for a in own]
    counted = _lines(spark, d).groupBy("doc_id").agg(F.count_if(F.lower(F.trim("text")).isin(*names)).alias("n"))
    return counted.select("doc_id", F.when(F.col("n") > 0, "sectioned").otherwise("plain").alias("kind"))
