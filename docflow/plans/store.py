"""Queries of the record store over snapshots made of orders, documents of customers, candidates of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from ..sources import table
from .registry import query

#: JSON of a record in both dialects: a text where the array of jobs should be for one market segment.
_JOBS = """'[{"company":"' || c_name || '","designation":"' || c_mktsegment || '","location":" ","current":' || CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END || ',"technologies":["sql"," "]},{"company":"Acme 100% Co","designation":null}]'"""
_DATA = f"""'{{"personal":{{"name":"' || c_name || '","location":"' || n_name || '"}},"skills":["SQL","spark ' || c_mktsegment || '"],"experience":' || CASE WHEN c_mktsegment = 'BUILDING' THEN '"none"' ELSE {_JOBS} END || '}}'"""
_COLUMNS = f"""o_orderkey AS resume_id, o_custkey AS document_id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN c_nationkey END AS candidate_id,
 CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PARTIAL' ELSE 'FAILED' END AS parse_status, o_orderpriority AS parse_config_hash, o_orderdate AS created_at, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at, {_DATA} AS resume_data"""
SNAPSHOTS = f"(SELECT {_COLUMNS}, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
VISIBLE = f"(SELECT s.* FROM {SNAPSHOTS} s JOIN customer d ON s.document_id = d.c_custkey LEFT JOIN nation p ON s.candidate_id = p.n_nationkey WHERE s.deleted_at IS NULL AND d.c_acctbal >= -500 AND (s.candidate_id IS NULL OR p.n_regionkey <> 0))"


def _snapshots(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = joined.selectExpr(*[x.strip() for x in _split(_COLUMNS)], "c_mktsegment")
    return rows.withColumn("skills", F.array(F.lit("SQL"), F.concat(F.lit("spark "), F.col("c_mktsegment")))).withColumn("is_latest", F.lit(True))


def _split(columns: str) -> list[str]:
    """The select list at its top-level commas."""
    out, depth, quoted, begin = [], 0, False, 0
    for i, ch in enumerate(columns):
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                out.append(columns[begin:i])
                begin = i + 1
    return [*out, columns[begin:]]


def _documents(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") < -500, F.current_timestamp()).alias("deleted_at"))


def _candidates(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("candidate_id"), F.when(F.col("n_regionkey") == 0, F.current_timestamp()).alias("deleted_at"))


def _visible(spark, d):
    return S.opened(S.visible(_snapshots(spark, d), _documents(spark, d), _candidates(spark, d)))


@query(f"SELECT resume_id, document_id, candidate_id FROM {VISIBLE}")
def visible_snapshots(spark, d):
    return S.visible(_snapshots(spark, d), _documents(spark, d), _candidates(spark, d)).select("resume_id", "document_id", "candidate_id")


_JSON_LIKE = "c_mktsegment <> 'BUILDING' AND len(list_filter(CAST(json_extract(resume_data, '$.experience') AS JSON[]), lambda e: json_extract_string(e, '$.company') ILIKE '{}')) > 0"


@query(f"SELECT resume_id FROM {VISIBLE} WHERE json_extract_string(resume_data, '$.personal.location') ILIKE '%n_1%' AND {_JSON_LIKE.format('%100% c%')}".replace("CAST(json_extract(resume_data, '$.experience') AS JSON[])", "CAST(CASE WHEN json_type(resume_data, '$.experience') = 'ARRAY' THEN json_extract(resume_data, '$.experience') ELSE '[]' END AS JSON[])"))
def search_nested(spark, d):
    return S.search(_visible(spark, d), location="n_1", company="100% c").select("resume_id")


@query(f"SELECT resume_id FROM {VISIBLE} WHERE parse_status = 'PARTIAL' AND created_at >= TIMESTAMP '1995-01-01' AND c_mktsegment ILIKE 'b%' AND c_mktsegment IS NOT NULL")
def search_skills(spark, d):
    return S.search(_visible(spark, d), status="PARTIAL", after=F.lit("1995-01-01").cast("timestamp"), skills=" sql, spark b%,,sql ").select("resume_id")


@query(f"SELECT resume_id FROM {VISIBLE} WHERE candidate_id = 7 AND json_extract_string(resume_data, '$.personal.name') ILIKE '%1%'")
def list_of_candidate(spark, d):
    return S.search(_visible(spark, d), candidate="7", name="1").select("resume_id")


@query(f"SELECT resume_id, created_at FROM {VISIBLE} ORDER BY created_at DESC, resume_id DESC LIMIT 20 OFFSET 40")
def list_page(spark, d):
    return S.listing(_visible(spark, d), 20, 40)[0].select("resume_id", "created_at")


@query(f"SELECT count(*) AS total, count(*) > 60 AS has_more FROM {VISIBLE} WHERE json_extract_string(resume_data, '$.personal.name') ILIKE '%customer%1%'")
def list_total(spark, d):
    return S.listing(S.search(_visible(spark, d), text="customer%1"), 20, 40)[1]


@query(f"SELECT resume_id, parse_status, n_items FROM {VISIBLE} LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON resume_id = l_orderkey WHERE resume_id = (SELECT min(resume_id) FROM {VISIBLE})")
def get_with_provenance(spark, d):
    rows = _visible(spark, d)
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("resume_id")).agg(F.count(F.lit(1)).alias("n_items"))
    first = rows.agg(F.min("resume_id").alias("resume_id"))
    return S.get(rows.join(F.broadcast(first), "resume_id"), F.col("resume_id"), lines).select("resume_id", "parse_status", "n_items")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_keys FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer)")
def insert_replays(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    after = S.insert(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", "c_name"), c.union(c), "c_custkey")
    return after.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("n_keys"))


@query("SELECT event_id, c_custkey IS NOT NULL AS replayed FROM events LEFT JOIN customer ON user_id = c_custkey")
def idempotent_responses(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("response"))
    return S.responses(table(spark, d, "events").select("event_id", "user_id"), stored, "user_id").select("event_id", "replayed")


@query(f"SELECT c_custkey || '/' || k AS request_id, r.resume_id FROM (SELECT c_custkey, unnest(['1-URGENT', '5-LOW', '2-HIGH']) AS k FROM customer) q LEFT JOIN (SELECT document_id, parse_config_hash, arg_max(resume_id, (created_at, resume_id)) AS resume_id FROM {SNAPSHOTS} WHERE parse_status IN ('SUCCESS', 'PARTIAL') AND deleted_at IS NULL GROUP BY ALL) r ON document_id = c_custkey AND parse_config_hash = k")
def reuse_cache(spark, d):
    keys = F.explode(F.array(*map(F.lit, ("1-URGENT", "5-LOW", "2-HIGH"))))
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), keys.alias("parse_config_hash")).withColumn("request_id", F.concat_ws("/", "document_id", "parse_config_hash"))
    return S.reusable(_snapshots(spark, d), requests)


@query(f"SELECT resume_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, resume_id DESC) = 1 AS is_latest FROM {SNAPSHOTS}")
def demoted_snapshots(spark, d):
    return S.demoted(_snapshots(spark, d)).select("resume_id", "is_latest")


_LONG = f"""SELECT resume_id, 'personal' AS section, 0 AS item_index, 'name' AS field, json_extract_string(resume_data, '$.personal.name') AS value FROM {VISIBLE}
 UNION ALL SELECT resume_id, 'personal', 0, 'location', json_extract_string(resume_data, '$.personal.location') FROM {VISIBLE}
 UNION ALL SELECT resume_id, 'skills', 0, 'skill', 'SQL' FROM {VISIBLE} UNION ALL SELECT resume_id, 'skills', 1, 'skill', 'spark ' || c_mktsegment FROM {VISIBLE}
 UNION ALL SELECT resume_id, 'experience', 0, 'company', json_extract_string(resume_data, '$.experience[0].company') FROM {VISIBLE} WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT resume_id, 'experience', 0, 'designation', c_mktsegment FROM {VISIBLE} WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT resume_id, 'experience', 0, 'current', upper(left(json_extract_string(resume_data, '$.experience[0].current'), 1)) || substring(json_extract_string(resume_data, '$.experience[0].current'), 2) FROM {VISIBLE} WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT resume_id, 'experience', 0, 'technology[0]', 'sql' FROM {VISIBLE} WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT resume_id, 'experience', 1, 'company', 'Acme 100% Co' FROM {VISIBLE} WHERE c_mktsegment <> 'BUILDING'"""


@query(_LONG)
def export_long_form(spark, d):
    return S.long_form(_visible(spark, d))


@query(f"SELECT resume_id, sum(CASE WHEN first THEN length(section) + 1 ELSE 0 END + length(field) + 2 + length(value)) + count(*) - 1 + count(DISTINCT section) - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, section) = 1 AS first FROM ({_LONG})) GROUP BY resume_id")
def export_report(spark, d):
    return S.report(_visible(spark, d)).select("resume_id", F.length("report").cast("long").alias("n"))
