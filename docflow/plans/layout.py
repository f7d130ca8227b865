"""Queries of the layout operators; blocks are the lines of documents, placed by their number and length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources import line_blocks, table
from .registry import LINES, query

BLOCKS = f"(SELECT doc_id, page, block_id, x0, y0, x0 + 30 + length(text) / 10 AS x1, y0 + 9 AS y1, text, line_no FROM (SELECT doc_id, line_no, text, 1 + line_no // 12 AS page, line_no AS block_id, (length(text) % 7) * 55.0::DOUBLE AS x0, (line_no // 2) * 11.0::DOUBLE + length(text) % 3 AS y0 FROM {LINES}))"
HEADINGS = f"(SELECT doc_id, page, block_id AS heading_id, x0, x1, y1 FROM {BLOCKS} WHERE length(text) < 90)"
SECTIONS = f"(SELECT doc_id, page, min(block_id) AS section_id, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1 FROM {BLOCKS} GROUP BY doc_id, page, CAST(floor(x0 / 200) AS INT))"


def _blocks(spark, d):
    n, line = F.length("text"), F.col("line_no")
    rows = line_blocks(table(spark, d, "documents")).select("doc_id", "line_no", "text")
    rows = rows.withColumns({"page": F.floor(line / 12) + 1, "block_id": line, "x0": (n % 7) * F.lit(55.0), "y0": F.floor(line / 2) * F.lit(11.0) + n % 3})
    return rows.withColumns({"x1": F.col("x0") + 30 + n / 10, "y1": F.col("y0") + 9})


def _headings(spark, d):
    return _blocks(spark, d).where(F.length("text") < 90).select("doc_id", "page", F.col("block_id").alias("heading_id"), "x0", "x1", "y1")


def _sections(spark, d):
    b = _blocks(spark, d).groupBy("doc_id", "page", L.x_bucket(F.col("x0")).alias("bucket"))
    return b.agg(F.min("block_id").alias("section_id"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _paths(spark, d):
    return _sections(spark, d).select("doc_id", "page", F.col("section_id").alias("path_id"), "x0", "x1")


@query(f"SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {BLOCKS} GROUP BY doc_id, page")
def page_bounds(spark, d):
    return L.bounds(_blocks(spark, d), ["doc_id", "page"])


@query(f"SELECT doc_id, page, block_id, 1 + coalesce(sum(CASE WHEN gap >= greatest(32, span * 0.08) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, block_id), 0)::INT AS \"column\" FROM (SELECT *, x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0, block_id) AS gap, greatest(max(x1) OVER (PARTITION BY doc_id, page) - min(x0) OVER (PARTITION BY doc_id, page), 1) AS span FROM {BLOCKS})")
def gap_columns(spark, d):
    return L.gap_columns(_blocks(spark, d)).select("doc_id", "page", "block_id", "column")


_SHARE = "CASE WHEN least({b} - {a}, {d} - {c}) > 0 THEN greatest(0, least({b}, {d}) - greatest({a}, {c})) / least({b} - {a}, {d} - {c}) ELSE 0 END"
_PAIR = dict(a="s.x0", b="s.x1", c="p.x0", d="p.x1")


@query(f"""WITH s AS {SECTIONS}, q AS (SELECT p.doc_id, p.page, p.section_id AS path_id, s.section_id, s.x0 AS p0, s.x1 AS p1, s.y1, {_SHARE.format(**_PAIR)} AS share, least(s.x1 - s.x0, p.x1 - p.x0) / greatest(s.x1 - s.x0, p.x1 - p.x0) AS ratio, abs((s.x0 + s.x1) / 2 - (p.x0 + p.x1) / 2) / (((s.x1 - s.x0) + (p.x1 - p.x0)) / 2) AS far FROM s p JOIN s ON p.doc_id = s.doc_id AND p.page = s.page + 1),
 r AS (SELECT *, share - 0.35 * far AS score FROM q WHERE share >= 0.28 AND (ratio >= 0.35 OR share >= 0.55) AND share - 0.35 * far >= 0.2),
 t AS (SELECT *, max((score, p0, p1)) OVER (PARTITION BY doc_id, page, path_id) AS best FROM r),
 u AS (SELECT *, {_SHARE.format(a="p0", b="p1", c="best[2]", d="best[3]")} < 0.5 AS apart FROM t),
 v AS (SELECT doc_id, page, path_id, any_value(best[1]) AS best, max(CASE WHEN apart THEN score END) AS rival, arg_max(section_id, (y1, section_id)) FILTER (NOT apart) AS section_id FROM u GROUP BY doc_id, page, path_id)
 SELECT s.doc_id, s.page, s.section_id AS path_id, v.section_id FROM s LEFT JOIN (SELECT * FROM v WHERE rival IS NULL OR best - rival >= 0.12) v ON s.doc_id = v.doc_id AND s.page = v.page AND s.section_id = v.path_id""")
def continuations(spark, d):
    return L.continued_from(_sections(spark, d), _paths(spark, d))


@query(f"SELECT b.doc_id, b.page, b.block_id, arg_min(h.heading_id, (b.y0 - h.y1, h.heading_id)) AS heading_id FROM {BLOCKS} b LEFT JOIN {HEADINGS} h ON b.doc_id = h.doc_id AND b.page = h.page AND h.y1 <= b.y0 AND b.y0 - h.y1 < 120 AND least(b.x1, h.x1) > greatest(b.x0, h.x0) GROUP BY b.doc_id, b.page, b.block_id")
def headings_above(spark, d):
    return L.heading_above(_blocks(spark, d), _headings(spark, d))


@query(f"SELECT p.doc_id, p.page, p.section_id AS path_id, arg_min(s.section_id, (abs((p.x0 + p.x1) / 2 - (s.x0 + s.x1) / 2), s.section_id)) AS section_id FROM {SECTIONS} p LEFT JOIN {SECTIONS} s ON p.doc_id = s.doc_id AND p.page = s.page + 1 GROUP BY p.doc_id, p.page, p.section_id")
def nearest_on_page_before(spark, d):
    return L.nearest_before(_paths(spark, d), _sections(spark, d))


_BOX = f"(SELECT doc_id, page, section_id AS box_id, x0, 0.0 AS y0, x1, y1 FROM {SECTIONS})"


@query(f"SELECT b.doc_id, b.page, b.block_id, o.box_id FROM {BLOCKS} b JOIN {_BOX} o ON b.doc_id = o.doc_id AND b.page = o.page AND b.x0 >= o.x0 - 6 AND b.x1 <= o.x1 + 6 AND b.y0 >= o.y0 - 6 AND b.y1 <= o.y1 + 6")
def blocks_in_boxes(spark, d):
    boxes = _sections(spark, d).select("doc_id", "page", F.col("section_id").alias("box_id"), "x0", F.lit(0.0).alias("y0"), "x1", "y1")
    return L.inside(_blocks(spark, d), boxes)


@query(f"WITH g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, block_id) AS gap FROM (SELECT doc_id, page, block_id, y0 * (1 + length(text) % 4) AS y0 FROM {BLOCKS})), m AS (SELECT doc_id, page, median(gap) AS typical FROM g GROUP BY doc_id, page) SELECT doc_id, page, block_id, (1 + coalesce(sum(CASE WHEN gap >= greatest(36, typical * 2.5) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, block_id), 0))::INT AS cluster FROM g JOIN m USING (doc_id, page)")
def gap_clusters(spark, d):
    wide = _blocks(spark, d).withColumn("y0", F.col("y0") * (1 + F.length("text") % 4))
    return L.clusters(wide).select("doc_id", "page", "block_id", "cluster")


@query(f"SELECT doc_id, min(line_no) AS \"first\", max(line_no) AS \"last\", count(*) AS n FROM (SELECT *, sum(CASE WHEN length(text) < 90 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM {LINES}) WHERE k > 0 GROUP BY doc_id, k")
def heading_intervals(spark, d):
    return L.boundary_intervals(_blocks(spark, d), F.length("text") < 90)


_SEG = f"(SELECT doc_id, page, x0, x1, 1 + sum(CASE WHEN x0 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {BLOCKS}))"


@query(f"SELECT doc_id, page, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM {_SEG} GROUP BY doc_id, page, run")
def merged_segments(spark, d):
    return L.merged_segments(_blocks(spark, d), ["doc_id", "page"])


@query(f"SELECT doc_id, page, round(sum(greatest(0, least(x1, 500) - greatest(x0, 0))) / 500, 9) AS share, sum(greatest(0, least(x1, 500) - greatest(x0, 0))) / 500 >= 0.45 AS enough FROM (SELECT doc_id, page, min(x0) AS x0, max(x1) AS x1 FROM {_SEG} GROUP BY doc_id, page, run) GROUP BY doc_id, page")
def covered_shares(spark, d):
    rows = L.covered_share(_blocks(spark, d), ["doc_id", "page"], F.lit(0.0), F.lit(500.0))
    return rows.withColumn("share", F.round("share", 9))


@query(f"SELECT doc_id, block_id, bucket, least(greatest(round((x0 - t0) / w * 100, 2), 0), 100) AS x, least(greatest(round((y0 - u0) / h * 100, 2), 0), 100) AS y FROM (SELECT *, CAST(floor(x0 / 200) AS INT) AS bucket, min(x0) OVER p AS t0, min(y0) OVER p AS u0, greatest(max(x1) OVER p - min(x0) OVER p, 1e-9) AS w, greatest(max(y1) OVER p - min(y0) OVER p, 1e-9) AS h FROM {BLOCKS} WINDOW p AS (PARTITION BY doc_id, page))")
def relative_places(spark, d):
    b = _blocks(spark, d)
    box = L.bounds(b, ["doc_id", "page"]).toDF("doc_id", "page", "t0", "u0", "t1", "u1")
    place = L.relative_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "t0", "u0", "t1", "u1")])
    return b.join(box, ["doc_id", "page"]).withColumn("r", place).select("doc_id", "block_id", L.x_bucket(F.col("x0")).alias("bucket"), "r.x", "r.y")


_ROLE = "CASE WHEN length(text) < 90 THEN 'HEADING' ELSE 'BODY' END"
_NAME = "CASE WHEN length(text) < 60 THEN 'SKILLS' ELSE 'OTHER' END"


@query(f"SELECT doc_id, line_no, CASE WHEN last_value(CASE WHEN role = 'HEADING' THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) = 'SKILLS' AND role <> 'HEADING' THEN 'SKILL' ELSE role END AS role FROM (SELECT doc_id, line_no, {_ROLE} AS role, {_NAME} AS name FROM {LINES})")
def skill_roles(spark, d):
    b = _blocks(spark, d)
    return b.select("doc_id", "line_no", L.skill_context(b, F.expr(_NAME), F.expr(_ROLE)).alias("role"))


@query(f"SELECT doc_id, page, block_id, (1 + sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, block_id))::INT AS slice FROM (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, block_id) AS gap FROM {BLOCKS})")
def row_slices(spark, d):
    return L.slices(_blocks(spark, d)).select("doc_id", "page", "block_id", "slice")


@query(f"""WITH t AS (SELECT doc_id, line_no, page AS section, length(text) < 150 AS is_title, length(text) >= 250 AS is_body FROM {BLOCKS}),
 u AS (SELECT *, max(CASE WHEN is_title THEN line_no END) OVER w AS lt, max(CASE WHEN is_body THEN line_no END) OVER w AS lb FROM t WINDOW w AS (PARTITION BY doc_id, section ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT doc_id, line_no, 1 + sum(CASE WHEN is_title AND lb IS NOT NULL AND (lt IS NULL OR lb > lt) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY line_no) AS entry FROM u""")
def entry_segments(spark, d):
    n = F.length("text")
    lines = _blocks(spark, d).select("doc_id", "line_no", F.col("page").alias("section"), (n < 150).alias("is_title"), (n >= 250).alias("is_body"))
    return L.entry_starts(lines).select("doc_id", "line_no", "entry")


@query("SELECT l_orderkey AS block_id, l_linenumber AS column_index, count(*) AS n, any_value(p_brand) AS meaning FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 WHERE p_brand IS NULL OR p_brand IS NOT NULL GROUP BY l_orderkey, l_linenumber, p_brand")
def bound_cells(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 10")
    cells = li.select(F.col("l_orderkey").alias("parent_block_id"), F.col("l_partkey").alias("table_id"), F.col("l_linenumber").alias("column_index"))
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id")).join(li.select(F.col("l_orderkey").alias("block_id")).distinct(), "block_id", "right")
    meanings = part.select(F.col("p_partkey").alias("table_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("column_index"), F.col("p_brand").alias("meaning"))
    return L.cell_bind(blocks, cells, meanings).groupBy("block_id", "column_index", "meaning").agg(F.count(F.lit(1)).alias("n"))
