"""Queries of the grounding operators: documents' lines are blocks, claims are made of their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..functions import fields as P
from ..operators import grounding as G
from ..sources import line_blocks, table
from .registry import LINES, query

#: Even lines are blocks, the others fragments of the line before; each document claims things of line 1.
BLOCKS = f"(SELECT doc_id, CASE WHEN line_no % 2 = 0 THEN 'b' || line_no ELSE 'b' || line_no || '_c1' END AS block_id, CASE WHEN line_no % 2 = 1 THEN 'b' || line_no END AS parent_id, 1 + line_no // 12 AS page, text, line_no FROM {LINES})"
_CLAIMS = [
    ("'first'", "regexp_extract(text, '[A-Za-z]+', 0)", "['b0', 'b1']", "array('b0', 'b1')"),
    ("'none'", "lang", "[]", "cast(array() as array<string>)"),
    ("'unknown'", "split_part(text, ' ', 1)", "['b0', 'b9999']", "array('b0', 'b9999')"),
    ("'wrong'", "'Zzyzx Corporation ' || source", "['b0']", "array('b0')"),
    ("'blank'", "' '", "['b0']", "array('b0')"),
    ("'last'", "regexp_extract(text, '([a-z]+)[^a-z]*$', 1)", "['b1']", "array('b1')"),
]
CLAIMS = "(" + " UNION ALL SELECT ".join(["SELECT doc_id || '/' || field AS claim_id, doc_id, length(text) % 3 AS entity, field, value, ids FROM (SELECT doc_id, text, lang, source, " + f"{f} AS field, {v} AS value, {a}::VARCHAR[] AS ids FROM documents)" if i == 0 else "doc_id || '/' || field, doc_id, length(text) % 3, field, value, ids FROM (SELECT doc_id, text, lang, source, " + f"{f} AS field, {v} AS value, {a}::VARCHAR[] AS ids FROM documents)" for i, (f, v, a, _) in enumerate(_CLAIMS)]) + ")"


def _blocks(spark, d):
    b, n = line_blocks(table(spark, d, "documents")), F.col("line_no")
    name = F.concat(F.lit("b"), n.cast("string"))
    return b.select("doc_id", F.when(n % 2 == 0, name).otherwise(F.concat(name, F.lit("_c1"))).alias("block_id"), F.when(n % 2 == 1, name).alias("parent_id"), (F.floor(n / 12) + 1).alias("page"), "text", "line_no")


def _claims(spark, d):
    each = F.explode(F.array(*[F.struct(F.expr(f).alias("field"), F.expr(v).alias("value"), F.expr(a).alias("ids")) for f, v, _, a in _CLAIMS]))
    rows = table(spark, d, "documents").select("doc_id", (F.length("text") % 3).alias("entity"), each.alias("c"))
    return rows.select(F.concat_ws("/", "doc_id", "c.field").alias("claim_id"), "doc_id", "entity", "c.*")


_CITED = f"(SELECT c.claim_id, c.doc_id, c.field, c.value, c.pos, c.cited, coalesce(b.block_id, f.block_id) AS block_id, coalesce(b.page, f.page) AS page, coalesce(b.text, f.text) AS text FROM (SELECT *, unnest(ids) AS cited, unnest(range(len(ids))) AS pos FROM {CLAIMS}) c LEFT JOIN {BLOCKS} b ON c.doc_id = b.doc_id AND c.cited = b.block_id LEFT JOIN {BLOCKS} f ON c.doc_id = f.doc_id AND c.cited = f.parent_id)"


@query(f"SELECT claim_id, pos, cited, block_id, page, md5(text) AS text FROM {_CITED}")
def cited_blocks(spark, d):
    rows = G.cited(_claims(spark, d), _blocks(spark, d))
    return rows.select("claim_id", "pos", "cited", "block_id", "page", F.md5("text").alias("text"))


@query(f"SELECT c.claim_id, coalesce(n, 0) AS n, coalesce(pages, []) AS pages FROM {CLAIMS} c LEFT JOIN (SELECT claim_id, count(block_id) AS n, list_distinct(list(page ORDER BY pos) FILTER (page IS NOT NULL)) AS pages FROM {_CITED} GROUP BY claim_id HAVING count(block_id) > 0) e USING (claim_id)")
def claim_evidence(spark, d):
    rows = G.with_evidence(_claims(spark, d), _blocks(spark, d))
    return rows.select("claim_id", F.size("texts").cast("long").alias("n"), F.array_sort("pages").alias("pages"))


_FOLD = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_OK = f"(contains({_FOLD.format('joined')}, {_FOLD.format('value')}) OR (len({_WORDS.format('value')}) > 0 AND list_sort({_WORDS.format('value')}) = list_sort({_WORDS.format('joined')})) OR (len({_WORDS.format('value')}) >= 2 AND regexp_matches(' ' || array_to_string({_WORDS.format('joined')}, ' ') || ' ', ' ' || array_to_string({_WORDS.format('value')}, ' (.* )?') || ' ')))"
_JOINED = f"(SELECT claim_id, doc_id, any_value(field) AS field, any_value(value) AS value, string_agg(text, ' ' ORDER BY pos) AS joined, count(*) AS n, count(block_id) AS known FROM {_CITED} WHERE trim(value) <> '' GROUP BY claim_id, doc_id)"


@query(f"""SELECT claim_id, '{G.MISSING}' AS code, field AS detail FROM {CLAIMS} WHERE len(ids) = 0 AND trim(value) <> '' UNION ALL SELECT claim_id, '{G.UNKNOWN}', cited FROM {_CITED} WHERE block_id IS NULL AND trim(value) <> ''
 UNION ALL SELECT claim_id, '{G.UNSUPPORTED}', value FROM {_JOINED} WHERE known > 0 AND NOT {_OK}""")
def grounding_violations(spark, d):
    return G.violations(_claims(spark, d), _blocks(spark, d)).select("claim_id", "code", "detail")


@query(f"SELECT DISTINCT claim_id, '{G.CROSSED}' AS code, CAST(owner AS VARCHAR) AS detail FROM (SELECT claim_id, doc_id, entity, unnest(ids) AS block_id FROM {CLAIMS}) c JOIN (SELECT doc_id, block_id, length(text) % 3 AS owner FROM {BLOCKS}) s ON c.doc_id = s.doc_id AND c.block_id = s.block_id WHERE owner <> entity")
def cross_entity_spans(spark, d):
    spans = _blocks(spark, d).select("doc_id", (F.length("text") % 3).alias("entity"), "block_id")
    return G.crossed_spans(_claims(spark, d), spans).select("claim_id", "code", "detail")


@query(f"SELECT c.claim_id, CASE WHEN j.known > 0 AND {_OK.replace('value', 'j.value')} THEN c.value END AS value, c.value IS NOT NULL AND NOT coalesce(j.known > 0 AND {_OK.replace('value', 'j.value')}, false) AS dropped FROM {CLAIMS} c LEFT JOIN {_JOINED} j USING (claim_id) WHERE trim(c.value) <> ''")
def sanitised_claims(spark, d):
    return G.sanitised(_claims(spark, d).where("trim(value) <> ''"), _blocks(spark, d)).select("claim_id", "value", "dropped")


@query()
def repaired_claims(spark, d):
    """Which ids a claim ends with; the tests hold cases of every step."""
    return G.repaired(_claims(spark, d).where("trim(value) <> ''"), _blocks(spark, d))


@query(f"""SELECT coalesce(b.doc_id, o.doc_id) AS doc_id, count(b.block_id) AS blocks, count(*) FILTER (b.block_id IS NOT NULL AND o.n IS NOT NULL) AS covered, count(*) FILTER (o.n IS NULL) AS unassigned, count(*) FILTER (b.block_id IS NULL) AS unknown, count(*) FILTER (o.n > 1) AS duplicate, round(count(*) FILTER (b.block_id IS NOT NULL AND o.n IS NOT NULL) * 100.0 / nullif(count(b.block_id), 0), 2) AS share
 FROM {BLOCKS} b FULL OUTER JOIN (SELECT doc_id, cited AS block_id, count(DISTINCT claim_id) AS n FROM {_CITED} GROUP BY ALL) o ON b.doc_id = o.doc_id AND b.block_id = o.block_id GROUP BY 1""")
def source_coverage(spark, d):
    owned = _claims(spark, d).select("doc_id", F.col("claim_id").alias("node_id"), F.explode("ids").alias("block_id"))
    return G.coverage(_blocks(spark, d), owned)


_NODES = f"(SELECT doc_id, line_no AS node_id, CASE WHEN line_no > 0 THEN line_no // 3 END AS parent_id, CASE WHEN line_no = 0 THEN 1 WHEN length(text) < 100 THEN 2 ELSE 3 END AS level, 9 - line_no // 9 AS page FROM {LINES})"


@query(f"WITH n AS {_NODES}, j AS (SELECT n.*, p.level AS pl, p.page AS pp FROM n LEFT JOIN n p ON n.doc_id = p.doc_id AND n.parent_id = p.node_id) SELECT doc_id, node_id, 'UNKNOWN_PARENT' AS code FROM j WHERE parent_id IS NOT NULL AND pl IS NULL UNION ALL SELECT doc_id, node_id, 'ROOT_LEVEL' FROM j WHERE parent_id IS NULL AND level <> 1 UNION ALL SELECT doc_id, node_id, 'LEVEL_JUMP' FROM j WHERE level <> pl + 1 UNION ALL SELECT doc_id, node_id, 'PAGE_ORDER' FROM j WHERE page < pp")
def tree_violations(spark, d):
    n = F.col("line_no")
    level = F.when(n == 0, 1).when(F.length("text") < 100, 2).otherwise(3)
    nodes = line_blocks(table(spark, d, "documents")).select("doc_id", n.alias("node_id"), F.when(n > 0, F.floor(n / 3)).alias("parent_id"), level.alias("level"), (F.lit(9) - F.floor(n / 9)).alias("page"))
    return G.tree_violations(nodes)


@query(f"SELECT doc_id, kind, min(line_no) AS \"first\", count(*) AS n, md5(string_agg(text, '|' ORDER BY line_no)) AS texts FROM (SELECT *, sum(CASE WHEN kind = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (SELECT *, length(text) > 200 AS kind FROM {LINES}))) GROUP BY doc_id, run, kind")
def list_item_runs(spark, d):
    runs = G.list_runs(line_blocks(table(spark, d, "documents")), F.length("text") > 200)
    return runs.select("doc_id", "kind", "first", "n", F.md5(F.array_join("texts", "|")).alias("texts"))


_WEIGHTS = {"DE": [("(?i)(^| )und( |$)", 2.0), ("(?i)(^| )der( |$)", 1.0)], "EN": [("(?i)(^| )and( |$)", 2.0), ("(?i)(^| )the( |$)", 1.0)], "FR": [("(?i)(^| )que( |$)", 2.0), ("(?i)(^| )les( |$)", 1.0)]}
_SUMS = ", ".join(f"sum({' + '.join(f'CASE WHEN regexp_matches(text, {chr(39)}{p}{chr(39)}) THEN {w} ELSE 0 END' for p, w in own)})::DOUBLE AS {n}" for n, own in _WEIGHTS.items())


@query(f"SELECT doc_id, CASE WHEN total > 0 AND best >= 0.7 * total AND best - second >= 0.15 * total THEN CASE WHEN de = best THEN 'DE' WHEN en = best THEN 'EN' ELSE 'FR' END END AS section, best AS score, total FROM (SELECT *, de + en + fr AS total, list_reverse_sort([de, en, fr])[1] AS best, list_reverse_sort([de, en, fr])[2] AS second FROM (SELECT doc_id, {_SUMS} FROM {LINES} GROUP BY doc_id))")
def section_inference(spark, d):
    return G.section_scores(line_blocks(table(spark, d, "documents")), _WEIGHTS)


@query("SELECT doc_id, item_id FROM (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents) a JOIN (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS p FROM benchmark) b ON contains(t, p)")
def grounded_substring(spark, d):
    texts = table(spark, d, "documents").select("doc_id", X.alnum_fold(F.col("text")).alias("t"))
    items = table(spark, d, "benchmark").select("item_id", X.alnum_fold(F.col("text")).alias("p"))
    return G.contained(texts, items)
