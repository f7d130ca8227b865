"""Queries of the field functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..functions import fields as P
from ..sources import line_blocks, table
from .registry import LINES, query

#: Invented vocabularies of the label rules.
DEGREES = ["bachelor", "master", "phd", "b.sc", "m.sc"]
SECTIONS = {"SUMMARY": ["Summary", "Profile"], "EXPERIENCE": ["Experience", "Work History"], "EDUCATION": ["Education"], "SKILLS": ["Skills", "Technical Skills"]}
HEADINGS = sorted({a.lower() for own in SECTIONS.values() for a in own} | {"the", "der", "les", "los"})
TITLES = ["analyst", "the and"]


def _lines(spark, d):
    return line_blocks(table(spark, d, "documents"))


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_token(x: str) -> str:
    months = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in P.MONTH_NUMBERS.items()) + "}"
    named = f"{months}[lower(regexp_extract(trim({x}), '^([A-Za-z]+)\\s+(\\d{{4}})$', 1))]"
    number = f"TRY_CAST(regexp_extract(trim({x}), '^(\\d{{1,2}})[/-](\\d{{4}})$', 1) AS INT)"
    year = f"regexp_extract(trim({x}), '(\\d{{4}})$', 1)"
    return f"CASE WHEN {named} IS NOT NULL THEN {year} || '-' || {named} WHEN {number} BETWEEN 1 AND 12 THEN {year} || '-' || lpad({number}::VARCHAR, 2, '0') WHEN regexp_matches(trim({x}), '^\\d{{4}}$') THEN trim({x}) END"


def sql_range(x: str) -> tuple[str, str, str]:
    """SQL of start, end and current; start is null where the range is bad."""
    bare = f"regexp_replace(regexp_replace(regexp_replace({x}, '[​‌‍﻿]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '(?i)^\\s*date\\s*:?\\s*', '')"
    start = sql_token(f"regexp_extract({bare}, '{P.RANGE}', 1)")
    last = f"trim(regexp_extract({bare}, '{P.RANGE}', 2))"
    current = f"lower({last}) IN ({_quoted(P.CURRENT)})"
    end = sql_token(last)
    return f"CASE WHEN {current} OR ({end}) IS NOT NULL THEN ({start}) END", f"CASE WHEN NOT {current} THEN {end} END", current


def sql_phone(x: str) -> str:
    found = f"trim(regexp_extract(regexp_replace({x}, '\\s', ' ', 'g'), '{P.PHONE}', 0))"
    return f"CASE WHEN length(regexp_replace({found}, '[^0-9]', '', 'g')) >= 7 THEN {found} END"


def sql_linkedin(x: str) -> str:
    handle = f"trim(trim(regexp_extract({x}, '{P.LINKEDIN_LABEL}', 1)), '/')"
    return f"coalesce(nullif(regexp_extract({x}, '{P.LINKEDIN}', 0), ''), CASE WHEN regexp_matches({handle}, '{P.LINKEDIN_HANDLE}') AND lower({handle}) NOT IN ({_quoted(P.NO_HANDLE)}) THEN 'https://www.linkedin.com/in/' || {handle} END)"


@query(f"""WITH f AS (SELECT doc_id, line_no, text, nullif(regexp_extract(text, '{X.EMAIL}', 0), '') AS email, {sql_phone("text")} AS phone, {sql_linkedin("text")} AS linkedin, nullif(regexp_extract(text, '{P.GITHUB}', 0), '') AS github FROM {LINES}),
 g AS (SELECT doc_id, arg_min(email, line_no) FILTER (email IS NOT NULL) AS email, arg_min(phone, line_no) FILTER (phone IS NOT NULL) AS phone, arg_min(linkedin, line_no) FILTER (linkedin IS NOT NULL) AS linkedin, arg_min(github, line_no) FILTER (github IS NOT NULL) AS github FROM f GROUP BY doc_id),
 u AS (SELECT doc_id, line_no, list_filter(regexp_extract_all(text, '{P.URL}'), lambda x: NOT (linkedin IS NOT NULL AND contains(x, linkedin)) AND NOT (github IS NOT NULL AND contains(x, github)))[1] AS url FROM (SELECT f.doc_id, f.line_no, f.text, g.linkedin, g.github FROM f JOIN g USING (doc_id)))
 SELECT g.*, p.portfolio FROM g LEFT JOIN (SELECT doc_id, arg_min(url, line_no) AS portfolio FROM u WHERE url IS NOT NULL GROUP BY doc_id) p USING (doc_id)""")
def contact_fields(spark, d):
    lines = _lines(spark, d).select("doc_id", "line_no", "text", X.first_match(F.col("text"), X.EMAIL).alias("email"), P.phone(F.col("text")).alias("phone"), P.linkedin(F.col("text")).alias("linkedin"), P.github(F.col("text")).alias("github"), P.urls(F.col("text")).alias("urls"))
    kinds = ("email", "phone", "linkedin", "github")
    first = lines.groupBy("doc_id").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))).alias(k) for k in kinds], F.array_sort(F.collect_list(F.when(F.size("urls") > 0, F.struct("line_no", "urls")))).alias("urls"))
    other = F.filter(F.flatten("urls.urls"), lambda u: ~F.coalesce(F.contains(u, F.col("linkedin")), F.lit(False)) & ~F.coalesce(F.contains(u, F.col("github")), F.lit(False)))
    return first.select("doc_id", *kinds, F.get(other, F.lit(0)).alias("portfolio"))


_WRITTEN = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Date: ' || strftime(o_orderdate, '%b %Y') || ' - Present' WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%Y') || ' – ' || strftime(o_orderdate, '%m-%Y') WHEN '3-MEDIUM' THEN 'date ' || strftime(o_orderdate, '%Y') || ' — ' || strftime(o_orderdate, '%Y') || chr(8203) WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%B %Y') || '-soon' ELSE strftime(o_orderdate, '%b%Y') || ' - now' END"


def _written(spark, d):
    o, p = table(spark, d, "orders"), F.col("o_orderpriority")
    at = lambda f: F.date_format("o_orderdate", f)
    text = F.when(p == "1-URGENT", F.concat(F.lit("Date: "), at("MMM yyyy"), F.lit(" - Present"))).when(p == "2-HIGH", F.concat(at("MM/yyyy"), F.lit(" – "), at("MM-yyyy"))).when(p == "3-MEDIUM", F.concat(F.lit("date "), at("yyyy"), F.lit(" — "), at("yyyy"), F.lit("​"))).when(p == "4-NOT SPECIFIED", F.concat(at("MMMM yyyy"), F.lit("-soon"))).otherwise(F.concat(at("MMMyyyy"), F.lit(" - now")))
    return o.withColumn("text", text)


_S, _E, _C = sql_range("text")


@query(f"SELECT o_orderkey, s AS start, CASE WHEN s IS NOT NULL THEN e END AS stop, CASE WHEN s IS NOT NULL THEN c END AS current FROM (SELECT o_orderkey, {_S} AS s, {_E} AS e, {_C} AS c FROM (SELECT o_orderkey, {_WRITTEN} AS text FROM orders))")
def date_ranges_of_orders(spark, d):
    return _written(spark, d).withColumn("r", P.parse_range(F.col("text"))).select("o_orderkey", "r.start", F.col("r.end").alias("stop"), "r.current")


@query(f"""SELECT o_orderkey, {sql_token("regexp_extract('(' || strftime(o_orderdate, '%b %Y') || ' )', '^\\(\\s*([A-Za-z]+\\s+\\d{4}|\\d{4})\\s*\\)$', 1)")} AS day FROM orders""")
def parenthesised_dates(spark, d):
    text = F.concat(F.lit("("), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" )"))
    return table(spark, d, "orders").select("o_orderkey", P.parenthesised_date(text).alias("day"))


@query(f"SELECT o_orderkey, contains(text, strftime(o_orderdate, '%Y')) AND (contains(text, strftime(o_orderdate, '%m')) OR contains(lower(text), lower(strftime(o_orderdate, '%b')))) AS by_month, contains(text, strftime(o_orderdate, '%Y')) AS by_year FROM (SELECT o_orderkey, o_orderdate, {_WRITTEN} AS text FROM orders)")
def iso_date_support(spark, d):
    o = _written(spark, d)
    return o.select("o_orderkey", P.iso_supported(F.date_format("o_orderdate", "yyyy-MM"), F.col("text")).alias("by_month"), P.iso_supported(F.date_format("o_orderdate", "yyyy"), F.col("text")).alias("by_year"))


@query("SELECT c_custkey, contains(there, own) OR (length(there) >= 7 AND length(own) - length(there) BETWEEN 1 AND 3 AND ends_with(own, there)) AS ok FROM (SELECT c_custkey, '91' || (5550000 + c_custkey) AS own, regexp_replace('tel. ' || (5550000 + c_custkey) || c_mktsegment || CASE WHEN c_acctbal < 0 THEN '0' ELSE '' END, '[^0-9]', '', 'g') AS there FROM customer)")
def phone_support(spark, d):
    number = (F.col("c_custkey") + 5550000).cast("string")
    text = F.concat(F.lit("tel. "), number, F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "0").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", P.phone_supported(F.concat(F.lit("+91 "), number), text).alias("ok"))


@query(f"""SELECT doc_id, line_no, trim(text) = '' OR trim(text) IN ({_quoted(P.ARTIFACTS)}) OR (length(trim(text)) <= 2 AND NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) AS artifact,
 regexp_matches(lower(trim(text)), '^({"|".join(P.CONTACT_MARKERS)})') OR contains(lower(text), 'linkedin.com') OR contains(lower(text), 'github.com') OR regexp_matches(lower(text), '@\\S+\\.\\S+') AS contact,
 regexp_matches(text, '{P.LIST_MARKER}') AS listed, trim(regexp_replace(text, '{P.LIST_MARKER}', '')) AS bare FROM (SELECT doc_id, line_no, regexp_replace(text, '[​‌‍]', '', 'g') AS text FROM {LINES})""")
def line_filters(spark, d):
    lines = _lines(spark, d).withColumn("text", F.regexp_replace("text", "[​‌‍]", ""))
    t = F.col("text")
    return lines.select("doc_id", "line_no", P.artifact(t).alias("artifact"), P.contact_block(t).alias("contact"), P.list_marked(t).alias("listed"), P.without_marker(t).alias("bare"))


_LV = "regexp_extract(trim(text), '^([^:]+):\\s*(\\S.*)$', {})"


@query(f"SELECT doc_id, line_no, trim({_LV.format(1)}) AS label, trim({_LV.format(2)}) AS value FROM {LINES} WHERE trim({_LV.format(1)}) <> '' AND len(regexp_split_to_array(trim({_LV.format(1)}), '\\s+')) <= 5")
def label_values(spark, d):
    return _lines(spark, d).withColumn("p", P.label_value(F.col("text"))).where("p is not null").select("doc_id", "line_no", "p.label", "p.value")


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(':' || chr(10) || ': ' || coalesce(text, '') || chr(10) || ' :', chr(10)), lambda x: trim(ltrim(trim(x), ':'))), lambda x: x <> ''), chr(10)) AS cell FROM conversations")
def form_cells(spark, d):
    text = F.concat(F.lit(":\n: "), F.coalesce("text", F.lit("")), F.lit("\n :"))
    return table(spark, d, "conversations").select("conv_id", "turn", P.form_cell(text).alias("cell"))


@query("SELECT event_id, replace(props, event_type, '[REDACTED]') AS shown, props AS inside FROM events")
def fences_and_secrets(spark, d):
    e = table(spark, d, "events")
    fenced = F.concat(F.lit(" ```JSON\n"), F.col("props"), F.lit("\n```\n"))
    return e.select("event_id", P.masked(F.col("props"), F.col("event_type")).alias("shown"), P.without_fence(fenced).alias("inside"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE initcap AS name FROM (SELECT c_custkey, c_acctbal, c_mktsegment AS initcap FROM customer)".replace("ELSE initcap AS name", "ELSE initcap END AS name"))
def language_names(spark, d):
    text = F.when(F.col("c_acctbal") < 0, F.lit(" 4/5 ")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" - 4/5")))
    return table(spark, d, "customer").select("c_custkey", P.language_name(text).alias("name"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(p_name || '  OF ' || p_type || ' SDE II x', '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN regexp_matches(w, '^\\d+$') OR regexp_matches(regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '^([A-Z]{2,3}|[IVX]+)$') THEN w WHEN lower(w) IN ('and', 'of', 'for', 'to', 'in', 'on', 'with') THEN lower(w) ELSE upper(left(w, 1)) || lower(substring(w, 2)) END), ' ') AS title FROM part")
def job_titles(spark, d):
    text = F.concat("p_name", F.lit("  OF "), "p_type", F.lit(" SDE II x"))
    return table(spark, d, "part").select("p_partkey", P.job_title(text).alias("title"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Master' ELSE 'Bachelor of ' || c_mktsegment END AS degree, CASE WHEN c_acctbal >= 0 THEN c_name || ', City' END AS institution, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS field,
 CASE WHEN c_acctbal >= 0 THEN 'School ' || c_custkey ELSE c_name END AS school, CASE WHEN c_acctbal >= 0 THEN 'Town, Land' END AS place FROM customer""")
def degrees_and_places(spark, d):
    low = F.col("c_acctbal") < 0
    degree = F.when(low, F.concat(F.lit("Master in "), "c_mktsegment")).otherwise(F.concat(F.lit("Bachelor of "), "c_mktsegment", F.lit(" | "), "c_name", F.lit(" ,  City")))
    place = F.when(low, F.col("c_name")).otherwise(F.concat(F.lit("School "), F.col("c_custkey").cast("string"), F.lit(" – Town , Land")))
    c = table(spark, d, "customer").withColumns({"p": P.degree_parts(degree), "q": P.place_parts(place)})
    return c.select("c_custkey", "p.degree", "p.institution", "p.field", F.col("q.institution").alias("school"), F.col("q.location").alias("place"))


_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"SELECT doc_id, line_no, len(w) >= 2 AND regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' ' || w[1] || ' (.* )?' || w[len(w)] || ' ') AS in_order, len(w) >= 2 AND regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' ' || w[len(w)] || ' (.* )?' || w[1] || ' ') AS turned, len(w) > 0 AS same FROM (SELECT doc_id, line_no, {_W} AS w FROM {LINES})")
def word_support(spark, d):
    lines = _lines(spark, d).withColumn("w", P.words(F.col("text")))
    first, last = F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.coalesce(F.get("w", F.size("w") - 1), F.lit(""))
    some = F.when(F.size("w") >= 2, F.concat(first, F.lit(", "), last)).otherwise(F.lit(""))
    turned = F.when(F.size("w") >= 2, F.concat(last, F.lit(", "), first)).otherwise(F.lit(""))
    t = F.col("text")
    return lines.select("doc_id", "line_no", P.ordered_subsequence(some, t).alias("in_order"), P.ordered_subsequence(turned, t).alias("turned"), P.same_words(F.reverse(F.concat_ws(" ", F.transform("w", F.reverse))), t).alias("same"))


_BARE = "regexp_replace(lower(trim(text)), '[^a-z0-9]+', '', 'g')"
_FOLDED = [(n, "".join(c for c in a.lower() if c.isalnum())) for n, own in SECTIONS.items() for a in own]
_SECTION = "CASE WHEN regexp_matches(text, '(?i)\\bobjective\\b') THEN 'SUMMARY' " + " ".join(f"WHEN {_BARE} = '{a}' THEN '{n}'" for n, a in _FOLDED) + " " + " ".join(f"WHEN {len(a)} - length({_BARE}) IN (1, 2) AND starts_with('{a}', {_BARE}) THEN '{n}'" for n, a in _FOLDED) + " END"
#: Headings that the tables lack are written into a few lines: each document's first becomes `Technical Skill:`.
_HEADED = f"(SELECT doc_id, line_no, CASE WHEN line_no = 0 AND length(text) < 60 THEN 'Technical Skill:' ELSE text END AS text FROM {LINES})"


def _headed(spark, d):
    short = (F.col("line_no") == 0) & (F.length("text") < 60)
    return _lines(spark, d).withColumn("text", F.when(short, F.lit("Technical Skill:")).otherwise(F.col("text")))


@query(f"""SELECT doc_id, line_no, {_SECTION} AS section, trim(text) <> '' AND len(regexp_split_to_array(trim(text), '\\s+')) <= 5 AND NOT regexp_matches(text, '\\d') AND NOT regexp_matches(trim(text), '[.:;,]$') AND lower(trim(text)) NOT IN ('spark')
 AND ((upper(trim(text)) = trim(text) AND regexp_matches(text, '\\p{{L}}')) OR length(text) >= 12) AS unknown FROM {_HEADED}""")
def headings(spark, d):
    t = F.col("text")
    return _headed(spark, d).select("doc_id", "line_no", P.section_of(t, SECTIONS).alias("section"), P.unknown_heading(t, ["Spark"], F.length(t).cast("double"), F.lit(False)).alias("unknown"))


_V, _L = "trim(text)", "lower(trim(text))"
_CAP = f"len(list_filter(regexp_split_to_array({_V}, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}')))"
_RULES = [
    (f"{_V} = ''", "UNKNOWN", 0.0), (f"({sql_range(_V)[0]}) IS NOT NULL", "DATE", 1.0), (f"({sql_range(f"regexp_extract({_V}, '^\\(\\s*(.+?)\\s*\\)$', 1)")[0]}) IS NOT NULL", "DATE", 1.0),
    (f"regexp_matches({_V}, '{P.LIST_MARKER}')", "BULLET", 1.0), (f"regexp_matches({_L}, '^({'|'.join(x.replace('.', '\\.') for x in DEGREES)})($|\\s+(in|of)\\b|[:(/.\\-])')", "DEGREE", 1.0),
    (f"regexp_matches({_L}, '\\bdegree\\b') AND contains({_V}, '/') AND length({_V}) <= 60", "DEGREE", 0.8), (f"{_L} IN ({_quoted(HEADINGS)})", "SECTION_HEADER", 1.0), (f"{_L} IN ({_quoted(TITLES)})", "JOB_TITLE", 1.0),
    (f"regexp_matches({_L}, '{'|'.join(P.TITLE_WORDS)}') AND line_no = 0", "JOB_TITLE", 0.7), (f"regexp_matches({_L}, '{P.COMPANY}') AND {_CAP} >= 2", "COMPANY", 0.9), (f"regexp_matches({_L}, '{P.COMPANY}') AND regexp_matches({_V}, '[!&]')", "COMPANY", 0.7),
    (f"contains({_V}, '!') AND {_CAP} >= 2", "COMPANY", 0.7), (f"regexp_matches({_L}, '{P.SCHOOL}')", "INSTITUTION", 0.9), (f"contains({_L}, 'location:') OR contains({_L}, 'based in')", "LOCATION", 1.0),
    (f"contains({_V}, ',') AND regexp_matches({_L}, '{P.PLACES}')", "LOCATION", 0.9), (f"length({_V}) > 80", "DESCRIPTION", 0.6),
]


@query(f"SELECT doc_id, line_no, CASE {' '.join(f"WHEN {t} THEN '{n}'" for t, n, _ in _RULES)} ELSE 'UNKNOWN' END AS label, (CASE {' '.join(f'WHEN {t} THEN {s}' for t, _, s in _RULES)} ELSE 0.0 END)::DOUBLE AS score FROM {LINES}")
def line_labels(spark, d):
    one = P.labelled(F.col("text"), degrees=DEGREES, sections=HEADINGS, titles=TITLES, emphasis=F.col("line_no") == 0)
    return _lines(spark, d).withColumn("l", one).select("doc_id", "line_no", "l.label", "l.score")


_LIG = "coalesce(text, '')"
for _one, _more in X.LIGATURES:
    _LIG = f"replace({_LIG}, '{_one}', '{_more}')"
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]+"


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LIG}, '\\r\\n?', chr(10), 'g'), '{_CONTROL}', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS digest FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -page_id - 1, html FROM pages)")
def text_normalize(spark, d):
    both = table(spark, d, "documents").select("doc_id", "text").union(table(spark, d, "pages").select(-F.col("page_id") - 1, "html"))
    return both.select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_replace(url, '[^\\p{L}\\p{N}_-]', '', 'g') = '' THEN 'export' ELSE regexp_replace(url, '[^\\p{L}\\p{N}_-]', '', 'g') END AS name FROM pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query(f"SELECT doc_id, max(CASE WHEN regexp_matches(text, '{X.EMAIL}') THEN 0.99 ELSE 0.55 END)::DOUBLE AS confidence FROM {LINES} GROUP BY doc_id")
def contact_confidence(spark, d):
    known = F.when(F.col("text").rlike(X.EMAIL), F.lit(P.CONFIDENCE["email"])).otherwise(F.lit(P.CONFIDENCE["ambiguous"]))
    return _lines(spark, d).groupBy("doc_id").agg(F.max(known).alias("confidence"))


@query("SELECT c_custkey, CASE WHEN c_name <> '' AND c_acctbal > 0 AND n > 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM (SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_acctbal) AS c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)")
def completeness_status(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    each = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.first("c_name").alias("c_name"), F.first("c_acctbal").alias("balance"), F.count("o_orderkey").alias("n"))
    full = (F.trim("c_name") != "") & (F.col("balance") > 0) & (F.col("n") > 0)
    return each.select("c_custkey", F.when(full, "SUCCESS").otherwise("PARTIAL").alias("status"))
