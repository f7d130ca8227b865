"""Record assembly: merging of passes, evidence classes, tables' meanings, line parsers, contact records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import EMAIL, first_match
from ..functions import fields as P

# ---- fixed values ------------------------------------------------------------------------------
BODY_ROLES = ("ENTRY_TITLE", "ORGANIZATION", "DATE", "BULLET", "SKILL", "BODY")
FORM_WORDS = r"\b(surname|date of birth|height|weight|hair color|address|post applied for)\b"
HEAD_STRONG, HEAD_MEDIUM, ROW_STRONG, ROW_MEDIUM, CELL_STRONG, CELL_MEDIUM, CONTEXT, ENOUGH = 4.5, 3.0, 4.0, 2.5, 1.0, 0.5, 0.5, 2.0
PROSE_WORDS, PROSE_LINES, SUMMARY_WORDS = 8, 3, 30
STRUCTURAL_LABEL = r"(?i)^\s*(?:company|employer|role|title|location|institution|degree)\s*:\s*"


# ---- merging -----------------------------------------------------------------------------------
def ids_by_role(rows: DataFrame, by: str, role: str, item: str, order: str) -> DataFrame:
    """Rows by, role, ids: the items of each role in order."""
    own = F.array_sort(F.collect_list(F.struct(order, item)))
    return rows.groupBy(by, role).agg(own.alias("x")).select(by, role, F.transform("x", lambda x: x[item]).alias("ids"))


def first_known(rows: DataFrame, by: str, value: str, order: str, default: str) -> DataFrame:
    """The first value, in order, that isn't the default; else the default."""
    known = F.when(F.col(value).isNotNull() & (F.col(value) != default), F.col(order))
    return rows.groupBy(by).agg(F.coalesce(F.min_by(value, known), F.lit(default)).alias(value))


def last_writer(rows: DataFrame, keys: list[str], value: str, order: str, protected: str) -> DataFrame:
    """The last value written for each key, but a protected one is never overwritten."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct((F.col(value) == protected).alias("p"), order)).alias(value))


def concatenated(passes: DataFrame, by: str, items: str, order: str) -> DataFrame:
    """The lists of all passes one after the other."""
    own = F.array_sort(F.collect_list(F.struct(order, items)))
    return passes.groupBy(by).agg(F.flatten(F.transform(own, lambda x: x[items])).alias(items))


def merged_sections(sections: DataFrame, by: str, target: str, heading: str, order: str, ids: str) -> DataFrame:
    """One section a target: headings joined by ` / `, block ids in order."""
    own = F.array_sort(F.collect_list(F.struct(order, heading, ids)))
    heads = F.array_join(F.array_distinct(F.transform("x", lambda x: x[heading])), " / ")
    return sections.groupBy(by, target).agg(own.alias("x")).select(by, target, heads.alias(heading), F.flatten(F.transform("x", lambda x: x[ids])).alias(ids))


def distinct_union(rows: DataFrame, by: str, items: str) -> DataFrame:
    """The distinct items of all rows, sorted. Exploded first, so that repeats combine before the shuffle."""
    each = rows.select(by, F.explode(items).alias("item")).distinct()
    return each.groupBy(by).agg(F.array_sort(F.collect_list("item")).alias(items))


def lookup_first(rows: DataFrame, known: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """`value` from the first of several keys (column of rows, column of known) that is known."""
    out = rows
    for i, (mine, theirs) in enumerate(keys):
        one = known.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(mine)).agg(F.min(value).alias(f"__v{i}"))
        out = out.join(one, mine, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))])).select(*rows.columns, value)


def kept_blocks(blocks: DataFrame, wanted: DataFrame, *, header: Column | None = None) -> DataFrame:
    """Blocks of an id list (doc_id, block_id) and, if asked for, those of the header region."""
    mark = wanted.select("doc_id", "block_id").distinct().withColumn("__in", F.lit(True))
    rows = blocks.join(mark, ["doc_id", "block_id"], "left")
    test = F.col("__in").isNotNull() if header is None else F.col("__in").isNotNull() | F.coalesce(header, F.lit(False))
    return rows.where(test).drop("__in")


def isolated(rows: DataFrame, target: Column, collections: list[str]) -> DataFrame:
    """Only the collection that the target names stays; the others are empty."""
    types = dict(rows.dtypes)
    return rows.withColumns({c: F.when(target == c, F.col(c)).otherwise(F.array().cast(types[c])) for c in collections})


def compact_json(rows: DataFrame, by: str, fields: list[str], order: list[str], defaults: dict[str, object]) -> DataFrame:
    """One JSON array a group, in a total order with nulls last; nulls and defaults left out."""
    shown = [F.when(F.col(f) == F.lit(defaults[f]), None).otherwise(F.col(f)).alias(f) if f in defaults else F.col(f) for f in fields]
    keys = [F.struct(F.col(o).isNull().alias("n"), F.col(o).alias("v")).alias(f"k{i}") for i, o in enumerate(order)]
    own = F.array_sort(F.collect_list(F.struct(*keys, F.to_json(F.struct(*shown)).alias("json"))))
    return rows.groupBy(by).agg(F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: x["json"]), ","), F.lit("]")).alias("json"))


# ---- evidence and meaning ----------------------------------------------------------------------
def body_evidence(blocks: DataFrame, by: str) -> DataFrame:
    """Why a document has a body: two body roles, two table cells below the header, or three blocks of 80
    characters outside the header. blocks: role, table_id, cell_role, row_index, region_kind, text."""
    role = F.upper(F.coalesce("role", F.lit("")))
    cell = F.col("table_id").isNotNull() & ((F.coalesce("cell_role", F.lit("")) != "HEADER") | (F.col("row_index") > 0))
    dense = (F.coalesce("region_kind", F.lit("")) != "header") & ~role.isin("HEADER", "CONTACT", "FOOTER") & (F.trim("text") != "")
    counted = blocks.groupBy(by).agg(F.count_if(role.isin(*BODY_ROLES)).alias("roles"), F.count_if(cell).alias("cells"), F.count_if(dense).alias("blocks"), F.sum(F.when(dense, F.length(F.trim("text"))).otherwise(0)).alias("chars"))
    kind = F.when(F.col("roles") >= 2, "structural_body_roles").when(F.col("cells") >= 2, "table_data_cells").when((F.col("blocks") >= 3) & (F.col("chars") >= 80), "dense_body_text")
    return counted.select(by, kind.alias("evidence"))


def form_tables(cells: DataFrame) -> DataFrame:
    """Rows (table_id, is_form): three cells with colons, a fifth of four or more, or form words in the first row."""
    colons, n = F.count_if(F.contains("text", F.lit(":"))), F.count(F.lit(1))
    words = F.coalesce(F.bool_or((F.col("row_index") == 0) & F.lower(F.trim("text")).rlike(FORM_WORDS)), F.lit(False))
    return cells.groupBy("table_id").agg(((colons >= 3) | ((n >= 4) & (colons / n >= 0.2)) | words).alias("is_form"))


def table_purpose(tables: DataFrame, purposes: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Adds purpose and confidence: the purpose with the most evidence in heading, first row and cells, 2.0
    at least; ties to the first. tables: heading, first_row, cells (lower-case texts), is_form.

    A pattern counts in the cells only if its words weren't seen in heading or first row.
    """

    def points(own: dict[str, list[str]]) -> Column:
        total = F.lit(0.0)
        for kind, head, row, cell in (("strong", HEAD_STRONG, ROW_STRONG, CELL_STRONG), ("medium", HEAD_MEDIUM, ROW_MEDIUM, CELL_MEDIUM)):
            for p in own.get(kind, []):
                in_head, in_row = F.col("heading").rlike(p), F.col("first_row").rlike(p)
                total = total + F.when(in_head, head).otherwise(0.0) + F.when(in_row, row).otherwise(0.0) + F.when(~in_head & ~in_row & F.col("cells").rlike(p), cell).otherwise(0.0)
        for p in own.get("context", []):
            total = total + F.when(F.col("first_row").rlike(p) | (F.col("is_form") & F.col("cells").rlike(p)), CONTEXT).otherwise(0.0)
        return total

    ranked = F.array_sort(F.array(*[F.struct((-points(own)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, own) in enumerate(purposes.items())]))
    rows = tables.withColumn("__best", F.get(ranked, F.lit(0)))
    enough = -F.col("__best.s") >= ENOUGH
    return rows.withColumns({"purpose": F.when(enough, F.col("__best.name")).otherwise("unknown"), "confidence": F.when(enough, F.least(F.lit(1.0), -F.col("__best.s") / 10)).otherwise(0.0)}).drop("__best")


def column_roles(cells: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Rows (table_id, column_index, role): the first pattern that a column's header texts have."""
    head = cells.where((F.col("row_index") == 0) | (F.col("cell_role") == "HEADER"))
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "text"))), lambda x: x["text"]), " "))
    role = F.lit("unknown")
    for pattern, name in reversed(patterns):
        role = F.when(F.col("header").rlike(pattern), name).otherwise(role)
    return head.groupBy("table_id", "column_index").agg(text.alias("header")).select("table_id", "column_index", role.alias("role"))


def leading_summary(lines: DataFrame, is_opener: Column) -> DataFrame:
    """Rows (doc_id, n): leading lines of prose (8 words or more) that make a summary without a heading:
    three at least, 30 words at least, and then an opener."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    prose = (words >= PROSE_WORDS) & ~P.list_marked(F.col("text")) & P.parse_range(F.col("text")).isNull() & ~is_opener
    rows = lines.withColumns({"__i": F.row_number().over(w), "__w": words, "__prose": prose, "__open": is_opener})
    rows = rows.withColumn("__broken", F.sum(F.when(F.col("__prose"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = rows.groupBy("doc_id").agg(F.count_if(F.col("__broken") == 0).alias("n"), F.sum(F.when(F.col("__broken") == 0, F.col("__w")).otherwise(0)).alias("words"), F.min_by("__open", F.when(F.col("__broken") > 0, F.col("__i"))).alias("opened"))
    return run.where((F.col("n") >= PROSE_LINES) & (F.col("words") >= SUMMARY_WORDS) & F.col("opened")).select("doc_id", "n")


def rule_boxes(vertical: DataFrame, horizontal: DataFrame, *, apart: float = 80.0, slack: float = 4.0) -> DataFrame:
    """Boxes (doc_id, page, x0, x1, y0, y1) between two vertical rules of one height, more than `apart`
    from each other, that horizontal rules close above and below.

    Rules meet on document, page and the band of their top, never all with all.
    """
    keys = ["doc_id", "page", "band"]
    v = vertical.withColumn("band", F.round(F.col("y0") / slack).cast("long"))
    right = v.select(*keys, F.col("x0").alias("x1"), F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    pairs = v.select(*keys, "x0", "y0", "y1").join(right, keys).where(f"x1 - x0 > {apart} and abs(y0 - r0) <= {slack} and abs(y1 - r1) <= {slack}").drop("r0", "r1", "band")
    for edge in ("y0", "y1"):
        near = pairs.withColumn("band", F.explode(F.array(*[F.round(F.col(edge) / slack).cast("long") + k for k in (-1, 0, 1)])))
        h = horizontal.select("doc_id", "page", F.round(F.col("y0") / slack).cast("long").alias("band"), F.col("x0").alias("h0"), F.col("x1").alias("h1"), F.col("y0").alias("hy"))
        pairs = near.join(h, keys).where(f"abs(hy - {edge}) <= {slack} and h0 <= x0 + {slack} and h1 >= x1 - {slack}").select(*[c for c in pairs.columns]).distinct()
    return pairs


def covering_slice(claims: DataFrame, blocks: DataFrame, *, most: int = 4) -> DataFrame:
    """Rows (claim_id, first, n): the shortest run of up to `most` neighbouring blocks whose texts together
    have the value; ties to the earlier. Runs are windows over blocks, not start times end."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    runs = blocks
    grown = [F.array_join(F.collect_list("text").over(w.rowsBetween(0, k)), " ").alias(f"t{k}") for k in range(most)]
    full = [F.count(F.lit(1)).over(w.rowsBetween(0, k)).alias(f"n{k}") for k in range(most)]
    runs = blocks.select("doc_id", "line_no", *grown, *full)
    each = claims.select("claim_id", "doc_id", "value").join(runs, "doc_id")
    size = F.coalesce(*[F.when((F.col(f"n{k}") == k + 1) & F.contains(F.lower(f"t{k}"), F.lower("value")), k + 1) for k in range(most)])
    hits = each.withColumn("n", size).where("n is not null")
    best = hits.groupBy("claim_id").agg(F.min(F.struct("n", F.col("line_no").alias("first"))).alias("b"))
    return best.select("claim_id", "b.first", F.col("b.n").cast("long").alias("n"))


# ---- line parsers and records ------------------------------------------------------------------
def company_line(text: Column) -> Column:
    """struct<company, location, start, end, current> of `Company, Place / Jan 2020 - Present`; null otherwise."""
    left, right = F.trim(F.substring_index(text, "/", 1)), F.trim(F.regexp_extract(text, r"^[^/]*/(.*)$", 1))
    parts = F.filter(F.transform(F.split(left, ","), lambda x: F.trim(x)), lambda x: x != "")
    dates = P.parse_range(right)
    fits = F.contains(text, F.lit("/")) & (F.size(parts) >= 2) & dates.isNotNull()
    return F.when(fits, F.struct(F.get(parts, F.lit(0)).alias("company"), F.array_join(F.slice(parts, 2, 100), ", ").alias("location"), dates["start"].alias("start"), dates["end"].alias("end"), dates["current"].alias("current")))


def title_line(text: Column) -> Column:
    """struct<title, start, end, current> of `Title - Jan 2020 to Present`; null otherwise."""
    date = r"(?:\d{1,2}[/-]\d{4}|[A-Za-z]+\s+\d{4}|\d{4})"
    pattern = rf"(?i)^(.+?)\s+-\s+({date})\s+to\s+({date}|Present|Current|Now)$"
    start, last = (F.regexp_extract(F.trim(text), pattern, i) for i in (2, 3))
    current, end = F.lower(last).isin(*P.CURRENT), P.date_token(last)
    fits = P.date_token(start).isNotNull() & (current | end.isNotNull())
    return F.when(fits, F.struct(F.trim(F.regexp_extract(F.trim(text), pattern, 1)).alias("title"), P.date_token(start).alias("start"), F.when(~current, end).alias("end"), current.alias("current")))


def without_label(text: Column) -> Column:
    """A value without the structural label before it, tidied at commas and ends."""
    bare = F.regexp_replace(F.regexp_replace(text, STRUCTURAL_LABEL, ""), r"\s*,\s*", ", ")
    return F.regexp_replace(bare, r"^[ ,;]+|[ ,;]+$", "")


def description(lines: Column) -> Column:
    """Lines as one text: markers off, blanks single, no blank before punctuation."""
    bare = F.filter(F.transform(lines, lambda x: P.without_marker(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(bare, " "), r"\s+", " "), r" ([,.;:!?])", "$1"))


def certificate(text: Column) -> Column:
    """struct<id, issued, expires, url> as labelled in the text."""
    token = r"((?:[A-Za-z]+\s+)?(?:\d{1,2}[/-])?\d{4})"
    return F.struct(
        first_match(F.regexp_extract(text, r"(?i)credential\s*id\s*:?\s*([A-Za-z0-9-]+)", 1), r".+").alias("id"),
        P.date_token(F.regexp_extract(text, rf"(?i)issued\s*:?\s*{token}", 1)).alias("issued"),
        P.date_token(F.regexp_extract(text, rf"(?i)expires?\s*:?\s*{token}", 1)).alias("expires"),
        F.get(P.urls(text), F.lit(0)).alias("url"),
    )


def contact_records(lines: DataFrame) -> DataFrame:
    """Rows doc_id and, for each field, struct<value, confidence>: the first match in reading order."""
    text = F.col("text")
    kinds = {"email": (first_match(text, EMAIL), "email"), "phone": (P.phone(text), "phone"), "linkedin": (P.linkedin(text), "url"), "github": (P.github(text), "url")}
    rows = lines.select("doc_id", "line_no", *[c.alias(k) for k, (c, _) in kinds.items()])
    found = rows.groupBy("doc_id").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))).alias(k) for k in kinds])
    scored = [F.struct(F.col(k).alias("value"), F.when(F.col(k).isNotNull(), P.CONFIDENCE[s]).otherwise(0.0).alias("confidence")).alias(k) for k, (_, s) in kinds.items()]
    return found.select("doc_id", *scored)


def supplemented(records: DataFrame, contacts: DataFrame) -> DataFrame:
    """Records (doc_id, email) whose missing e-mail comes from the document's contact record."""
    known = contacts.select("doc_id", F.col("email.value").alias("__email"))
    return records.join(known, "doc_id", "left").withColumn("email", F.coalesce("email", "__email")).drop("__email")


def planned_passes(sections: DataFrame, *, most: int = 3) -> DataFrame:
    """Units of work: each section's entries in units of up to `most`, numbered from 1 over the document."""
    w = W.partitionBy("doc_id", "section").orderBy("entry")
    rows = sections.withColumn("__unit", F.floor((F.row_number().over(w) - 1) / most))
    units = rows.groupBy("doc_id", "section", "__unit").agg(F.min("entry").alias("first"), F.count(F.lit(1)).alias("n"))
    return units.withColumn("unit", F.row_number().over(W.partitionBy("doc_id").orderBy("section", "__unit")).cast("long")).drop("__unit")


def single_flight(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Requests with `leader`: the first of those in a batch with equal keys; only leaders are worked on."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return requests.join(first, keys).withColumn("leader", F.struct(*order) == F.col("__first")).drop("__first")
