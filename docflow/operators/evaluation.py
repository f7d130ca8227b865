"""Evaluation of runs: status counts, completeness, anomalies, taxonomy, comparison, gate, set differences.

Result frames: filename, archetype, status, failure_type, validation_violations array, diagnostics
array, elapsed_seconds, total_tokens, skills_recall (null if not measured).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import gate

# ---- fixed values ------------------------------------------------------------------------------
STATUSES = ("PASS", "PARTIAL", "FAIL", "ERROR")
MARKERS = ("NAME_IS_FORM_OR_DOC_TITLE", "SECTION_HEADER_IN_LOCATION", "NAME_SPLIT_INTO_LOCATION", "EXTREME_EDUCATION_COUNT_SKEW", "EXCESSIVE_EXPERIENCE_COUNT", "TABLE_HEADER_IN_EXPERIENCE")
LIMITS = {"errors": ("<=", 0), "validation_failures": ("<=", 0), "completeness_failures": ("<=", 0), "pass_rate": (">=", 80.0), "fail_rate": ("<=", 20.0), "avg_latency": ("<=", 20.0), "avg_tokens": ("<=", 15000.0)}
EDUCATION_SKEW, EXPERIENCE_EXCESS = 8, 12


def outcome() -> Column:
    """PASS, PARTIAL, FAIL or ERROR of a result row; completeness and validation failures are FAIL."""
    status, kind = F.upper("status"), F.coalesce("failure_type", F.lit(""))
    return F.when(status.isin("PASS", "PARTIAL"), status).when((status == "ERROR") & ~kind.isin("COMPLETENESS_ERROR", "VALIDATION_ERROR"), "ERROR").otherwise("FAIL")


def summary(results: DataFrame) -> DataFrame:
    """One row: counts by outcome, rates of two decimals, failures, latency, tokens and recall of those reported, markers seen."""
    n = F.count(F.lit(1))
    rows = results.withColumn("outcome", outcome())
    counts = [F.count_if(F.col("outcome") == s).alias(s.lower()) for s in STATUSES]
    rates = [F.round(F.count_if(F.col("outcome") == s) / n * 100, 2).alias(f"{s.lower()}_rate") for s in STATUSES]
    texts = F.concat("diagnostics", "validation_violations")
    seen = F.array_compact(F.array(*[F.when(F.bool_or(_any_has(texts, m)), F.lit(m)) for m in MARKERS])).alias("seen")
    failed = F.count_if((F.upper("status") == "COMPLETENESS_FAILED") | (F.col("failure_type") == "COMPLETENESS_ERROR")).alias("completeness_failures")
    return rows.agg(n.alias("total"), *counts, *rates, F.count_if(F.size("validation_violations") > 0).alias("validation_failures"), failed, F.round(F.avg("elapsed_seconds"), 2).alias("avg_latency"), F.round(F.avg("total_tokens"), 1).alias("avg_tokens"), F.round(F.avg("skills_recall"), 1).alias("skills_recall"), seen)


def gated(one: DataFrame) -> DataFrame:
    """A summary row with `reasons` why the gate fails: values beyond their limits, then markers seen."""
    row = {k: F.col({"errors": "error"}.get(k, k)) for k in LIMITS}
    reasons = F.concat(gate(row, LIMITS), F.transform("seen", lambda m: F.concat(F.lit("seen "), m)))
    return one.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def marker_checks(one: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Rows (marker, passed) of a summary row: whether no diagnostic or violation has the marker."""
    return one.select(F.explode(F.array(*map(F.lit, markers))).alias("marker"), "seen").select("marker", (~F.array_contains("seen", F.col("marker"))).alias("passed"))


def _any_has(texts: Column, marker: str) -> Column:
    return F.exists(texts, lambda x: x.contains(marker))


def failure_class() -> Column:
    """struct<category, origin> of a result that isn't PASS: the first rule that holds; null for PASS."""

    def has(*parts: str) -> Column:
        return F.coalesce(F.exists("diagnostics", lambda x: x.rlike("|".join(parts))), F.lit(False))

    kind = F.coalesce("failure_type", F.lit(""))
    rules = [
        (kind.contains("COMPLETENESS") | has("COMPLETENESS_ERROR"), "semantic_interpretation", "new_failure_class"),
        ((F.size("validation_violations") > 0) | kind.contains("VALIDATION"), "provenance", "already_known"),
        (has("NAME_IS_FORM_OR_DOC_TITLE", "NAME_SPLIT", "SECTION_HEADER_IN_LOCATION"), "personal_field_assignment", "already_known"),
        (has("TABLE_HEADER_IN_EXPERIENCE", "TABLE_METADATA_IN_EDUCATION", "EXTREME_EDUCATION"), "table_interpretation", "already_known"),
        (has("EXCESSIVE_EXPERIENCE_COUNT"), "experience_entity_linking", "already_known"),
        (has("PROJECTS_WITHOUT_NAMES"), "project_boundary", "already_known"),
        (F.coalesce(F.col("ocr_required"), F.lit(False)), "ocr_noise", "new_failure_class"),
        (has("CONTINUATION"), "multi_page_continuation", "already_known"),
        (kind.contains("EXTRACTION") | kind.contains("PARSER_EXCEPTION"), "semantic_interpretation", "requires_manual_review"),
    ]
    out = F.when(F.upper("status") == "PASS", None)
    for test, category, origin in rules:
        out = out.when(test, F.struct(F.lit(category).alias("category"), F.lit(origin).alias("origin")))
    return out.otherwise(F.struct(F.lit("other").alias("category"), F.lit("requires_manual_review").alias("origin")))


def compared(before: DataFrame, after: DataFrame, key: str = "filename") -> DataFrame:
    """Two runs by key, with the diagnostics that went and came, and `verdict`: the first rule that holds."""
    sides = []
    for df, side in ((before, "b"), (after, "c")):
        sides.append(df.select(key, F.struct(F.upper("status").alias("status"), F.col("validation_violations").alias("violations"), F.array_distinct("diagnostics").alias("diagnostics")).alias(side)))
    rows = sides[0].join(sides[1], key, "full_outer")
    none = F.array().cast("array<string>")
    b, c = (F.coalesce(F.col(f"{s}.diagnostics"), none) for s in "bc")
    rows = rows.withColumns({"reduced": F.array_sort(F.array_except(b, c)), "introduced": F.array_sort(F.array_except(c, b))})
    was, now = F.col("b.status"), F.col("c.status")
    worse = F.size("c.violations") > F.size("b.violations")
    verdict = (
        F.when(F.col("b").isNull(), F.when(now == "PASS", "newly_fixed").otherwise("manual_review"))
        .when(F.col("c").isNull(), "regression")
        .when(now.isin("FAIL", "ERROR") & was.isin("PASS", "PARTIAL"), "regression")
        .when(worse | (F.size("introduced") > F.size("reduced")), "regression")
        .when((now == "PASS") & (was != "PASS"), "newly_fixed")
        .when((F.size("b.violations") > 0) & (F.size("c.violations") == 0), "newly_fixed")
        .when((F.size("reduced") > 0) & (F.size("introduced") == 0), "newly_fixed")
        .when((now == "PARTIAL") | (F.size("c.diagnostics") > 0), "manual_review")
        .otherwise("unchanged")
    )
    return rows.withColumn("verdict", verdict)


def anomalies(name: Column, location: Column, n_education: Column, n_experience: Column, n_nameless: Column, *, titles: str, leaked: str) -> Column:
    """Signatures of a record that went wrong: form titles as names, headings as places, skewed counts, nameless projects."""
    words = F.split(F.upper(name), r"\s+")
    return F.array_compact(
        F.array(
            F.when(name.rlike(titles), F.concat(F.lit("NAME_IS_FORM_OR_DOC_TITLE: "), name)),
            F.when(location.rlike(leaked), F.concat(F.lit("SECTION_HEADER_IN_LOCATION: "), location)),
            F.when((location != "") & F.array_contains(words, F.upper(location)), F.concat(F.lit("NAME_SPLIT_INTO_LOCATION: "), location)),
            F.when(n_education >= EDUCATION_SKEW, F.concat(F.lit("EXTREME_EDUCATION_COUNT_SKEW: "), n_education.cast("string"))),
            F.when(n_experience >= EXPERIENCE_EXCESS, F.concat(F.lit("EXCESSIVE_EXPERIENCE_COUNT: "), n_experience.cast("string"))),
            F.when(n_nameless > 0, F.concat(F.lit("PROJECTS_WITHOUT_NAMES: "), n_nameless.cast("string"))),
        )
    )


def mean_ratio(*ratios: Column) -> Column:
    """Percentage of one decimal: the mean of the ratios that apply (nulls don't)."""
    known = F.array_compact(F.array(*ratios))
    return F.round(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known) * 100, 1)


def recall(expected: Column, found: Column) -> Column:
    """Percentage of one decimal of the expected terms that were found, case and outer blanks aside."""
    low = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    hits = F.filter(low(expected), lambda x: F.array_contains(low(found), x))
    return F.when(F.size(expected) > 0, F.round(F.size(hits) / F.size(expected) * 100, 1))


def metadata_errors(rows: DataFrame, archetypes: list[str]) -> DataFrame:
    """Rows (fixture_id, filename, errors): identifiers and paths missing, repeated or unsafe, unknown archetypes."""
    by_id, by_file = W.partitionBy("fixture_id"), W.partitionBy("filename")
    path = F.trim(F.coalesce("filename", F.lit("")))
    tests = [
        (F.trim(F.coalesce("fixture_id", F.lit(""))) == "", "no id"),
        (path == "", "no file name"),
        (path.startswith("/"), "absolute path"),
        (path.rlike(r"(^|/)\.\.(/|$)"), "path traversal"),
        (~F.lower(path).endswith(".pdf"), "not a pdf"),
        (~F.lower("archetype").isin(*archetypes), "unknown archetype"),
        (F.col("__ids") > 1, "repeated id"),
        (F.col("__files") > 1, "repeated file"),
    ]
    counted = rows.withColumns({"__ids": F.count(F.lit(1)).over(by_id), "__files": F.count(F.lit(1)).over(by_file)})
    return counted.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(e)) for t, e in tests]))).select(*rows.columns, "errors")


def list_diff(before: Column, after: Column) -> Column:
    """struct<added, removed, reordered> of two lists."""
    added, removed = F.array_except(after, before), F.array_except(before, after)
    return F.struct(added.alias("added"), removed.alias("removed"), ((F.size(added) == 0) & (F.size(removed) == 0) & (before != after)).alias("reordered"))


def same_partition(a: DataFrame, b: DataFrame, item: str, group: str, by: list[str]) -> DataFrame:
    """Rows by, same: whether both put the same items together, whatever the groups are called.

    A group is told by its smallest item, so nothing is collected: partitions are equal if each
    item has the same smallest mate in both.
    """
    low = [df.select(*by, item, F.min(item).over(W.partitionBy(*by, group)).alias(f"low_{i}")) for i, df in enumerate((a, b))]
    return low[0].join(low[1], [*by, item], "full_outer").groupBy(*by).agg(F.bool_and(F.col("low_0").eqNullSafe(F.col("low_1"))).alias("same"))


def owners_compared(catalog: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog lines with their owner in two runs and how these agree."""
    rows = catalog.select(*keys).join(a.select(*keys, F.col("owner").alias("owner_a")), keys, "left").join(b.select(*keys, F.col("owner").alias("owner_b")), keys, "left")
    what = F.when(F.col("owner_a").isNull() & F.col("owner_b").isNull(), "unowned").when(F.col("owner_a").isNull(), "only_b").when(F.col("owner_b").isNull(), "only_a").when(F.col("owner_a") == F.col("owner_b"), "same").otherwise("moved")
    return rows.withColumn("state", what)


def rank_percentiles(df: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """Values at given ranks (Columns over `n`, from 0) of each group, from counts of distinct values:
    no group's values are gathered in one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(by).orderBy(value)
    ranked = counts.select(by, value, F.sum("c").over(w).alias("upto"), F.sum("c").over(W.partitionBy(by)).alias("n"))
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") > rank, F.col(value))).alias(name) for name, rank in places.items()])


def greedy_matches(overlaps: DataFrame, by: str) -> DataFrame:
    """One-to-one matching by falling overlap (a, b, shared), ties by a then b: a pair counts if neither
    side is taken yet. Each group `by` folds alone."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["shared", "a", "b"], ascending=[False, True, True])
        used_a, used_b, keep = set(), set(), []
        for i, a, b in zip(ordered.index, ordered["a"], ordered["b"], strict=True):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                keep.append(i)
        return ordered.loc[keep]

    return overlaps.groupBy(by).applyInPandas(fold, overlaps.schema)


def markdown(one: DataFrame) -> DataFrame:
    """A one-row summary as a Markdown table."""
    names = [c for c, t in one.dtypes if not t.startswith("array")]
    lines = F.array(F.lit("| metric | value |"), F.lit("| --- | --- |"), *[F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c in names])
    return one.select(F.array_join(lines, "\n").alias("report"))
