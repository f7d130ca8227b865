import pytest
from docflow import functions as X
from docflow import operators as O
from docflow.functions import fields as P
from docflow.operators import evaluation as V
from docflow.operators import grounding as G
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Jan 2022 - Present", ("2022-01", None, True)),
        ("2022 - 2024", ("2022", "2024", False)),
        ("Date : 07/2022 - Present", ("2022-07", None, True)),
        ("2022 - 2024​", ("2022", "2024", False)),
        ("invalid range", None),
        ("2022 - soon", None),
        ("Date 2022 – 07-2024", ("2022", "2024-07", False)),
        ("Sept 2021 — now", ("2021-09", None, True)),
        ("Janfoo 2022 - Present", None),
        ("13/2022 - Present", None),
    ],
)
def test_date_range(spark, text, want):
    got = spark.range(1).select(X.date_range(F.lit(text)).alias("r")).first()["r"]
    assert (tuple(got) if got else None) == want


def test_config_hash_ignores_case_and_blanks(spark):
    row = spark.range(1).select(X.config_hash(F.lit(" A "), F.lit("b")).alias("x"), X.config_hash(F.lit("a"), F.lit("B ")).alias("y"), X.config_hash(F.lit("a"), F.lit("c")).alias("z")).first()
    assert row["x"] == row["y"] != row["z"]
    none = F.lit(None).cast("string")
    row = spark.range(1).select(X.config_hash(F.lit("a"), none, F.lit("b")).alias("x"), X.config_hash(F.lit("a"), F.lit("b")).alias("y")).first()
    assert row["x"] != row["y"]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    row = df.agg(X.nearest_rank(F.collect_list("v"), 0.5).alias("p50"), X.upper_median(F.collect_list("v")).alias("um")).first()
    assert (row["p50"], row["um"]) == (3, 3)


def test_page_is_bounded(spark):
    df = spark.range(5)
    assert [len(O.page(df, [F.desc("id")], 2, k).collect()) for k in (0, 2, 4)] == [2, 2, 1]
    with pytest.raises(ValueError):
        O.page(df, [F.desc("id")], 0, 0)


def test_merge_lines_keeps_bullets_apart(spark):
    rows = [(1, 1, "a", 0.0, 10.0, 0.0, "one", 10.0), (1, 1, "b", 12.0, 20.0, 0.5, "two", None), (1, 1, "c", 21.0, 30.0, 0.6, "* x", 10.0), (1, 1, "d", 31.0, 35.0, 0.7, "after", 10.0), (1, 1, "e", 36.0, 39.0, 0.8, "-5", 10.0), (1, 1, "f", 0.0, 5.0, 9.0, "next", 10.0), (1, 1, "g", 99.0, 105.0, 9.0, "far", 10.0), (1, 2, "h", 0.0, 5.0, 9.0, "page", 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_id string, x0 double, x1 double, y0 double, text string, font_size double")
    assert [r["text"] for r in O.merge_lines(df).orderBy("page", "line").collect()] == ["one two", "* x", "after -5", "next", "far", "page"]


def test_reading_order_drops_artifacts_of_two_columns_only(spark):
    rows = [(1, 1, "l1", 0.0, 90.0, 1.0, "left"), (1, 1, "r1", 300.0, 390.0, 0.0, "right"), (1, 1, "b", 150.0, 152.0, 9.0, "•"), (2, 1, "x", 0.0, 90.0, 1.0, "one"), (2, 1, "y", 5.0, 9.0, 9.0, "•")]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_id string, x0 double, x1 double, y0 double, text string")
    got = [(r["doc_id"], r["block_id"], r["column"]) for r in O.reading_order(df).orderBy("doc_id", "position").collect()]
    assert got == [(1, "l1", 1), (1, "r1", 2), (2, "x", 1), (2, "y", 1)]


def test_reading_order_splits_columns(spark):
    rows = [(1, 1, "l1", 0.0, 90.0, 1.0), (1, 1, "r1", 300.0, 390.0, 0.0), (1, 1, "l2", 0.0, 90.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_id string, x0 double, x1 double, y0 double")
    assert [r["block_id"] for r in O.reading_order(df).orderBy("position").collect()] == ["l1", "l2", "r1"]


def _one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: P.language_name(F.lit("English - 4/5")), "English"),
        (lambda: P.language_name(F.lit("4 / 5")), None),
        (lambda: P.language_name(F.lit(" French ")), "French"),
        (lambda: P.job_title(F.lit("  senior ENGINEER II of  QA ")), "Senior Engineer II of QA"),
        (lambda: P.without_fence(F.lit("```json\n{}\n```")), "{}"),
        (lambda: P.without_fence(F.lit("say ```x```")), "say ```x```"),
        (lambda: P.form_cell(F.lit(":\n : 5\nTime: 14:30")), "5\nTime: 14:30"),
        (lambda: P.linkedin(F.lit("LinkedIn: jane-doe")), "https://www.linkedin.com/in/jane-doe"),
        (lambda: P.linkedin(F.lit("LinkedIn: n/a")), None),
        (lambda: P.phone(F.lit("call +1 (650) 498-1240 now")), "+1 (650) 498-1240"),
        (lambda: P.phone(F.lit("room 12")), None),
        (lambda: P.ordered_subsequence(F.lit("Medicine & Public Health"), F.lit("Doctor of Medicine (M.D.) & Master of Public Health")), True),
        (lambda: P.ordered_subsequence(F.lit("Health Medicine"), F.lit("Medicine and Health")), False),
        (lambda: P.ordered_subsequence(F.lit("a a"), F.lit("a b")), False),
        (lambda: P.iso_supported(F.lit("2018-07"), F.lit("since July 2018")), True),
        (lambda: P.iso_supported(F.lit("2018-07"), F.lit("since May 2018")), False),
        (lambda: P.phone_supported(F.lit("+16504981240"), F.lit("(650) 498-1240")), True),
        (lambda: P.section_of(F.lit("Career Objective"), {"SKILLS": ["Skills"]}), "SUMMARY"),
        (lambda: P.section_of(F.lit("SKILL"), {"SKILLS": ["Skills"]}), "SKILLS"),
        (lambda: P.section_of(F.lit("Skil"), {"SKILLS": ["Skills"]}), "SKILLS"),
        (lambda: P.section_of(F.lit("Ski"), {"SKILLS": ["Skills"]}), None),
        (lambda: X.safe_filename(F.lit("a b/c.d_é-1")), "abcd_é-1"),
        (lambda: X.safe_filename(F.lit("...")), "export"),
        (lambda: X.normalize_text(F.lit("\n\ta b\r\n")), "a b"),
        (lambda: X.normalize_text(F.lit(None).cast("string")), ""),
        (lambda: X.has_all(F.array(F.lit("Spark SQL"), F.lit("Go")), X.terms(F.lit("go, spark%"))), True),
        (lambda: X.has_all(F.array(F.lit("Spark SQL")), X.terms(F.lit("spark"))), False),
    ],
)
def test_fields(spark, make, want):
    assert _one(spark, make()) == want


def test_degree_and_place(spark):
    got = _one(spark, P.degree_parts(F.lit("B.Tech (Computer Science) | NIT ,Calicut")))
    assert tuple(got) == ("B.Tech", "NIT, Calicut", "Computer Science")
    assert tuple(_one(spark, P.degree_parts(F.lit("Master in Physics")))) == ("Master", None, "Physics")
    assert tuple(_one(spark, P.degree_parts(F.lit("BA (Hons)")))) == ("BA (Hons)", None, None)
    assert tuple(_one(spark, P.place_parts(F.lit("Some College - Pune, India")))) == ("Some College", "Pune, India")


def test_greedy_matches_by_brute_force(spark):
    import random

    r = random.Random(2)
    rows = [(g, a, b, r.randrange(1, 5)) for g in range(6) for a in range(5) for b in range(5) if r.random() < 0.6]
    got = sorted(tuple(x) for x in V.greedy_matches(spark.createDataFrame(rows, "g long, a long, b long, shared long"), "g").collect())
    want = []
    for g in range(6):
        left = [x for x in rows if x[0] == g]
        while left:
            best = min(left, key=lambda x: (-x[3], x[1], x[2]))
            want.append(best)
            left = [x for x in left if x[1] != best[1] and x[2] != best[2]]
    assert got == sorted(want)


def test_repaired_claims(spark):
    blocks = spark.createDataFrame([(1, "b0", None, 1, "worked at Initech Corporation"), (1, "b1_c1", "b1", 1, "Senior Analyst"), (1, "b2", None, 2, "Springfield")], "doc_id long, block_id string, parent_id string, page long, text string")
    rows = [("kept", "Initech", ["b0"]), ("split", "Senior Analyst", ["b1"]), ("known", "Initech", ["b0", "b9"]), ("found", "Springfield", ["b0"]), ("removed", "Umbrella", ["b0"]), ("none", "Initech", [])]
    claims = spark.createDataFrame([(k, 1, "e", "f", v, i) for k, v, i in rows], "claim_id string, doc_id long, entity string, field string, value string, ids array<string>")
    got = {r["claim_id"]: (r["step"], r["new_ids"]) for r in G.repaired(claims, blocks).collect()}
    assert got == {"kept": ("kept", ["b0"]), "split": ("kept", ["b1"]), "known": ("known_only", ["b0"]), "found": ("found", ["b2"]), "removed": ("removed", []), "none": ("found", ["b0"])}
    codes = {(r["claim_id"], r["code"]) for r in G.violations(claims, blocks).collect()}
    assert codes == {("known", G.UNKNOWN), ("found", G.UNSUPPORTED), ("removed", G.UNSUPPORTED), ("none", G.MISSING)}


def test_merge_lines_folds_over_batches(spark):
    """Pages and runs that lie over several batches, and no grouped function, which takes milliseconds a page."""
    from docflow import operators as O

    rows = [(d, 1, f"b{i}", 10.0 * i, 10.0 * i + 9, 0.0 if i < 5 else 20.0, f"t{i}", 10.0) for d in range(40) for i in range(7)]
    rows += [(None, 1, "b0", 0.0, 5.0, 0.0, None, None), (99, 1, "b0", None, 5.0, 0.0, "x", 10.0), (99, 1, "b1", 1.0, 5.0, 0.0, "y", 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_id string, x0 double, x1 double, y0 double, text string, font_size double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        merged = O.merge_lines(df)
        assert "FlatMapGroups" not in merged._jdf.queryExecution().executedPlan().toString()
        got = {(r["doc_id"], r["line"]): (r["text"], r["x0"], r["x1"], r["y0"], r["n_parts"]) for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in range(40):
        assert got[d, 1] == ("t0 t1 t2 t3 t4", 0.0, 49.0, 0.0, 5) and got[d, 2] == ("t5 t6", 50.0, 69.0, 20.0, 2)
    assert got[None, 1][0] == "" and got[99, 1][0] == "y" and got[99, 2][0] == "x" and len(got) == 83


def test_repair_moves_each_text_once(spark):
    """The search for other blocks never repeats a block's text by its words."""
    from docflow.operators import grounding as G

    blocks = spark.createDataFrame([(1, f"b{i}", None, 1, " ".join(f"word{j}" for j in range(i, i + 50))) for i in range(20)], "doc_id long, block_id string, parent_id string, page int, text string")
    claims = spark.createDataFrame([("a", 1, "f", "word55", ["b0"]), ("b", 1, "f", "word67 word68", ["b0", "b77"]), ("c", 1, "f", "word999", ["b0"]), ("d", 1, "f", "word3", ["b0", "b77"])], "claim_id string, doc_id long, field string, value string, ids array<string>")
    fixed = G.repaired(claims, blocks)
    plan = fixed._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in plan.lower()
    got = {r["claim_id"]: (r["step"], r["new_ids"]) for r in fixed.collect()}
    assert got == {"a": ("found", ["b10"]), "b": ("found", ["b19"]), "c": ("removed", []), "d": ("known_only", ["b0"])}


def test_repair_judges_every_open_claim_against_every_block(spark):
    """Short words, parts of words, dates, phone numbers and other scripts are looked for as well; all
    hits equal those of the full join of claims and blocks."""
    texts = ["Go and C at Initech", "Tel 5551234567", "since 14 Mar 2020", "日本語 spoken", "New York, then Old York", "7 x 8", "naïve Straße", None]
    values = ["Go", "C", "en", "init", "+1 (555) 123-4567", "555 123-4567", "2020-03", "2020-03-14", "2021-03", "日本", "new york", "york new", "old new", "7 8", "8 7", "Straße", "ïv", "Umbrella", None]
    schema = "doc_id long, block_id string, parent_id string, page long, text string"
    blocks = spark.createDataFrame([(d, f"b{i}", None, 1, t) for d in (1, 2) for i, t in enumerate(texts) if (i + d) % 4], schema)
    claims = spark.createDataFrame([(f"{d}/{i}", d, "f", v, []) for d in (1, 2, 3) for i, v in enumerate(values)], "claim_id string, doc_id long, field string, value string, ids array<string>")
    want = {c: None for c in [r["claim_id"] for r in claims.collect()]}
    pairs = claims.join(blocks, "doc_id").where(P.supported(F.col("value"), F.col("text"), X.alnum_fold)).groupBy("claim_id").agg(F.min("block_id").alias("hit"))
    want |= {r["claim_id"]: r["hit"] for r in pairs.collect()}
    got = {r["claim_id"]: (r["new_ids"] or [None])[0] for r in G.repaired(claims, blocks).collect()}
    assert got == want
    value = {v: got[f"1/{i}"] or got[f"2/{i}"] for i, v in enumerate(values)}
    assert all(value[v] for v in ("Go", "C", "init", "+1 (555) 123-4567", "555 123-4567", "2020-03", "2020-03-14", "日本", "new york", "7 8", "Straße", "ïv"))
    assert not any(value[v] for v in ("2021-03", "Umbrella", "york new", None))
