"""Stage ngram_jaccard on tables whose ids repeat or are null."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

R = random.Random(13)


def test_rows_that_share_an_id(spark):
    text = lambda: " ".join("".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d, only = (text() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(3, a), (5, near(a)), (5, only), (7, b), (7, near(b)), (None, c), (None, near(c)), (9, d), (9, d)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, df, "").collect()]
    assert (3, a) in kept and (5, only) in kept and (9, d) in kept
    assert sum(i == 7 for i, _ in kept) == 1 and sum(i is None for i, _ in kept) == 1
    assert len(kept) == 5
