"""Text queries over every document, by brute force: what SQL cannot express."""

import re

from docflow import functions as X
from docflow import plans
from pyspark.sql import functions as F

TEXTS = ["The été and les amis", "lesé, élan: DIE Straße", "derü the_ with", "plain the and", "", None, "thé LES"]


def _folder(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_alias_match(spark, tmp_path):
    found = {r["doc_id"]: r["found"] for r in plans.queries()["alias_match"](spark, _folder(spark, tmp_path, TEXTS)).collect()}
    want = {i: None if t is None else sorted({plans.ALIASES[m.lower()] for m in re.findall(r"(?i)\b(the|and|with|der|die|les)\b", t)}) for i, t in enumerate(TEXTS)}
    assert found == want


DIRTY = ["one\r\ntwo\rthree \n four", "a\x00b\x0bc\x1fd\x7fe", "zero\u200bwidth\u200c\u200d\ufeff end", "\ufb01ne \ufb04 \ufb05", " \t x \t\n\n y ", "\r\n", "", None, "plain"]


def test_normalize_text(spark):
    def normal(t):
        t = (t or "").replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\u200b\u200c\u200d\u2060\ufeff]+", " ", t)
        for one, more in zip("\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06", ("ff", "fi", "fl", "ffi", "ffl", "st", "st"), strict=True):
            t = t.replace(one, more)
        return "\n".join(re.sub("[ \t]+", " ", x).strip() for x in t.split("\n")).strip()

    df = spark.createDataFrame(list(enumerate(DIRTY)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", X.normalize_text(F.col("t")).alias("n")).collect()}
    assert got == {i: normal(t) for i, t in enumerate(DIRTY)}
