"""The registered queries against their SQL on the driver's tables, with embeddings that link planted into op1's."""

import os
import random

import pytest

pytest.importorskip("docflow.llm")
duckdb = pytest.importorskip("duckdb")

import __spark_entry__  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def _rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(None if v != v else v for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def _equal(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        at = f"{folder}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    got = __spark_entry__.queries()[name](spark, folder).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
    return got


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op3_substring_dedup", "op5_ngram_jaccard", "op6_chat_format"])
def test_equals_sql(spark, name):
    assert len(_equal(spark, name, FOLDER))


def test_embeddings_equal_sql_where_some_link(spark, tmp_path):
    r = random.Random(9)
    base = [[r.gauss(0, 1) for _ in range(24)] for _ in range(30)]
    vectors = [[x + r.gauss(0, 0.2) for x in base[i % 30]] for i in range(240)] + [base[0]] * 4 + [[0.0] * 24, None, [1.0] * 3, [2.0] * 3, [float("inf")] * 24]
    rows = [(i, v, None) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = _equal(spark, "op1_embedding_dedup", str(tmp_path))
    assert (got["n_links"] > 0).sum() > 100


def test_hot_keys_and_chains(spark):
    """One band for a third of all, a hub, and a cluster larger than several blocks."""
    from docflow.llm import embeddings, jaccard, lines

    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(500)]
    base = r.choices(words, k=90)
    near = [" ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(60)]
    texts = near + [" ".join(r.choices(words, k=90)) for _ in range(60)] + [" ".join(base)] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.join(df, block=8).collect()
    assert {x["component_id"] for x in got if x["doc_id"] < 60 or x["doc_id"] >= 120} == {0}
    assert lines.dedup(df, block=8).count() == 99
    assert lines.dedup(df, block=1).count() == 99  # a chain of more blocks than are judged as one
    hub = spark.createDataFrame([(i, [1.0, 0.001 * i, 0.0]) for i in range(300)], "vec_id long, embedding array<double>")
    assert {x["component_id"] for x in embeddings.join(hub, cell=10, block=16).collect()} == {0}
