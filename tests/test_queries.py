import os

import pytest
from docflow import plans

FOLDER = "/root/testdata/sf0.001"


def _norm(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if v is None or str(v) in ("nan", "NaT", "<NA>"):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, name):
    import duckdb

    got = plans.queries()[name](spark, FOLDER).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(_norm(v) for v in r) for r in t[columns].itertuples(index=False)), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]
