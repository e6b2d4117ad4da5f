"""Each registered query with SQL against DuckDB, the others for rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from kilnspark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLE:
        assert rows
        return
    found = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == want


@pytest.mark.parametrize("name", ["a1_audit_by_device", "m2_apply_updates", "w4_throttle", "r4_resolve_edits", "a9_best_under_target"])
def test_order_of_rows_does_not_matter(spark, name, monkeypatch):
    want = sorted(map(str, registry.QUERIES[name](spark, DATA).collect()))
    read = type(spark.read).parquet
    for n in (1, 7):
        monkeypatch.setattr(type(spark.read), "parquet", lambda self, path, n=n: read(self, path).repartition(n))
        assert sorted(map(str, registry.QUERIES[name](spark, DATA).collect())) == want
