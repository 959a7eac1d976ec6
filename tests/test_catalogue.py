"""Every query with SQL against DuckDB, and the shape of the rest, on the smallest test tables."""

import importlib.util
import os
from collections import Counter

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _entry():
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


from tidemark.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*cols).collect())
    if name not in catalogue.sql():
        assert got
        return
    cur = duck.execute(catalogue.sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    entry = _entry()
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["key", "value", "ver"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
