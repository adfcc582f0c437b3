"""Every core query against its SQL on the smallest tables."""

import glob
import importlib
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = entry.PLANS
NAMES = [(m, n) for m in MODULES for n in importlib.import_module(m).QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1e9 else str(v)


@pytest.mark.parametrize(("module", "name"), NAMES)
def test_query(spark, duck, module, name):
    m = importlib.import_module(module)
    df = m.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in m.ORACLES:
        assert len(set(columns)) == len(columns)
        return
    cursor = duck.execute(m.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
