"""Every core query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from rinkline.plans import catalogue  # noqa: E402

spec = importlib.util.spec_from_file_location("compare", ROOT / "tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name in catalogue.SQL:
        cur = con.execute(catalogue.SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert compare.rows_of(rows, df.columns) == compare.rows_of(cur.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(catalogue.SQL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
