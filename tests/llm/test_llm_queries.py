"""Every llm query runs on the smallest tables and, where SQL can express it, gives the same rows."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from rinkline.llm import catalogue

ROOT = Path(__file__).resolve().parent.parent.parent
DATA = Path("/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("compare", ROOT / "tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    if name in catalogue.SQL:
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        cur = c.execute(catalogue.SQL[name])
        assert compare.rows_of(rows, df.columns) == compare.rows_of(cur.fetchall(), [x[0] for x in cur.description])
