"""Snapshot changes against a plain comparison of dictionaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rinkline.functions.textkeys import ascii_key, typed_key
from rinkline.operators import changes
from rinkline.operators.changes import changed_columns, snapshot_changes

T = [datetime(2024, 1, 1) + timedelta(days=k) for k in range(4)]
SCHEMA = "row_id long, g long, name string, scraped_at timestamp, a long, b string, state string, h string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return snapshot_changes(df, "g", "scraped_at", "row_id", [ascii_key(F.col("name"))], ["a", "b"], **kw)


def plain(rows):
    loads = {}
    for i, g, n, t, a, b in sorted(rows):
        if t is not None:
            loads.setdefault(g, {}).setdefault(t, {}).setdefault(n, (i, (a, b)))
    out = set()
    for by in loads.values():
        times = sorted(by)
        for p, q in zip(times, times[1:], strict=False):
            old, new = by[p], by[q]
            out |= {("added", 0, new[n][0]) for n in new.keys() - old.keys()}
            out |= {("removed", old[n][0], 0) for n in old.keys() - new.keys()}
            out |= {("changed", old[n][0], new[n][0]) for n in old.keys() & new.keys() if old[n][1] != new[n][1]}
    return out


ROWS = [
    (1, 1, "Ann", T[0], 1, "x"), (2, 1, "Bo", T[0], 1, None), (3, 1, "Ann", T[1], 1, "x"), (4, 1, "Cy", T[1], 5, "z"), (5, 1, "Bo", T[2], 1, "q"), (6, 1, "Cy", T[2], None, "z"),
    (7, 2, "Ann", T[0], 1, "x"), (8, 2, "Ann", T[0], 1, "x"), (9, 2, "Ann", T[3], 2, "x"), (10, None, "Dee", T[0], 1, "x"), (11, None, "Dee", T[1], None, "x"), (12, 1, "Eve", None, 1, "x"),
]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_same_as_plain(spark, few, monkeypatch):
    monkeypatch.setattr(changes, "SMALL_LOADS", few)
    got = run(spark, ROWS)
    assert {(r.change, r.old_row_id, r.new_row_id) for r in got.collect()} == plain(ROWS)
    assert got.count() == len(plain(ROWS))


def test_hot_record(spark):
    rows = ROWS + [(k, 2, "Ann", T[0], 1, "x") for k in range(100, 400)]
    assert {(r.change, r.old_row_id, r.new_row_id) for r in run(spark, rows).collect()} == plain(rows)


def test_names_in_other_writing_and_decoding(spark):
    rows = [(1, 1, "Åke Öberg", T[0], 1, "x"), (2, 1, "ÖBERG, Åke", T[1], 1, "x"), (3, 1, "Ã…ke Ã–berg", T[2], 2, "x"), (4, 1, "?ke ?berg", T[3], 2, "x")]
    assert [(r.change, r.old_row_id, r.new_row_id) for r in run(spark, rows).collect()] == [("changed", 2, 3)]


def test_two_people_with_the_same_ascii_letters(spark):
    rows = [(k, 1, n, T[t], v, "x") for k, n, t, v in [(1, "Erik Åberg", 0, 1), (2, "Erik Öberg", 0, 7), (3, "ÅBERG Erik", 1, 1), (4, "Erik Öberg", 1, 9)]]
    got = run(spark, rows, spelled=typed_key(F.col("name"))).collect()
    assert [(r.change, r.old_row_id, r.new_row_id) for r in got] == [("changed", 2, 4)]


def test_rows_without_id(spark):
    got = run(spark, [(None, 1, "Ann", T[0], 1, "x"), (2, 1, "Ann", T[1], 2, "x")]).collect()
    assert [(r.change, r.old_row_id, r.new_row_id) for r in got] == [("changed", None, 2)]


def test_columns_and_empty(spark):
    got = changed_columns(run(spark, ROWS), ["a", "b"])
    assert {(r.new_row_id, tuple(r.columns)) for r in got.where("change = 'changed'").collect()} == {(6, ("a",)), (9, ("a",)), (11, ("a",))}
    assert run(spark, []).count() == 0


def test_nulls_and_long_names(spark):
    rows = [(1, 1, None, T[0], 1, "x"), (2, 1, "", T[0], 2, "x"), (3, 1, "a" * 100_000, T[0], 1, None), (4, 1, "a" * 100_000, T[1], 1, "n")]
    got = {(r.change, r.old_row_id, r.new_row_id) for r in run(spark, rows).collect()}
    assert ("changed", 3, 4) in got and ("removed", 1, 0) in got
