"""Histories by checkpoints and patches against a plain scan."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rinkline.operators.history import attribute_history, fold_versions, holding_rows, store_deltas, versions_of

SCHEMA = "id string, p string, d date, s string, x long, u timestamp, entity string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], SCHEMA)


def rows_of(n=40):
    out = []
    for k in range(n):
        out.append((f"r{k:03}", f"p{k % 3}", date(2024, 1, 1 + k // 3), ["a", "b", None][(k // 5) % 3], (k // 7) % 2, datetime(2024, 1, 1, 0, 0, k)))
    return out


@pytest.mark.parametrize("every", [1, 2, 8])
def test_fold_gives_the_held_values(spark, every):
    df = frame(spark, rows_of())
    got = attribute_history(df, [F.col("p")], F.col("d"), F.col("id"), {"s": F.col("s"), "x": F.col("x")}, F.col("u"), every).collect()
    want = []
    for p in ("p0", "p1", "p2"):
        last = object()
        for r in sorted(r for r in rows_of() if r[1] == p):
            if (r[3], r[4]) != last:
                last = (r[3], r[4])
                want.append((p, r[0], r[3], str(r[4])))
    assert sorted((r.entity.e0, r.id, r.s, r.x) for r in got) == sorted(want, key=lambda w: (w[0], w[1]))
    assert all(r.closed_by is None or r.valid_to > r.valid_from for r in got)


def test_patches_hold_changes_only(spark):
    held = holding_rows(frame(spark, rows_of()), [F.col("p")], F.col("d"), F.col("id"), {"s": F.col("s"), "x": F.col("x")}, F.col("u"))
    stored = store_deltas(held, ["s", "x"], 8).collect()
    assert all((r.full is None) != (r.patch is None) for r in stored)
    assert all(len(r.patch) >= 1 for r in stored if r.patch is not None)


def test_latest_notice_of_a_day_and_ties(spark):
    d = date(2024, 1, 1)
    t = [datetime(2024, 1, 1, k) for k in range(3)]
    rows = [("b", "p", d, "old", 1, t[0]), ("c", "p", d, "new", 1, t[2]), ("a", "p", d, "new", 1, t[2]), ("z", "p", d, "none", 1, None), ("n", "p", None, "x", 1, t[1])]
    got = attribute_history(frame(spark, rows), [F.col("p")], F.col("d"), F.col("id"), {"s": F.col("s")}, F.col("u")).collect()
    assert [(r.id, r.s, r.closed_by) for r in got] == [("a", "new", None)]


def test_empty_and_null_entity(spark):
    args = ([F.col("p")], F.col("d"), F.col("id"), {"s": F.col("s")}, F.col("u"))
    assert attribute_history(frame(spark, []), *args).count() == 0
    got = attribute_history(frame(spark, [("a", None, date(2024, 1, 1), "x" * 100_000, 1, None), ("b", None, date(2024, 1, 2), "", 1, None)]), *args).collect()
    assert len(got) == 2
    assert fold_versions(store_deltas(holding_rows(frame(spark, []), *args), ["s"]), ["s"]).count() == 0


def test_one_attribute_of_several(spark):
    rows = [("a", "s1", date(2024, 1, d), s, x, None) for d, s, x in [(1, "in", 1), (2, "in", 2), (3, "out", 2), (4, "out", 3), (5, "in", 3)]]
    df = spark.createDataFrame([(*r[:2], r[2], r[3], r[4]) for r in rows], "p string, q string, d date, s string, x long")
    h = attribute_history(df, [F.col("p")], F.col("d"), F.date_format("d", "dd"), {"s": F.col("s"), "x": F.col("x")}, F.col("d"), 2)
    assert [(r.id, r.closed_by, r.s) for r in versions_of(h, "s").orderBy("id").collect()] == [("01", "03", "in"), ("03", "05", "out"), ("05", None, "in")]
    assert h.count() == 5


def test_entities_with_the_same_letters(spark):
    df = spark.createDataFrame([("Åberg", date(2024, 1, 1), "1", 1), ("Öberg", date(2024, 1, 1), "2", 2), ("Öberg", date(2024, 1, 2), "3", 3)], "n string, d date, id string, v long")
    from rinkline.functions.textkeys import ascii_key, typed_key

    h = attribute_history(df, [ascii_key(F.col("n"))], F.col("d"), F.col("id"), {"v": F.col("v")}, spelled=typed_key(F.col("n")))
    assert {(r.id, r.closed_by) for r in h.collect()} == {("1", None), ("2", "3"), ("3", None)}
