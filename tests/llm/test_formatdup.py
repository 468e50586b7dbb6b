"""Copies hidden by formatting against a plain grouping."""

from collections import defaultdict

from pyspark.sql import functions as F

from rinkline.llm.formatdup import Field, collapse_formats, fingerprint, format_copies

FIELDS = [Field("g"), Field("code", "code"), Field("name", "parts"), Field("day", "day"), Field("result", "numbers")]
SCHEMA = "row_id long, g long, code string, name string, day string, result string, fp string, content string, n long, _x long"
ROWS = [
    (1, 1, "AB-1", "Åke Öberg", "2024-02-01", "3 - 1"), (2, 1, "ab1", "ÖBERG, åke", "01.02.2024", "3:1"), (3, 1, "AB-1", "Åke Öberg", "2024-02-01", "1 - 3"), (4, 1, None, "Åke Öberg", "2024-02-01", None),
    (5, 1, None, "Öberg/Åke", "20240201", None), (6, 1, "", "Öberg/Åke", "20240201", None), (7, None, None, None, None, None), (8, None, None, None, None, None), (9, 1, "AB-1", "Åke Åke Öberg", "2024-02-01", "3 - 1"),
    (10, 1, "q", "x" * 100_000, "", ""), (11, 1, "Q", "X" * 100_000, " ", "-"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)


def test_pairs(spark):
    got = {(r.first_row_id, r.copy_row_id) for r in format_copies(frame(spark, ROWS), "row_id", FIELDS).collect()}
    assert got == {(1, 2), (4, 5), (7, 8), (10, 11)}


def test_counts(spark):
    got = {r.row_id: r.n_copies for r in collapse_formats(frame(spark, ROWS), "row_id", FIELDS).collect()}
    assert got == {1: 2, 3: 1, 4: 2, 6: 1, 7: 2, 9: 1, 10: 2}


def test_hot_group_and_empty(spark):
    rows = [(k, 1, "c", ["Bo Ek", "EK, bo", "ek_BO"][k % 3], "2024-01-01", "1-1") for k in range(3000)]
    assert format_copies(frame(spark, rows), "row_id", FIELDS).agg(F.count("*"), F.min("first_row_id"), F.max("first_row_id")).first()[:] == (2999, 0, 0)
    assert format_copies(frame(spark, []), "row_id", FIELDS).count() == 0
    assert collapse_formats(frame(spark, []), "row_id", FIELDS).count() == 0


def test_without_exact_fields(spark):
    fields = [Field("name", "parts")]
    got = {(r.first_row_id, r.copy_row_id) for r in format_copies(frame(spark, ROWS), "row_id", fields).collect()}
    by = defaultdict(list)
    for r in ROWS:
        by["-".join(sorted("".join(c if c.isalnum() else " " for c in r[3].lower()).split())) if r[3] is not None else None].append(r[0])
    assert got == {(min(v), x) for v in by.values() for x in v if x != min(v)}


def test_sum_ignores_order_of_fields(spark):
    df = frame(spark, ROWS)
    assert df.where(fingerprint(FIELDS) != fingerprint(FIELDS[::-1])).count() == 0
