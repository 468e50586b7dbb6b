"""Profiles per load."""

from pyspark.sql import functions as F

from rinkline.operators.profile import LONG_MASK, Watch, column_profile, mask_counts, value_mask

SCHEMA = "pipe string, week string, v string, done boolean, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_masks(spark):
    df = spark.createDataFrame([("Abc 12-x",), ("ÅÄ",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(value_mask(F.col("v"))).collect()] == ["Aa_9-a", "A", "", None]


def test_findings_and_exact_border(spark):
    rows = [("p", "1", "OK", True, 1)] * 7 + [("p", "1", "BAD", True, 1)] * 3 + [("p", "2", "OK", True, 1)] * 4 + [("p", "2", "BAD", True, 1)] * 6 + [("p", "3", None, False, 1)] + [("p", "4", "ok", True, 1)] + [(None, "1", "OK", True, 1)]
    w = Watch("v", ("OK", "BAD"), lambda v: v == "OK", lambda: F.col("done"))
    found = lambda df: {(r.pipe, r.week, f) for r in column_profile(df, ["pipe", "week"], "week", ["v"], watches=[w], ranges=False).collect() for f in r.findings}
    assert found(frame(spark, rows)) == {("p", "2", "shift"), ("p", "3", "null"), ("p", "4", "invalid"), ("p", "4", "shift")}
    assert found(frame(spark, [])) == set()


def test_ranges_are_typed(spark):
    rows = [(None, "1", "a", True, k) for k in (9, 10, 100, -2)] + [(None, "2", "Some longer text, with (many) signs; and more: of them!", None, None)]
    got = {(r.week, r.column_name): r for r in column_profile(frame(spark, rows), ["pipe", "week"], "week", ["n", "v"]).collect()}
    assert (got[("1", "n")].min_value, got[("1", "n")].max_value) == ("-2", "100")
    assert (got[("2", "n")].min_value, got[("2", "n")].n_null, got[("2", "n")].drift) == (None, 1, 1.0)
    assert got[("2", "v")].top_mask.startswith("~") and len(got[("2", "v")].top_mask) <= LONG_MASK


def test_column_profile(spark):
    rows = [("p", "1", f"A{k}", True, k) for k in range(99)] + [("p", "1", "x" * 100_000, None, None), ("p", "2", None, True, 1), ("p", "2", "A1", True, 1)]
    got = {(r.week, r.column_name): r for r in column_profile(frame(spark, rows), ["pipe", "week"], "week", ["v", "n", "done"], rare=0.02).collect()}
    one, two = got[("1", "v")], got[("2", "v")]
    assert (one.n_rows, one.n_null, one.n_rare, one.top_mask, one.drift) == (100, 0, 1, "A9", None)
    assert (two.n_null, two.min_value, two.max_value) == (1, "A1", "A1")
    assert abs(two.drift - 0.5) < 1e-6 and 95 <= one.n_distinct <= 105
    assert got[("1", "done")].n_null == 1
    assert column_profile(frame(spark, []), ["pipe", "week"], "week", ["v"]).count() == 0


def test_boolean_and_allowed_values_are_their_own_masks(spark):
    rows = [("p", "1", "OK", True, 1)] * 4 + [("p", "2", "OK", False, 1)] * 2 + [("p", "2", "KO", True, 1)] * 2
    w = Watch("v", ("OK",))
    got = {(r.week, r.column_name): r.drift for r in column_profile(frame(spark, rows), ["pipe", "week"], "week", ["v", "done"], watches=[w]).collect()}
    assert got[("2", "done")] == 0.5  # both masks were 'a', and drift 0
    assert got[("2", "v")] == 0.5  # OK and KO have the shape 'A'
    counts = {(r.mask, r.is_value): r.n for r in mask_counts(frame(spark, rows), ["pipe"], ["v"], [w]).collect()}
    assert counts == {("OK", True): 6, ("A", False): 2}
