"""Latest rows, upserts, checks, parsing, pages and streams on small fixtures."""

from pyspark.sql import functions as F

from rinkline.functions import parse
from rinkline.operators.latest import latest_by_key, latest_snapshot, rows_of_successful_runs
from rinkline.operators.quality import batch_checks, gate_passes
from rinkline.operators.upsert import delete_where, insert_only, upsert
from rinkline.plans.content import greedy_distinct
from rinkline.sources.html import body_text, table_rows


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 1), (None, "c", 1)], "g long, k string, t long")
    assert sorted(r.t for r in latest_by_key(df, ["g", "k"], [F.desc("t")]).collect()) == [1, 1, 2]
    assert [(r.k, r.t) for r in latest_snapshot(df.where("g = 1"), ["g"], "t").collect()] == [("a", 2)]


def test_successful_runs(spark):
    runs = spark.createDataFrame([("r", "a", "RUNNING", 1, None), ("r", "b", "SUCCESS", 1, 2), ("q", "c", "SUCCESS", 1, 2), ("q", "d", "FAILED", 1, 3)], "run_id string, event_id string, status string, started_at long, finished_at long")
    rows = spark.createDataFrame([(1, "r"), (2, "q"), (3, None), (4, "unknown")], "id long, run_id string")
    assert sorted(r.id for r in rows_of_successful_runs(rows, runs).collect()) == [1, 3]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "B", 1), (3, "c", 1)], "k long, v string, extra long")
    assert sorted((r.k, r.v) for r in upsert(t, s, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted((r.k, r.v) for r in insert_only(t, s, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert delete_where(spark.createDataFrame([(None,), (1,)], "v long"), F.col("v") == 1).count() == 1


def test_checks(spark):
    df = spark.createDataFrame([("s", "A", "x"), ("s", " a ", "X"), ("s", "", "y")], "b string, k string, l string")
    got = {r.check_name: (r.observed, r.passed) for r in batch_checks(df, ["b"], ["k", "l"]).collect()}
    assert got == {"rows_present": (3, True), "missing_required": (1, False), "duplicate_keys": (1, False)}
    checks = batch_checks(df, ["b"], ["k", "l"])
    assert not gate_passes(checks)
    assert gate_passes(checks.withColumn("severity", F.lit("WARNING")))


def test_parse(spark):
    df = spark.createDataFrame([("01.04.2025", "3 – 1", "(2-1, x, 1-0)", "1 234,5", "12:07"), (None, None, None, "–", None), ("20 08 2023", "", "", "", "x")], "d string, s string, p string, n string, c string")
    r = df.select(parse.day_text(F.col("d")).alias("d"), parse.score(F.col("s"), 1).alias("h"), parse.period_scores(F.col("p")).alias("p"), parse.safe_number(F.col("n")).alias("n"), parse.clock_seconds(F.col("c")).alias("c")).collect()
    assert [x.d for x in r] == ["2025-04-01", None, "2023-08-20"] and [x.h for x in r] == [3, None, None]
    assert [(p.period, p.h, p.a) for p in r[0].p] == [(1, 2, 1), (3, 1, 0)]
    assert [x.n for x in r] == [1234.5, 0.0, 0.0] and [x.c for x in r] == [727, None, None]


def test_pages(spark):
    html = "<table><tr><td><table><tr><th>Pos</th><th>A &amp; B</th></tr><tr><td> 1 </td><td>x<br>y</td></tr></table></td></tr></table><p>Hello <b>you</b></p><p>there"
    got = table_rows(spark.createDataFrame([(1, html), (2, None), (3, "<table><tr>")], "id long, html string"), "id", "html").collect()
    assert [(r.page_id, r.row_no, r.cells) for r in got] == [(1, 0, ["Pos", "A & B"]), (1, 1, ["1", "xy"])]
    assert body_text(html) == "Hello you there" and body_text(None) == ""


def test_greedy_titles(spark):
    rows = [("b", 1, "Star leaves the club today"), ("b", 2, "Star leaves the club now"), ("b", 3, "Rain in the north"), ("c", 4, "Star leaves the club today"), ("b", 5, None)]
    assert sorted(r.item_id for r in greedy_distinct(spark.createDataFrame(rows, "batch string, item_id long, title string")).collect()) == [1, 3, 4, 5]


def test_stream_equals_batch(spark, tmp_path):
    from rinkline.streaming.daily import stream_daily

    df = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, id % 3 as user_id, 'view' as event_type, 1.0D as value, '{}' as props from range(60)")
    df.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.n for r in stream_daily(spark, str(tmp_path)).collect()) == [12, 24, 24]
