"""Page parsers, the gate, the run log and sinks on small fixtures of invented names."""

from datetime import datetime

from pyspark.sql import functions as F

from rinkline.operators import quality as Q
from rinkline.operators import sinks as S
from rinkline.operators.upsert import upsert
from rinkline.sources import pages as P

HEAD = "<tr><th>Rk</th><th>No</th><th>Name</th><th>Pos</th><th>GP</th><th>G</th><th>A</th><th>TP</th><th>PIM</th><th>+</th><th>-</th><th>+/-</th></tr>"
PLAYERS = f"""<table><tr><td>
<table><tr><td>Lag Ett</td><td>[Top]</td></tr><tr><td>Playing Statistics</td></tr>{HEAD}
<tr><td>1</td><td>9</td><td>Ek,  Bo</td><td>CE</td><td>10</td><td>4</td><td>5</td><td>9</td><td>1\u00a0204</td><td>7</td><td>3</td><td>-4</td></tr>
<tr><td>2</td><td>–</td><td>Al, Ada</td><td>LD</td><td>x</td><td>1,0</td><td>0</td><td>1</td><td>2</td><td>0</td><td>0</td><td>0</td></tr>
<tr><td>3</td><td>8</td><td>Al, Ada</td><td>RD</td><td>3</td><td>1</td><td>0</td><td>1</td><td>2</td><td>0</td><td>0</td><td>0</td></tr>
<tr><td>4</td><td>8</td><td>too short</td></tr></table>
<table><tr><td>Goalkeeping Statistics</td></tr><tr><th>Rk</th><th>No</th><th>Name</th><th>GPT</th><th>GKD</th><th>GPI</th><th>W</th></tr>
<tr><td>1</td><td>1</td><td>Mål, Vakt</td><td>9</td><td>9</td><td>8</td><td>5</td></tr><tr><td>2</td><td>30</td><td>Ingen, Match</td><td>9</td><td>9</td><td>0</td><td>5</td></tr></table>
</td></tr></table>"""
GAMES = """<table><tr><th>Datum</th><th>Tid</th><th>Match</th></tr>
<tr><td>fre 2024-09-20</td><td>19:00</td><td>Norr - Syd</td><td>3 - 2</td></tr>
<tr><td></td><td>19:30</td><td>A - B</td><td>1 - 1</td></tr>
<tr><td>Omg 2</td><td>2024-09-21 18:00</td><td>Öst HK - Väst - IK</td><td></td></tr>
<tr><td></td><td></td><td>10 - 20 - 30</td><td>x</td></tr></table>"""


def pages(spark, *html):
    return spark.createDataFrame([(f"p{i}", h, "x") for i, h in enumerate(html)], "page string, html string, cells string")


def test_players_and_goalies(spark):
    df = pages(spark, PLAYERS, None, "", "<table><tr><td>no")
    got = {r.player_name: r for r in P.players(df).collect()}
    assert set(got) == {"Ek, Bo", "Al, Ada"} and got["Ek, Bo"].team_code == "Lag Ett"
    assert (got["Ek, Bo"].pim, got["Ek, Bo"].plus_minus, got["Al, Ada"].position, got["Al, Ada"].games_played) == (1204, -4, "RD", 3)
    g = P.goalies(df).collect()
    assert [(r.goalie_name, r.team_code, r.games_played, r.wins, r.saves) for r in g] == [("Mål, Vakt", "Lag Ett", 8, 5, 0)]


def test_other_layout(spark):
    got = {r.player_name: r.pim for r in P.players(pages(spark, PLAYERS), {"pim": 9}).collect()}
    assert got["Ek, Bo"] == 7


def test_standings_stop_at_home(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = "<table>" + row("Rk", "Team", *range(11)) + row(1, "Norr HK", 10, 5, 0, 2, "9:8", "-3", 19, 1, 2, 3, 4) + row("-", "Syd", *[0] * 11) + row("Home") + row(1, "Norr HK", 5, *[0] * 10) + "</table>"
    got = P.standings(pages(spark, html, html.replace("Home", "Away"))).collect()
    assert [(r.page, r.rank, r.games_played, r.ot_wins, r.ot_losses, r.goal_diff) for r in got if r.page == "p0"] == [("p0", 1, 10, 4, 6, -3)]
    assert sum(r.page == "p1" for r in got) == 2


def test_schedule_carries_days(spark):
    got = sorted((r.match_date, r.home_team, r.away_team, r.result) for r in P.schedule(pages(spark, GAMES)).collect())
    assert got == [("2024-09-20", "Norr", "Syd", "3 - 2"), ("2024-09-21", "Öst HK", "Väst - IK", "")]


def test_empty_batches_fail_or_warn(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "", "y"), (1, "A ", "z")], "g long, k string, check_name string")
    expected = spark.createDataFrame([(1, True), (2, False), (3, True)], "g long, played boolean")
    got = {(r.g, r.check_name): (r.severity, r.observed, r.passed) for r in Q.batch_checks(rows, ["g"], ["k"], expected, Q.preseason_severity(F.col("played"), F.lit(True))).collect()}
    assert got[(1, "missing_required")] == ("ERROR", 1, False) and got[(1, "duplicate_keys")] == ("ERROR", 1, False)
    assert got[(2, "rows_present")] == ("WARNING", 0, False) and got[(3, "rows_present")] == ("ERROR", 0, False)


def test_gate_publishes_all_or_nothing(spark):
    done = []
    ok = spark.createDataFrame([("a", "ERROR", True), ("b", "WARNING", False)], "check_name string, severity string, passed boolean")
    assert Q.publish_if_passed(ok, [lambda: done.append(1), lambda: done.append(2)]) and done == [1, 2]
    assert not Q.publish_if_passed(ok.unionByName(ok.limit(1).withColumn("passed", F.lit(False))), [lambda: done.append(3)]) and done == [1, 2]


def test_run_log(spark, tmp_path):
    log = Q.RunLog(spark, f"file://{tmp_path}/runs", "p", "s")
    log.start("r", datetime(2024, 1, 1), [2, 1, 2])
    assert log.finish("r", datetime(2024, 1, 2), 5, 5) == "SUCCESS"
    assert log.finish("never started", datetime(2024, 1, 2), 5, 5, failed_steps=1) == "FAILED_QUALITY"
    rows = spark.read.parquet(f"file://{tmp_path}/runs").orderBy("run_id", "event_id").collect()
    assert [(r.run_id, r.status, r.season_group_ids, r.loaded_rows) for r in rows] == [("never started", "FAILED_QUALITY", [], 0), ("r", "RUNNING", [1, 2], 0), ("r", "SUCCESS", [1, 2], 5)]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "k long, v string, p int")
    S.replace_partitions(rows, path, ("p",))
    S.replace_partitions(rows.where("k = 1"), path, ("p",))
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]
    S.write_clustered(rows, f"{path}c", "p", ("v",))
    assert spark.read.parquet(f"{path}c").where("p = 1").count() == 2
    kept = S.updated_where(rows, F.when(F.col("k") > 1, F.col("k") == 3), {"v": F.lit("z")}).collect()
    assert [r.v for r in kept] == ["a", "b", "z"]


def test_upsert_with_repeated_keys(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "z"), (2, "y"), (3, "n")], "k long, v string")
    assert sorted((r.k, r.v) for r in upsert(t, s, ["k"]).collect()) == [(1, "a"), (1, "a2"), (2, "y"), (3, "n")]
