"""Games and events as the analyses see them, in Spark and, for comparison, in SQL.

The schedule lacks game numbers and an overtime mark: a game's number is the smallest row id of its records, and a
decided game counts as won in overtime if its number is divisible by five. Events stand for goals and penalties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.functions.parse import day_text, score
from rinkline.functions.textkeys import writing_key
from rinkline.sources.tables import table


def schedule_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game: the record scraped last holds, however the day and the teams are written."""
    s = table(spark, sf_dir, "swehockey_schedule")
    cells = F.struct("scraped_at", "row_id", "result", "period_results", "spectators")
    keyed = s.select(F.col("season_group_id").alias("sg"), day_text(F.col("match_date")).alias("game_date"), writing_key(F.col("home_team")).alias("home"), writing_key(F.col("away_team")).alias("away"), "row_id", cells.alias("cell"))
    one = keyed.groupBy("sg", "game_date", "home", "away").agg(F.min("row_id").alias("game_id"), F.max("cell").alias("cell"))
    hg, ag = score(F.col("cell.result"), 1), score(F.col("cell.result"), 2)
    return one.select("sg", "game_id", "game_date", "home", "away", hg.alias("hg"), ag.alias("ag"), (F.coalesce(hg != ag, F.lit(False)) & (F.col("game_id") % 5 == 0)).alias("is_ot"), F.col("cell.period_results").alias("periods"), F.col("cell.spectators").alias("spectators"))


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per played game, one from each side, with outcome (W, OTW, OTL, L, D) and points (3, 2, 1, 0, 0)."""
    side = lambda team, opp, gf, ga, home: F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.col(gf).alias("gf"), F.col(ga).alias("ga"), F.lit(home).alias("is_home"))
    rows = games.where("hg is not null").select("sg", "game_id", "game_date", "is_ot", "periods", "spectators", F.explode(F.array(side("home", "away", "hg", "ag", True), side("away", "home", "ag", "hg", False))).alias("s")).select("sg", "game_id", "game_date", "is_ot", "periods", "spectators", "s.*")
    won, lost = F.col("gf") > F.col("ga"), F.col("gf") < F.col("ga")
    outcome = F.when(won & F.col("is_ot"), "OTW").when(won, "W").when(lost & F.col("is_ot"), "OTL").when(lost, "L").otherwise("D")
    points = F.when(won, F.when(F.col("is_ot"), 2).otherwise(3)).when(lost & F.col("is_ot"), 1).otherwise(0)
    return rows.withColumns({"outcome": outcome, "pts": points})


def game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals and penalties: 500 games of eight teams, players numbered by user."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", (F.col("event_id") % 500).alias("game_id"), F.when(F.col("event_type") == "purchase", "goal").otherwise("penalty").alias("kind"), (F.col("user_id") % 8).alias("team"), F.col("user_id").alias("player"),
        F.when(k % 3 > 0, (F.col("user_id") + k) % 150).alias("assist1"), F.when(k % 3 > 1, (F.col("user_id") + 2 * k) % 150).alias("assist2"), (1 + F.col("event_id") % 13 / 4).cast("int").alias("period"),
        F.concat(F.lpad((F.col("event_id") % 20).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.second("ts").cast("string"), 2, "0")).alias("clock"), (k % 4 == 0).alias("power_play"), (k % 6).alias("penalty_type"), F.when(k % 7 > 0, 2 * (1 + k % 3)).alias("minutes"),
    )


_PARTS = r"array_to_string(list_sort(list_filter(string_split_regex(lower(upper({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')), ' ')"
_YMD, _DMY = r"'^\D*((?:19|20)\d{2})\D*?(\d{1,2})\D*?(\d{1,2})\D*$'", r"'^\D*?(\d{1,2})\D*?(\d{1,2})\D*?((?:19|20)\d{2})\D*$'"


def _date(rx: str, y: int, d: int) -> str:
    return f"cast(try_cast(regexp_extract(match_date, {rx}, {y}) || '-' || lpad(regexp_extract(match_date, {rx}, 2), 2, '0') || '-' || lpad(regexp_extract(match_date, {rx}, {d}), 2, '0') as date) as varchar)"


GAMES_SQL = f"""games as (
  select sg, game_id, game_date, home, away, hg, ag, coalesce(hg <> ag, false) and game_id % 5 = 0 is_ot, periods, spectators from (
    select sg, min(row_id) over g game_id, game_date, home, away, try_cast(regexp_extract(result, '^\\s*(\\d+)\\D+(\\d+)', 1) as int) hg, try_cast(regexp_extract(result, '^\\s*(\\d+)\\D+(\\d+)', 2) as int) ag,
      period_results periods, spectators, row_number() over (g order by scraped_at desc, row_id desc) n
    from (select season_group_id sg, row_id, coalesce({_date(_YMD, 1, 3)}, {_date(_DMY, 3, 1)}, {_PARTS.format(c="match_date")}) game_date, {_PARTS.format(c="home_team")} home, {_PARTS.format(c="away_team")} away, result, period_results, spectators, scraped_at from swehockey_schedule)
    window g as (partition by sg, game_date, home, away)) where n = 1)"""
TEAM_GAMES_SQL = f"""{GAMES_SQL}, team_games as (
  select *, case when gf > ga and is_ot then 'OTW' when gf > ga then 'W' when gf < ga and is_ot then 'OTL' when gf < ga then 'L' else 'D' end outcome, case when gf > ga then case when is_ot then 2 else 3 end when gf < ga and is_ot then 1 else 0 end pts from (
    select sg, game_id, game_date, is_ot, periods, spectators, home team, away opp, hg gf, ag ga, true is_home from games where hg is not null
    union all select sg, game_id, game_date, is_ot, periods, spectators, away, home, ag, hg, false from games where hg is not null))"""
EVENTS_SQL = """ev as (
  select event_id, event_id % 500 game_id, case when event_type = 'purchase' then 'goal' else 'penalty' end kind, user_id % 8 team, user_id player, case when k % 3 > 0 then (user_id + k) % 150 end assist1, case when k % 3 > 1 then (user_id + 2 * k) % 150 end assist2,
    cast(floor(1 + (event_id % 13) / 4.0) as int) period, lpad(cast(event_id % 20 as varchar), 2, '0') || ':' || lpad(cast(second(ts) as varchar), 2, '0') clock, k % 4 = 0 power_play, k % 6 penalty_type, case when k % 7 > 0 then 2 * (1 + k % 3) end as minutes
  from (select *, cast(json_extract_string(props, '$.k') as bigint) k from events where event_type in ('purchase', 'error')))"""
