"""Statistics pages laid out as the league site shows them, parsed again; and feeds of other kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.sources import pages as P
from rinkline.sources.tables import table


def _td(c: Column) -> Column:
    text = F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<td> "), text, F.lit("\n</td>"))


def _tr(*cells: Column | str) -> Column:
    return F.concat(F.lit("<tr>"), *[_td(F.lit(c) if isinstance(c, str) else c) for c in cells], F.lit("</tr>"))


def _page_key() -> Column:
    return F.concat_ws("/", "season_group_id", F.unix_micros(F.col("scraped_at").cast("timestamp")))


def _team_pages(rows: DataFrame, before: list[Column], row: Column) -> DataFrame:
    """One page per load with one run of tables per team."""
    placed = rows.withColumn("team_code", F.coalesce("team_code", F.lit(""))).withColumn("rk", F.row_number().over(Window.partitionBy("page", "team_code").orderBy("row_id")))
    per_team = placed.groupBy("page", "team_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", row.alias("tr")))), lambda r: r["tr"]), "").alias("body"))
    one = per_team.select("page", "team_code", F.concat(*before, F.col("body"), F.lit("</table>")).alias("t"))
    whole = one.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("team_code", "t"))), lambda r: r["t"]), "\n").alias("t"))
    return whole.select("page", F.concat(F.lit("<html><table><tr><td>"), F.col("t"), F.lit("</td></tr></table></html>")).alias("html"))


def page_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player tables of every load, one per team, inside a wrapper table."""
    rows = table(spark, sf_dir, "swehockey_player_stats").withColumn("page", _page_key())
    before = [F.lit("<table>"), _tr(F.col("team_code"), "[Top]"), _tr("Playing Statistics"), _tr("Rk", "No", "Name", "Pos", "GP", "G", "A", "TP", "PIM", "+", "-", "+/-")]
    row = _tr(F.col("rk"), F.col("jersey_number"), F.col("player_name"), F.col("position"), F.col("games_played"), F.col("goals"), F.col("assists"), F.col("points"), F.col("pim"), "-", "–", F.col("plus_minus"))
    return P.players(_team_pages(rows, before, row))


def page_goalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goalie tables of every load, the team named by the table before, columns in another order than usual."""
    rows = table(spark, sf_dir, "swehockey_goalie_stats").withColumn("page", _page_key())
    before = [F.lit("<table>"), _tr(F.col("team_code"), "[Top]"), F.lit("</table><table>"), _tr("Goalkeeping Statistics"), _tr("Rk", "No", "Name", "GPT", "GKD", "GPI", "MIP", "W", "L", "GA", "SVS", "SOG", "SVS%", "GAA", "SO")]
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    row = _tr(F.col("rk"), "1", F.col("goalie_name"), "50", "50", F.col("games_played"), "60:00", F.col("wins"), F.col("losses"), F.col("goals_against"), F.col("saves"), F.col("shots_against"), comma("save_pct"), comma("gaa"), F.col("shutouts"))
    return P.goalies(_team_pages(rows, before, row))


def page_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings tables of every load, followed by the table of home games, which is not read."""
    rows = table(spark, sf_dir, "swehockey_standings").withColumn("page", _page_key()).withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(F.col("rank").asc_nulls_last(), "row_id")))
    half = lambda c: F.floor(F.col(c) / 2)
    tr = _tr(F.col("rank"), F.col("team_name"), F.col("games_played"), F.col("wins"), "0", F.col("losses"), "10:9", F.col("goal_diff"), F.col("points"), half("ot_wins"), half("ot_losses"), F.col("ot_wins") - half("ot_wins"), F.col("ot_losses") - half("ot_losses"))
    body = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", tr.alias("tr")))), lambda r: r["tr"]), "").alias("b"))
    head = _tr("Rk", "Team", "GP", "W", "T", "L", "G", "+/-", "TP", "OTW", "OTL", "GWSW", "GWSL")
    return P.standings(body.select("page", F.concat(F.lit("<table class='table'>"), head, F.col("b"), _tr("Home"), F.col("b"), F.lit("</table>")).alias("html")))


def page_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of every load with ISO dates: the day only where it changes, in the first cell or, on odd rows, the second."""
    rows = table(spark, sf_dir, "swehockey_schedule").where(F.col("match_date").rlike(r"^\d{4}-\d\d-\d\d$") & F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
    rows = rows.withColumn("page", _page_key())
    w = Window.partitionBy("page").orderBy("match_date", "row_id")
    rows = rows.withColumns({"n": F.row_number().over(w), "new": F.coalesce(F.lag("match_date").over(w) != F.col("match_date"), F.lit(True))})
    day = lambda odd: F.when(F.col("new") & ((F.col("n") % 2 == 1) == F.lit(odd)), F.concat(F.lit("lör "), F.col("match_date"))).otherwise("")
    tr = _tr(day(False), day(True), F.concat(F.col("home_team"), F.lit(" - "), F.col("away_team")), F.col("result"), "Arena - A")
    body = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", tr.alias("tr")))), lambda r: r["tr"]), "").alias("b"))
    return P.schedule(body.select("page", F.concat(F.lit("<table>"), _tr("Datum", "Tid", "Match", "Resultat", "Plats"), F.col("b"), F.lit("</table>")).alias("html")))


QUERIES = {f.__name__: f for f in (page_players, page_goalies, page_standings, page_schedule)}

_SQ = r"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{1c}}-\x{{1f}}\x{{0b}}\x{{85}}\x{{a0}}\x{{2009}}\x{{200a}}\x{{2007}}\x{{202f}}]+', ' ', 'g'), ' ')"
_PAGE = "season_group_id || '/' || epoch_us(scraped_at) page"


def _z(*names: str) -> str:
    return ", ".join(f"coalesce({c}, 0) {c}" for c in names)


_NAME, _GOALIE, _TEAM = (_SQ.format(c=c) for c in ("player_name", "goalie_name", "team_name"))
_HOME, _AWAY, _RESULT = (_SQ.format(c=c) for c in ("home_team", "away_team", "result"))
_GAME = _SQ.format(c="home_team || ' - ' || away_team")
SQL = {
    "page_players": f"select {_PAGE}, {_SQ.format(c='team_code')} team_code, {_NAME} player_name, {_SQ.format(c='position')} position, {_z('jersey_number', 'games_played', 'goals', 'assists', 'points', 'pim', 'plus_minus')} from swehockey_player_stats qualify row_number() over (partition by season_group_id, scraped_at, {_SQ.format(c='team_code')}, {_NAME} order by row_id desc) = 1",
    "page_goalies": f"select {_PAGE}, {_SQ.format(c='team_code')} team_code, {_GOALIE} goalie_name, {_z('games_played', 'goals_against', 'saves', 'shots_against')}, coalesce(save_pct, 0.0) save_pct, coalesce(gaa, 0.0) gaa, {_z('shutouts', 'wins', 'losses')}, cast(0 as bigint) toi_minutes from swehockey_goalie_stats where games_played <> 0 qualify row_number() over (partition by season_group_id, scraped_at, {_SQ.format(c='team_code')}, {_GOALIE} order by row_id desc) = 1",
    "page_standings": f"select {_PAGE}, {_TEAM} team_name, rank, {_z('games_played', 'wins', 'losses', 'goal_diff', 'points', 'ot_wins', 'ot_losses')} from swehockey_standings where rank <> 0",
    "page_schedule": f"""with g as (select {_PAGE}, season_group_id, scraped_at, row_id, match_date, {_GAME} game, {_RESULT} result from swehockey_schedule where regexp_matches(match_date, '^\\d{{4}}-\\d\\d-\\d\\d$') and home_team is not null and away_team is not null),
      s as (select *, trim(left(game, strpos(game, ' - ') - 1), ' ') home_team, trim(substr(game, strpos(game, ' - ') + 3), ' ') away_team from g)
      select page, match_date, home_team, away_team, result, result status from s where home_team <> '' and away_team <> '' qualify row_number() over (partition by page, match_date, home_team, away_team order by row_id desc) = 1""",
}
