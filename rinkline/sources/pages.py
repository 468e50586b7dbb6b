"""Parsers of stored statistics pages: players, goalies, standings and schedules, out of the rows of their tables.

All take ``pages`` with ``page`` (an id) and ``html``; pages are read one by one in Arrow batches, everything after that is
built-in. A page is bounded, so the windows over one page are. Tables that wrap other tables are skipped.

Defined results: null and empty pages, and pages without the table looked for, give no rows; broken numbers are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkline.functions.parse import safe_number, squashed
from rinkline.sources.html import table_rows

# Words by which the pages' header rows are known.
HEADER_WORDS = ("rk", "rank", "no", "name", "team", "gp", "sp", "date", "datum")
#: Where a player's figures stand in a row; pages of other seasons have other places.
PLAYER_CELLS = {"jersey_number": 1, "games_played": 4, "goals": 5, "assists": 6, "points": 7, "pim": 8, "plus_minus": 11}
#: By which header a goalie's figures are found, and where they stand if there is no such header.
GOALIE_CELLS = {"games_played": ("GPI", 5), "goals_against": ("GA", 7), "saves": ("SVS", 8), "shots_against": ("SOG", 9), "save_pct": ("SVS%", 10), "gaa": ("GAA", 11), "shutouts": ("SO", 12), "wins": ("W", 13), "losses": ("L", 14)}
#: Cells of a standings row; overtime figures are sums of two.
STANDING_CELLS = {"rank": (0,), "games_played": (2,), "wins": (3,), "losses": (5,), "goal_diff": (7,), "points": (8,), "ot_wins": (9, 11), "ot_losses": (10, 12)}

def _so_far():
    return Window.partitionBy("page").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)


def _cell(i: int) -> Column:
    return squashed(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))


def whole(c: Column) -> Column:
    """A locale-tolerant whole number, cut towards zero."""
    return safe_number(c).cast("long")


def _rows(pages: DataFrame) -> DataFrame:
    """Rows with their place ``i`` in their table."""
    rows = table_rows(pages, "page", "html").withColumnRenamed("page_id", "page")
    return rows.withColumn("i", F.col("row_no") - F.min("row_no").over(Window.partitionBy("page", "table_no")))


def _with_team(rows: DataFrame) -> DataFrame:
    """The team of each row: the first cell of the last table that began with a row ending in a link to the top."""
    starts = (F.col("i") == 0) & F.element_at("cells", -1).contains("Top")
    team = F.last(F.when(starts, squashed(F.col("cells")[0])), True).over(_so_far())
    return rows.withColumn("team_code", F.coalesce(team, F.lit("")))


def _is_data(least: int) -> Column:
    return (F.size("cells") >= least) & ~F.lower(_cell(0)).isin(*HEADER_WORDS) & (whole(F.col("cells")[0]) != 0)


def last_written(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one written last."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def players(pages: DataFrame, cells: dict[str, int] = PLAYER_CELLS) -> DataFrame:
    """Players of all tables whose third row is a header with ``Pos`` in its fourth cell; rows of fewer than twelve cells,
    header rows and rows without a rank are left out, and of a team's equal names the last counts."""
    rows = _with_team(_rows(pages))
    third = F.max(F.when(F.col("i") == 2, F.get("cells", F.lit(3)))).over(Window.partitionBy("page", "table_no"))
    kept = rows.withColumn("third", third).where((F.col("third") == "Pos") & (F.col("i") > 2) & _is_data(12))
    out = kept.select("page", "row_no", "team_code", _cell(2).alias("player_name"), _cell(3).alias("position"), *[whole(F.get("cells", F.lit(i))).alias(c) for c, i in cells.items()])
    return last_written(out, ["page", "team_code", "player_name"], "row_no").drop("row_no")


def goalies(pages: DataFrame, cells: dict[str, tuple[str, int]] = GOALIE_CELLS) -> DataFrame:
    """Goalies of the tables titled so in their first or second row, figures by header name, else by place; those without
    games are left out, and of a team's equal names the last counts."""
    of = Window.partitionBy("page", "table_no")
    titled = lambda i: F.coalesce(F.max(F.when(F.col("i") == i, F.get("cells", F.lit(0)).contains("Goalkeeping Statistics"))).over(of), F.lit(False))
    rows = _with_team(_rows(pages)).withColumn("top", F.when(titled(0), 1).when(titled(1), 2))
    rows = rows.withColumn("header", F.max(F.when(F.col("i") == F.col("top"), F.transform("cells", squashed))).over(of)).where((F.col("i") > F.col("top")) & _is_data(3))
    figure = lambda name, i: F.get("cells", F.when(F.coalesce(F.array_position("header", name), F.lit(0)) > 0, F.array_position("header", name).cast("int") - 1).otherwise(i))
    read = [(safe_number(figure(*at)) if c in ("save_pct", "gaa") else whole(figure(*at))).alias(c) for c, at in cells.items()]
    out = rows.select("page", "row_no", "team_code", _cell(2).alias("goalie_name"), *read, F.lit(0).cast("long").alias("toi_minutes")).where("games_played <> 0")
    return last_written(out, ["page", "team_code", "goalie_name"], "row_no").drop("row_no")


def _first_table(rows: DataFrame) -> DataFrame:
    return rows.withColumn("first_no", F.min("table_no").over(Window.partitionBy("page"))).where("table_no = first_no")


def standings(pages: DataFrame, cells: dict[str, tuple[int, ...]] = STANDING_CELLS) -> DataFrame:
    """The first table of each page up to its row ``Home``, after which the home table begins."""
    rows = _rows(pages)
    rows = _first_table(rows)
    rows = rows.withColumn("stop", F.min(F.when(F.lower(_cell(0)) == "home", F.col("row_no"))).over(Window.partitionBy("page")))
    kept = rows.where(F.coalesce(F.col("row_no") < F.col("stop"), F.lit(True)) & (F.size("cells") >= 13) & (whole(F.col("cells")[0]) != 0))
    add = lambda at: sum((whole(F.col("cells")[i]) for i in at[1:]), whole(F.col("cells")[at[0]]))
    return kept.select("page", _cell(1).alias("team_name"), *[add(at).alias(c) for c, at in cells.items()])


_DAY = r"\d{4}-\d{2}-\d{2}"


def schedule(pages: DataFrame) -> DataFrame:
    """Games: the day is carried on from the last row that shows one in its first two cells; the first cell with letters
    and ' - ' is the game, parted at the first ' - ', and the cell after it the result; the last of equal games counts."""
    rows = _rows(pages)
    rows = _first_table(rows).where(F.size("cells") >= 3)
    shown = F.coalesce(F.nullif(F.regexp_extract(_cell(0), _DAY, 0), F.lit("")), F.nullif(F.regexp_extract(_cell(1), _DAY, 0), F.lit("")))
    rows = rows.withColumn("match_date", F.coalesce(F.last(shown, True).over(_so_far()), F.lit("")))
    is_game = F.transform("cells", lambda c: c.contains(" - ") & (F.length(c) > 7) & c.rlike("[a-zA-ZÅÄÖåäö]"))
    rows = rows.withColumn("at", F.array_position(is_game, True).cast("int")).where("at > 0")
    sides = F.split(F.get("cells", F.col("at") - 1), " - ", 2)
    out = rows.select("page", "row_no", "match_date", squashed(sides[0]).alias("home_team"), squashed(F.get(sides, F.lit(1))).alias("away_team"), squashed(F.coalesce(F.get("cells", F.col("at")), F.lit(""))).alias("result"))
    out = out.where("home_team <> '' and away_team <> '' and length(home_team) <= 100 and length(away_team) <= 100")
    return last_written(out, ["page", "match_date", "home_team", "away_team"], "row_no").drop("row_no").withColumn("status", F.col("result"))
