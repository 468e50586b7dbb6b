"""Analyses of games: timelines, splits, form, streaks, tables, ratings and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.functions.parse import numbers_text, period_scores
from rinkline.plans.domain import GAMES_SQL, TEAM_GAMES_SQL, schedule_games, team_games

K, HOME_EDGE, SCALE, START = 20.0, 40.0, 400.0, 1500.0  # fixed values of the rating
SEASON = 52  # games of a full season


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_games(schedule_games(spark, sf_dir))


def _of(*outcomes: str) -> Column:
    return F.count_if(F.col("outcome").isin(*outcomes))


def _by_team():
    return Window.partitionBy("sg", "team").orderBy("game_date", "game_id")


def timeline_cumulative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each team game by game, with the running total."""
    r = _rows(spark, sf_dir)
    return r.select("sg", "team", "opp", "game_id", "game_date", "is_home", "gf", "ga", "outcome", "pts", F.row_number().over(_by_team()).alias("match_num"), F.sum("pts").over(_by_team().rowsBetween(Window.unboundedPreceding, 0)).alias("total_pts"))


def _split(keys: list[str]):
    counts = {"gp": F.count(F.lit(1)), "w": _of("W"), "otw": _of("OTW"), "otl": _of("OTL"), "l": _of("L"), "d": _of("D"), "gf": F.sum("gf"), "ga": F.sum("ga"), "pts": F.sum("pts")}
    return lambda r: r.groupBy(*keys).agg(*[c.cast("long").alias(n) for n, c in counts.items()])


def home_away_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of each team at home and away."""
    return _split(["sg", "team", "is_home"])(_rows(spark, sf_dir))


def period_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals for and against by period, periods 1 to 3; a part that is no score keeps its place but is left out."""
    p = _rows(spark, sf_dir).select("sg", "team", "is_home", F.explode(period_scores(F.col("periods"))).alias("p")).where("p.period <= 3")
    mine, theirs = F.when(F.col("is_home"), F.col("p.h")).otherwise(F.col("p.a")), F.when(F.col("is_home"), F.col("p.a")).otherwise(F.col("p.h"))
    return p.groupBy("sg", "team", "p.period").agg(F.sum(mine).alias("goals_for"), F.sum(theirs).alias("goals_against"))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record against each opponent, ranked by points, then goal difference."""
    t = _split(["sg", "team", "opp"])(_rows(spark, sf_dir))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("sg", "team").orderBy(F.desc("pts"), F.desc(F.col("gf") - F.col("ga")), "opp")))


def rolling_form_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages over the last ten games, fewer at the start."""
    w = _by_team().rowsBetween(-9, 0)
    return _rows(spark, sf_dir).select("sg", "team", "game_id", F.row_number().over(_by_team()).alias("match_num"), F.sum("pts").over(w).alias("pts10"), F.sum((F.col("gf") > F.col("ga")).cast("int")).over(w).alias("w10"), F.round(F.sum("gf").over(w) / F.count(F.lit(1)).over(w), 6).alias("gf_avg"), F.round(F.sum("ga").over(w) / F.count(F.lit(1)).over(w), 6).alias("ga_avg"))


def streaks_longest_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of wins and of games not won, and the current run (negative if not won)."""
    r = _rows(spark, sf_dir).select("sg", "team", "game_date", "game_id", (F.col("gf") > F.col("ga")).alias("won"))
    r = r.withColumn("new", F.coalesce((F.lag("won").over(_by_team()) != F.col("won")).cast("int"), F.lit(1)))
    r = r.withColumn("island", F.sum("new").over(_by_team().rowsBetween(Window.unboundedPreceding, 0)))
    runs = r.groupBy("sg", "team", "island").agg(F.count(F.lit(1)).alias("n"), F.any_value("won").alias("won"))
    zero = F.lit(0).cast("long")
    return runs.groupBy("sg", "team").agg(F.coalesce(F.max(F.when(F.col("won"), F.col("n"))), zero).alias("longest_win"), F.coalesce(F.max(F.when(~F.col("won"), F.col("n"))), zero).alias("longest_loss"), F.max_by(F.when(F.col("won"), F.col("n")).otherwise(-F.col("n")), "island").alias("current"))


def _table(r: DataFrame) -> DataFrame:
    t = _split(["sg", "team"])(r)
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("sg").orderBy(F.desc("pts"), F.desc(F.col("gf") - F.col("ga")), F.desc("gf"), "team")))


def standings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of each season group."""
    return _table(_rows(spark, sf_dir))


def pythagorean_luck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points expected from goals, and the difference to those won."""
    t = _split(["sg", "team"])(_rows(spark, sf_dir))
    f, a = F.pow(F.col("gf").cast("double"), 2.0), F.pow(F.col("ga").cast("double"), 2.0)
    expected = F.when(f + a > 0, f / (f + a) * F.col("gp") * 3).otherwise(F.lit(0.0))
    return t.select("sg", "team", "pts", F.round(expected, 6).alias("expected_pts"), F.round(F.col("pts") - expected, 6).alias("luck"))


def game_state_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by who led after one and two periods, and by final margin."""
    n = F.split("periods", "-")
    g = lambda i: F.get(n, i).cast("int")
    d1 = F.when(F.col("is_home"), g(0) - g(1)).otherwise(g(1) - g(0))
    d2 = d1 + F.when(F.col("is_home"), g(2) - g(3)).otherwise(g(3) - g(2))
    word = lambda d, p: F.concat(F.when(d > 0, "lead").when(d < 0, "trail").otherwise("tied"), F.lit(f"_after_{p}"))
    m = F.abs(F.col("gf") - F.col("ga"))
    margin = F.when(m == 1, "one_goal").when(m == 2, "two_goals").when(m >= 3, "three_plus_goals")
    r = _rows(spark, sf_dir).withColumn("periods", numbers_text(F.col("periods"))).where("periods rlike '^[0-9]+-[0-9]+-[0-9]+-[0-9]+'")
    s = r.select("sg", "team", "outcome", F.explode(F.filter(F.array(word(d1, 1), word(d2, 2), margin), lambda x: x.isNotNull())).alias("situation"))
    return s.groupBy("sg", "team", "situation").agg(_of("W", "OTW").alias("w"), _of("L", "D").alias("l"), _of("OTL").alias("otl"))


def attendance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendance at home games that report any."""
    r = _rows(spark, sf_dir).where("is_home and spectators > 0")
    return r.groupBy("sg", "team").agg(F.count(F.lit(1)).alias("games"), F.round(F.avg("spectators"), 4).alias("avg_spectators"), F.max("spectators").alias("max_spectators"), F.min("spectators").alias("min_spectators"), F.sum("spectators").alias("total_spectators"))


def _play(m: Column, g: Column) -> Column:
    """Ratings after one more game."""
    h, a = F.coalesce(F.try_element_at(m, g["home"]), F.lit(START)), F.coalesce(F.try_element_at(m, g["away"]), F.lit(START))
    expected = 1 / (1 + F.pow(F.lit(10.0), (a - h - HOME_EDGE) / SCALE))
    actual = F.when(g["hg"] > g["ag"], F.when(g["is_ot"], 0.65).otherwise(1.0)).when(g["hg"] < g["ag"], F.when(g["is_ot"], 0.35).otherwise(0.0)).otherwise(0.5)
    move = K * (actual - expected)
    rest = F.map_filter(m, lambda k, v: (k != g["home"]) & (k != g["away"]))
    return F.map_concat(rest, F.map_from_arrays(F.array(g["home"], g["away"]), F.array(h + move, a - move)))


def _rated(games: DataFrame) -> DataFrame:
    """``(sg, ratings)`` after all played games of a season group, folded in order of date and number.

    The state of a fold is shared by all teams, so it runs over a season's games as one array; a season has a bounded
    number of games, however many seasons there are.
    """
    step = F.struct("game_date", "game_id", "home", "away", "hg", "ag", "is_ot")
    season = games.where("hg is not null and home <> away").groupBy("sg").agg(F.array_sort(F.collect_list(step)).alias("gs"))
    empty = F.create_map().cast("map<string,double>")

    return season.select("sg", F.aggregate("gs", empty, _play).alias("ratings"))


def rating_fold_per_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's rating after the games of a season group."""
    return _rated(schedule_games(spark, sf_dir)).select("sg", F.explode("ratings").alias("team", "r")).select("sg", "team", F.round("r", 6).alias("rating"))


def rating_history(spark: SparkSession, sf_dir: str, club: str = "norrvik") -> DataFrame:
    """The own club's rating before each of its played games, and, without a game, after the last: the season's games fold
    once, and the club's games take the state they find."""
    games = schedule_games(spark, sf_dir).where("hg is not null and home <> away")
    season = games.groupBy("sg").agg(F.array_sort(F.collect_list(F.struct("game_date", "game_id", "home", "away", "hg", "ag", "is_ot"))).alias("gs"))
    mine = F.transform(F.filter("gs", lambda g: g["home"].contains(club) | g["away"].contains(club)), lambda g: g["game_id"])
    before = season.select("sg", F.explode(F.concat(mine, F.array(F.lit(None).cast("long")))).alias("game_id"), "gs")
    upto = F.when(F.col("game_id").isNull(), F.size("gs")).otherwise(F.array_position(F.transform("gs", lambda g: g["game_id"]), F.col("game_id")).cast("int") - 1)
    folded = before.select("sg", "game_id", F.aggregate(F.slice("gs", F.lit(1), upto), F.create_map().cast("map<string,double>"), _play).alias("m"), F.get(F.filter("gs", lambda g: g["home"].contains(club) | g["away"].contains(club)), F.lit(0)).alias("any"))
    name = F.when(F.col("any.home").contains(club), F.col("any.home")).otherwise(F.col("any.away"))
    return folded.where("any is not null").select("sg", "game_id", F.round(F.coalesce(F.try_element_at("m", name), F.lit(START)), 6).alias("rating"))


def next_game_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's first game without a result, and its chance to win it by the ratings."""
    games = schedule_games(spark, sf_dir)
    r = _rated(games)
    ahead = games.where("hg is null").select("sg", "game_id", "game_date", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("away").alias("opp"), F.lit(True).alias("is_home")), F.struct(F.col("away").alias("team"), F.col("home").alias("opp"), F.lit(False).alias("is_home")))).alias("s")).select("sg", "game_id", "game_date", "s.*")
    first = ahead.withColumn("n", F.row_number().over(_by_team())).where("n = 1").join(r, "sg")
    mine, theirs = F.coalesce(F.try_element_at("ratings", F.col("team")), F.lit(START)), F.coalesce(F.try_element_at("ratings", F.col("opp")), F.lit(START))
    diff = theirs - (mine + F.when(F.col("is_home"), HOME_EDGE).otherwise(-HOME_EDGE))
    return first.select("sg", "team", "opp", "game_id", "is_home", F.round(1 / (1 + F.pow(F.lit(10.0), diff / SCALE)), 6).alias("win_probability"))


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = schedule_games(spark, sf_dir)
    t = _table(team_games(games)).join(_rated(games), "sg")
    elo = F.coalesce(F.try_element_at("ratings", F.col("team")), F.lit(START))
    w, ppg = F.least(F.lit(1.0), F.col("gp") / SEASON), F.col("pts") / F.col("gp")
    per_game = ppg * w + (1.5 + (elo - START) * 0.003) * (1 - w)
    return t.select("sg", "team", "gp", "pts", F.col("rank").alias("now_rank"), F.round(F.col("pts") + F.greatest(F.lit(0), SEASON - F.col("gp")) * per_game, 4).alias("projected"))


def projected_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at the end of a full season: what is won so far, and form blended with rating for the rest."""
    return _projection(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("sg").orderBy(F.desc("projected"), "team")))


def projected_table_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected points with a band, a span of ranks, chances of the top and the bottom, and a tier."""
    p = projected_standings(spark, sf_dir)
    n, i = F.count(F.lit(1)).over(Window.partitionBy("sg")), F.col("rank")
    seed = 0.75 * (F.col("pts") / F.col("gp")) * SEASON + 0.25 * F.greatest(F.lit(42), 100 - 4 * (F.col("now_rank") - 1))
    points = F.greatest(F.lit(46.0), F.least(F.lit(96.0), seed))
    spread = F.when(i <= 6, 2).otherwise(3)
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return p.select("sg", "team", "rank", F.round(points, 4).alias("seed_pts"), F.round(F.greatest(F.lit(35.0), points - 7.8), 4).alias("low"), F.round(F.least(F.lit(110.0), points + 7.8), 4).alias("high"), F.greatest(F.lit(1), i - spread).cast("int").alias("rank_best"), F.least(n, i + spread).cast("int").alias("rank_worst"), clamp(100 - 6 * (i - 1), 2, 96).cast("int").alias("top_six"), F.when(i >= 8, clamp(8 * (i - 8), 2, 90)).otherwise(2).cast("int").alias("bottom"), F.when(i <= 4, "contender").when(i <= 10, "middle").otherwise("lower").alias("tier"))


_S = "count(*) gp, count(*) filter (where outcome = 'W') w, count(*) filter (where outcome = 'OTW') otw, count(*) filter (where outcome = 'OTL') otl, count(*) filter (where outcome = 'L') l, count(*) filter (where outcome = 'D') d, cast(sum(gf) as bigint) gf, cast(sum(ga) as bigint) ga, cast(sum(pts) as bigint) pts"
_WIN = "window t as (partition by sg, team order by game_date, game_id)"
_PLACES = f"places as (select *, row_number() over (partition by sg order by pts desc, gf - ga desc, gf desc, team) as rank from (select sg, team, {_S} from team_games group by 1, 2))"
_FOLD = """steps as (select *, row_number() over (partition by sg order by game_date, game_id) k, count(*) filter (where home = away) over (partition by sg) odd from games where hg is not null),
fold as (
  select distinct sg, cast(0 as bigint) k, cast([] as struct(t varchar, r double)[]) m from steps where odd = 0
  union all
  select sg, k, list_concat(list_filter(m, lambda e: e.t <> home and e.t <> away), [{'t': home, 'r': h + mv}, {'t': away, 'r': a - mv}]) from (
    select *, 20.0 * ((case when hg > ag then case when is_ot then 0.65 else 1.0 end when hg < ag then case when is_ot then 0.35 else 0.0 end else 0.5 end) - 1 / (1 + pow(10.0, (a - h - 40.0) / 400.0))) mv from (
      select s.*, f.m, coalesce(list_filter(f.m, lambda e: e.t = s.home)[1].r, 1500.0) h, coalesce(list_filter(f.m, lambda e: e.t = s.away)[1].r, 1500.0) a from fold f join steps s on s.sg = f.sg and s.k = f.k + 1))),
rated as (select sg, unnest(m, recursive := true) from (select sg, m from fold qualify row_number() over (partition by sg order by k desc) = 1))"""
_PROJ = f"""proj as (select sg, team, gp, pts, now_rank, projected, row_number() over (partition by sg order by projected desc, team) as rank from (
  select p.sg, team, gp, pts, p.rank now_rank, round(pts + greatest(0, 52 - gp) * ((pts / gp) * least(1.0, gp / 52.0) + (1.5 + (coalesce(r.r, 1500.0) - 1500.0) * 0.003) * (1 - least(1.0, gp / 52.0))), 4) projected from places p left join rated r on r.sg = p.sg and r.t = p.team where p.sg in (select sg from rated)))"""

QUERIES = {f.__name__: f for f in (timeline_cumulative_points, home_away_splits, period_goals, head_to_head, rolling_form_10, streaks_longest_current, standings_ranked, pythagorean_luck, game_state_records, attendance_summary, rating_fold_per_season, rating_history, next_game_probability, projected_standings, projected_table_bands)}
SQL = {
    "timeline_cumulative_points": f"with {TEAM_GAMES_SQL} select sg, team, opp, game_id, game_date, is_home, gf, ga, outcome, pts, row_number() over t match_num, cast(sum(pts) over (t rows unbounded preceding) as bigint) total_pts from team_games {_WIN}",
    "home_away_splits": f"with {TEAM_GAMES_SQL} select sg, team, is_home, {_S} from team_games group by 1, 2, 3",
    "period_goals": f"with {TEAM_GAMES_SQL}, p as (select sg, team, is_home, string_split(regexp_replace(periods, '[()\\s]', '', 'g'), ',') parts from team_games where periods is not null), q as (select sg, team, is_home, unnest(parts) part, unnest(range(1, len(parts) + 1)) period from p), r as (select *, try_cast(regexp_extract(part, '^(\\d+)-(\\d+)$', 1) as int) h, try_cast(regexp_extract(part, '^(\\d+)-(\\d+)$', 2) as int) a from q) select sg, team, cast(period as int) period, cast(sum(case when is_home then h else a end) as bigint) goals_for, cast(sum(case when is_home then a else h end) as bigint) goals_against from r where period <= 3 and h is not null group by 1, 2, 3",
    "head_to_head": f"with {TEAM_GAMES_SQL} select *, row_number() over (partition by sg, team order by pts desc, gf - ga desc, opp) as rank from (select sg, team, opp, {_S} from team_games group by 1, 2, 3)",
    "rolling_form_10": f"with {TEAM_GAMES_SQL} select sg, team, game_id, row_number() over t match_num, cast(sum(pts) over w as bigint) pts10, cast(sum(case when gf > ga then 1 else 0 end) over w as bigint) w10, round(sum(gf) over w / count(*) over w, 6) gf_avg, round(sum(ga) over w / count(*) over w, 6) ga_avg from team_games window t as (partition by sg, team order by game_date, game_id), w as (partition by sg, team order by game_date, game_id rows 9 preceding)",
    "streaks_longest_current": f"with {TEAM_GAMES_SQL}, a as (select sg, team, gf > ga won, game_date, game_id, row_number() over t - row_number() over (partition by sg, team, gf > ga order by game_date, game_id) g from team_games {_WIN}), r as (select sg, team, won, count(*) n, max((game_date, game_id)) z from a group by sg, team, won, g) select sg, team, coalesce(max(n) filter (where won), 0) longest_win, coalesce(max(n) filter (where not won), 0) longest_loss, arg_max(case when won then n else -n end, z) current from r group by 1, 2",
    "standings_ranked": f"with {TEAM_GAMES_SQL}, {_PLACES} select * from places",
    "pythagorean_luck": f"with {TEAM_GAMES_SQL}, t as (select sg, team, {_S} from team_games group by 1, 2), e as (select *, case when gf + ga > 0 then pow(gf, 2) / (pow(gf, 2) + pow(ga, 2)) * gp * 3 else 0 end x from t) select sg, team, pts, round(x, 6) expected_pts, round(pts - x, 6) luck from e",
    "game_state_records": f"""with {TEAM_GAMES_SQL}, p as (select *, list_transform(string_split(periods, '-'), lambda x: cast(x as int)) n, case when is_home then 1 else -1 end s from (select * replace (array_to_string(regexp_extract_all(periods, '\\d+'), '-') as periods) from team_games) where regexp_matches(periods, '^[0-9]+-[0-9]+-[0-9]+-[0-9]+')),
      d as (select sg, team, outcome, s * (n[1] - n[2]) d1, s * (n[1] - n[2] + n[3] - n[4]) d2, abs(gf - ga) m from p),
      x as (select sg, team, outcome, unnest([case when d1 > 0 then 'lead' when d1 < 0 then 'trail' else 'tied' end || '_after_1', case when d2 > 0 then 'lead' when d2 < 0 then 'trail' else 'tied' end || '_after_2', case when m = 1 then 'one_goal' when m = 2 then 'two_goals' when m >= 3 then 'three_plus_goals' end]) situation from d)
      select sg, team, situation, count(*) filter (where outcome in ('W', 'OTW')) w, count(*) filter (where outcome in ('L', 'D')) l, count(*) filter (where outcome = 'OTL') otl from x where situation is not null group by 1, 2, 3""",
    "attendance_summary": f"with {TEAM_GAMES_SQL} select sg, team, count(*) games, round(avg(spectators), 4) avg_spectators, max(spectators) max_spectators, min(spectators) min_spectators, cast(sum(spectators) as bigint) total_spectators from team_games where is_home and spectators > 0 group by 1, 2",
    "rating_fold_per_season": f"with recursive {GAMES_SQL}, {_FOLD} select sg, t team, round(r, 6) rating from rated",
    "next_game_probability": f"""with recursive {GAMES_SQL}, {_FOLD}, ahead as (select sg, game_id, game_date, home team, away opp, true is_home from games where hg is null union all select sg, game_id, game_date, away, home, false from games where hg is null),
      f as (select * from ahead where sg in (select sg from rated) qualify row_number() over (partition by sg, team order by game_date, game_id) = 1)
      select f.sg, team, opp, game_id, is_home, round(1 / (1 + pow(10.0, (coalesce(b.r, 1500.0) - (coalesce(a.r, 1500.0) + case when is_home then 40.0 else -40.0 end)) / 400.0)), 6) win_probability from f left join rated a on a.sg = f.sg and a.t = team left join rated b on b.sg = f.sg and b.t = opp""",
    "projected_standings": f"with recursive {TEAM_GAMES_SQL}, {_PLACES}, {_FOLD}, {_PROJ} select * from proj",
    "projected_table_bands": f"""with recursive {TEAM_GAMES_SQL}, {_PLACES}, {_FOLD}, {_PROJ}, b as (select *, greatest(46.0, least(96.0, 0.75 * (pts / gp) * 52 + 0.25 * greatest(42, 100 - 4 * (now_rank - 1)))) x, count(*) over (partition by sg) n, case when rank <= 6 then 2 else 3 end s from proj)
      select sg, team, rank, round(x, 4) seed_pts, round(greatest(35.0, x - 7.8), 4) low, round(least(110.0, x + 7.8), 4) high, cast(greatest(1, rank - s) as int) rank_best, cast(least(n, rank + s) as int) rank_worst, cast(greatest(2, least(96, 100 - 6 * (rank - 1))) as int) top_six, cast(case when rank >= 8 then greatest(2, least(90, 8 * (rank - 8))) else 2 end as int) bottom, case when rank <= 4 then 'contender' when rank <= 10 then 'middle' else 'lower' end tier from b""",
}
