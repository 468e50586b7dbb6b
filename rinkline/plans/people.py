"""Analyses of players, goalies and rosters, and the matching of names to a roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.functions.textkeys import word_parts
from rinkline.operators.latest import latest_by_key, latest_snapshot
from rinkline.plans.staging import serving_roster_overview
from rinkline.sources.tables import table

#: Accented letters and what they fold to.
ACCENTS, PLAIN = "åäöéüøèêëíáàçñ", "aaoeuoeeeiaacn"


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTS, PLAIN)


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "swehockey_player_stats").select("season_group_id", "team_id", "player_name", "position", "games_played", "goals", "assists", "points", "pim", "scraped_at", "row_id")
    return latest_snapshot(p, ["season_group_id"], "scraped_at")


def _goalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "swehockey_goalie_stats").select("season_group_id", "team_id", "goalie_name", "games_played", "saves", "save_pct", "gaa", "scraped_at", "row_id")
    return latest_snapshot(g, ["season_group_id"], "scraped_at")


def player_impact_vs_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-game rates of players with ten games or more against their league's ratio of sums."""
    p = _players(spark, sf_dir).where("games_played >= 10")
    mean = p.groupBy("season_group_id").agg(*[F.try_divide(F.sum(c), F.sum("games_played")).alias(f"m_{c}") for c in ("points", "goals", "pim")])
    rate = lambda c: F.col(c) / F.col("games_played")
    diff = F.when((F.col("games_played") >= 20) & (F.col("points") == 0), F.lit(0.0)).otherwise(rate("points") - F.col("m_points"))
    return p.join(mean, "season_group_id").select("season_group_id", "row_id", F.round(rate("points"), 6).alias("ppg"), F.round(rate("goals"), 6).alias("gpg"), F.round(diff, 6).alias("ppg_diff"), F.round(rate("pim") - F.col("m_pim"), 6).alias("pim_diff"))


def goalie_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the league's goalies each one is at least as good as, and goals saved above average."""
    g = _goalies(spark, sf_dir).where("save_pct is not null and gaa is not null and games_played > 0")
    w = lambda c: F.cume_dist().over(Window.partitionBy("season_group_id").orderBy(c))
    above = F.when(F.col("save_pct") > 0, F.col("saves") - F.col("saves") / (F.col("save_pct") / 100) * 0.90).otherwise(0.0)
    return g.select("season_group_id", "row_id", F.round(100 * w("save_pct"), 4).alias("save_percentile"), F.round(100 - 100 * w("gaa"), 4).alias("gaa_percentile"), F.round(above, 4).alias("saved_above_average"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(word_parts(folded(c)), lambda t: F.length(t) > 1))


def fuzzy_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's first roster name (goalies in row order) of the same team that shares all parts of the shorter name, or two.

    Names meet by a shared part, so no name is held against a whole roster.
    """
    key = ["season_group_id", "team_id"]
    r = _goalies(spark, sf_dir).select(*key, F.col("row_id").alias("roster_row"), _tokens(F.col("goalie_name")).alias("rt"))
    n = _players(spark, sf_dir).select(*key, "row_id", _tokens(F.col("player_name")).alias("nt"))
    meets = n.withColumn("t", F.explode("nt")).join(r.withColumn("t", F.explode("rt")), [*key, "t"]).groupBy("row_id", "roster_row").agg(F.count(F.lit(1)).alias("common"), F.any_value(F.size("nt")).alias("a"), F.any_value(F.size("rt")).alias("b"))
    fit = meets.where((F.col("common") >= F.least("a", "b")) | (F.col("common") >= 2))
    return fit.groupBy("row_id").agg(F.min("roster_row").alias("roster_row"))


def fallback_source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest row of each player name, from players if there is one, else from goalies."""
    p = _players(spark, sf_dir).select("season_group_id", "team_id", F.col("player_name").alias("person"), F.lit(0).alias("source"), "points", "goals", "games_played", "row_id")
    g = _goalies(spark, sf_dir).select("season_group_id", "team_id", F.col("goalie_name").alias("person"), F.lit(1).alias("source"), F.lit(0).cast("bigint").alias("points"), F.lit(0).cast("bigint").alias("goals"), "games_played", "row_id")
    return latest_by_key(p.unionByName(g), ["season_group_id", "team_id", "person"], [F.asc("source"), F.desc("points"), F.desc("goals"), F.desc("games_played"), F.asc("row_id")])


def league_step_and_age_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per game carried to a higher league and along an age curve (ages are invented from row numbers)."""
    p = _players(spark, sf_dir).where("games_played > 0")
    age = (F.lit(17) + F.col("row_id") % 22).cast("int")
    step = F.round(F.col("points") / F.col("games_played") * F.when(F.col("position") == "GK", 1.0).otherwise(0.60), 6)
    curve = F.when(age < 21, 0.15).when(age < 23, 0.08).when(age < 28, 0.0).when(age < 33, -0.08).otherwise(-0.22)
    bar = F.when(F.col("position").isin("LD", "RD"), F.lit(0.35)).otherwise(F.lit(0.50))
    aged = F.greatest(F.lit(0.0), F.col("step") * (1 + F.col("curve")))
    q = p.select("row_id", "position", age.alias("age"), step.alias("step"), curve.alias("curve"), bar.alias("bar"))
    return q.select("row_id", "age", F.col("step").alias("step_ppg"), F.round(aged, 6).alias("aged_ppg"), F.when(aged >= F.col("bar"), "ready").when(aged >= F.col("bar") / 2, "near").otherwise("far").alias("readiness"), F.when(F.col("curve") > 0, "rising").when(F.col("curve") == 0, "peak").otherwise("falling").alias("trajectory"))


def roster_sync_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active players of each team and those on loan appended if the roster lacks them, counted by kind."""
    o = serving_roster_overview(spark, sf_dir).withColumn("s", F.lower(F.trim(F.coalesce("status", F.lit("")))))
    roster = o.where("s = 'active'").select("team_id", "season_id", "player_id", F.lit("roster").alias("kind"))
    added = o.where("s = 'loaned'").select("team_id", "season_id", "player_id", F.lit("loan").alias("kind")).join(roster.select("team_id", "season_id", "player_id"), ["team_id", "season_id", "player_id"], "left_anti")
    c = roster.unionByName(added).groupBy("team_id", "season_id").agg(F.count_if(F.col("kind") == "roster").alias("roster"), F.count_if(F.col("kind") == "loan").alias("loans"))
    return c.select("team_id", "season_id", "roster", "loans", F.greatest(F.lit(45), F.least(F.lit(90), 62 + 2 * F.col("loans") - F.greatest(F.lit(0), 12 - F.col("roster")))).cast("long").alias("squad_score"))


def team_predicate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored team names that answer a query: short queries as whole words, longer ones anywhere, accents folded."""
    names = table(spark, sf_dir, "swehockey_standings").groupBy("team_name").agg(F.count(F.lit(1)).alias("n")).withColumn("f", folded(F.col("team_name")))
    hits = F.filter(F.array(*[F.when(F.col("f").rlike(rf"(^|[^a-z0-9]){q}([^a-z0-9]|$)") if len(q) <= 3 else F.contains("f", F.lit(q)), F.lit(q)) for q in ("hk", "ik", "norr", "glimm", "vras")]), lambda x: x.isNotNull())
    return names.select(F.explode(hits).alias("query"), "n").groupBy("query").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("rows"))


def top_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best scorers of each season group's newest snapshot."""
    w = Window.partitionBy("season_group_id").orderBy(F.desc("points"), F.desc("goals"), F.asc("games_played"), "row_id")
    return _players(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 25").select("season_group_id", "place", "player_name", "points", "goals", "row_id")


QUERIES = {f.__name__: f for f in (player_impact_vs_league, goalie_percentiles, fuzzy_name_match, fallback_source_preference, league_step_and_age_curve, roster_sync_append, team_predicate_search, top_scorers)}
_P = "p as (select * from (select *, max(scraped_at) over (partition by season_group_id) z from swehockey_player_stats) where scraped_at = z)"
_G = "g as (select * from (select *, max(scraped_at) over (partition by season_group_id) z from swehockey_goalie_stats) where scraped_at = z)"
_T = r"list_distinct(list_filter(string_split_regex(lower(upper(translate(lower({c}), '" + ACCENTS + "', '" + PLAIN + r"'))), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1))"
_SEARCH = " union all ".join(
    f"select '{q}' query, count(*) \"names\", cast(sum(n) as bigint) \"rows\" from n where {c} having count(*) > 0"
    for q, c in [("hk", "regexp_matches(f, '(^|[^a-z0-9])hk([^a-z0-9]|$)')"), ("ik", "regexp_matches(f, '(^|[^a-z0-9])ik([^a-z0-9]|$)')"), ("norr", "contains(f, 'norr')"), ("glimm", "contains(f, 'glimm')"), ("vras", "contains(f, 'vras')")]
)
SQL = {
    "player_impact_vs_league": f"with {_P}, q as (select * from p where games_played >= 10), m as (select season_group_id, sum(points) / sum(games_played) mp, sum(pim) / sum(games_played) mi from q group by 1) select season_group_id, row_id, round(points / games_played, 6) ppg, round(goals / games_played, 6) gpg, round(case when games_played >= 20 and points = 0 then 0.0 else points / games_played - mp end, 6) ppg_diff, round(pim / games_played - mi, 6) pim_diff from q join m using (season_group_id)",
    "goalie_percentiles": f"with {_G} select season_group_id, row_id, round(100 * cume_dist() over (partition by season_group_id order by save_pct), 4) save_percentile, round(100 - 100 * cume_dist() over (partition by season_group_id order by gaa), 4) gaa_percentile, round(case when save_pct > 0 then saves - saves / (save_pct / 100) * 0.90 else 0.0 end, 4) saved_above_average from g where save_pct is not null and gaa is not null and games_played > 0",
    "fuzzy_name_match": f"with {_P}, {_G}, a as (select season_group_id, team_id, row_id, {_T.format(c='player_name')} nt from p), b as (select season_group_id, team_id, row_id, {_T.format(c='goalie_name')} rt from g) select a.row_id, min(b.row_id) roster_row from a join b using (season_group_id, team_id) where len(list_intersect(nt, rt)) > 0 and (len(list_intersect(nt, rt)) >= least(len(nt), len(rt)) or len(list_intersect(nt, rt)) >= 2) group by 1",
    "fallback_source_preference": f"with {_P}, {_G}, u as (select season_group_id, team_id, player_name person, 0 source, points, goals, games_played, row_id from p union all select season_group_id, team_id, goalie_name, 1, 0, 0, games_played, row_id from g) select * from u qualify row_number() over (partition by season_group_id, team_id, person order by source, points desc, goals desc, games_played desc, row_id) = 1",
    "league_step_and_age_curve": f"with {_P}, q as (select row_id, cast(17 + row_id % 22 as int) age, round(points / games_played * case when position = 'GK' then 1.0 else 0.6 end, 6) step, case when position in ('LD', 'RD') then 0.35 else 0.5 end bar from p where games_played > 0), c as (select *, case when age < 21 then 0.15 when age < 23 then 0.08 when age < 28 then 0.0 when age < 33 then -0.08 else -0.22 end curve from q), d as (select *, greatest(0.0, step * cast(1 + curve as double)) aged from c) select row_id, age, step step_ppg, round(aged, 6) aged_ppg, case when aged >= bar then 'ready' when aged >= bar / 2 then 'near' else 'far' end readiness, case when curve > 0 then 'rising' when curve = 0 then 'peak' else 'falling' end trajectory from d",
    "roster_sync_append": "with o as (select *, lower(trim(coalesce(status, ''), ' ')) s from roster_status_events qualify row_number() over (partition by player_id, season_id order by status_date desc, updated_at desc, roster_status_id, status nulls last) = 1), c as (select team_id, season_id, count(*) filter (where s = 'active') roster, count(*) filter (where s = 'loaned') loans from o where s in ('active', 'loaned') group by 1, 2) select team_id, season_id, roster, loans, greatest(45, least(90, 62 + 2 * loans - greatest(0, 12 - roster))) squad_score from c",
    "team_predicate_search": f"with n as (select team_name, count(*) n, translate(lower(team_name), '{ACCENTS}', '{PLAIN}') f from swehockey_standings group by 1) {_SEARCH}",
    "top_scorers": f"with {_P} select season_group_id, row_number() over (partition by season_group_id order by points desc, goals desc, games_played, row_id) place, player_name, points, goals, row_id from p qualify place <= 25",
}
