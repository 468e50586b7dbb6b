"""Analyses of goals and penalties, and of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.functions.parse import clock_seconds, falsy
from rinkline.plans.domain import EVENTS_SQL, game_events
from rinkline.sources.tables import table
from rinkline.streaming.daily import stream_daily


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return game_events(spark, sf_dir).where("kind = 'goal'")


def _penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return game_events(spark, sf_dir).where("kind = 'penalty'").withColumn("minutes", falsy(F.col("minutes"), F.lit(2).cast("long")))


def event_player_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals, assists and points of each player, from one row per scorer and helper."""
    role = lambda n, c: F.struct(F.lit(n).alias("role"), F.col(c).alias("who"))
    rows = _goals(spark, sf_dir).select(F.explode(F.array(role("g", "player"), role("a", "assist1"), role("a", "assist2"))).alias("x")).select("x.*").where("who is not null")
    return rows.groupBy(F.col("who").alias("player")).agg(F.count_if(F.col("role") == "g").alias("goals"), F.count_if(F.col("role") == "a").alias("assists"), F.count(F.lit(1)).alias("points"))


def special_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-play goals per penalty of the opponents in the same games, penalty minutes per game."""
    e = game_events(spark, sf_dir)
    g = e.where("kind = 'goal' and power_play").groupBy("team").agg(F.count(F.lit(1)).alias("pp_goals"))
    p = _penalties(spark, sf_dir).groupBy("team").agg(F.count(F.lit(1)).alias("penalties"), F.sum("minutes").alias("pim"))
    games = e.groupBy("team").agg(F.count_distinct("game_id").alias("games"))
    every = p.agg(F.sum("penalties").alias("all_penalties"))
    t = games.join(g, "team", "left").join(p, "team", "left").withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one")
    n = lambda c: F.coalesce(c, F.lit(0))
    return t.select("team", "games", n("pp_goals").alias("pp_goals"), n("penalties").alias("penalties"), F.round(100 * n("pp_goals") / F.greatest(F.lit(1), F.col("all_penalties") - n("penalties")), 6).alias("pp_pct"), F.round(n("pim") / F.greatest(F.lit(1), "games"), 6).alias("pim_per_game"))


def penalty_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties by type and by player (five most), and by period with periods without any."""
    p = _penalties(spark, sf_dir)
    top = lambda label, c, n: p.groupBy(F.col(c).cast("string").alias("item")).agg(n.cast("long").alias("n")).orderBy(F.desc("n"), "item").limit(5).select(F.lit(label).alias("by"), "item", "n")
    periods = spark.range(1, 5).select(F.col("id").cast("int").alias("period")).join(p.groupBy("period").agg(F.count(F.lit(1)).alias("n")), "period", "left").select(F.lit("period").alias("by"), F.col("period").cast("string").alias("item"), F.coalesce("n", F.lit(0)).alias("n"))
    return top("type", "penalty_type", F.count(F.lit(1))).unionByName(top("player", "player", F.sum("minutes"))).unionByName(periods)


def scoring_bins_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals of each team in six ten-minute bins of regular time, empty bins included."""
    g = _goals(spark, sf_dir).where("period <= 3")
    minute = (F.col("period") - 1) * 20 + F.floor(clock_seconds(F.col("clock")) / 60)
    counted = g.groupBy("team", F.floor(minute / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = game_events(spark, sf_dir).select("team").distinct().select("team", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("bin"))
    return grid.join(counted, ["team", "bin"], "left").select("team", "bin", F.coalesce("n", F.lit(0)).alias("goals"))


def pair_chemistry_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of players that share most goals."""
    who = F.array_sort(F.array_distinct(F.filter(F.array("player", "assist1", "assist2"), lambda x: x.isNotNull())))
    g = _goals(spark, sf_dir).select(who.alias("w"))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return g.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("goals")).orderBy(F.desc("goals"), "a", "b").limit(5)


def first_goal_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How games end for the team that scores first."""
    g = _goals(spark, sf_dir)
    first = g.groupBy("game_id").agg(F.min_by("team", F.struct("period", clock_seconds(F.col("clock")).alias("s"), "event_id")).alias("first_team"))
    score = g.join(first, "game_id").groupBy("game_id", "first_team").agg(F.count_if(F.col("team") == F.col("first_team")).alias("own"), F.count_if(F.col("team") != F.col("first_team")).alias("other"))
    return score.groupBy(F.col("first_team").alias("team")).agg(F.count_if(F.col("own") > F.col("other")).alias("w"), F.count_if(F.col("own") < F.col("other")).alias("l"), F.count_if(F.col("own") == F.col("other")).alias("d"))


def club_snapshot_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: newest event, events of the last day and level of activity."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    day = e.withColumn("one", F.lit(1)).join(newest.withColumn("one", F.lit(1)), "one").where(F.col("ts") > F.col("newest") - F.expr("interval 24 hours"))
    s = day.agg(F.count(F.lit(1)).alias("last_day"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max("newest").alias("newest"))
    return s.select("newest", "last_day", "purchases", F.when(F.col("last_day") > 1000, "high").when(F.col("last_day") > 100, "medium").otherwise("low").alias("activity"))


def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON text, counted by event type; and model tags out of news analyses."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k10")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"))


def carry_forward_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last signup before it in its user's rows, as a header carried to the rows under it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w).alias("header_event"))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, counted by a stream with a watermark and upserted batch by batch."""
    return stream_daily(spark, sf_dir)


QUERIES = {f.__name__: f for f in (event_player_points, special_teams, penalty_breakdown, scoring_bins_zero_filled, pair_chemistry_top5, first_goal_impact, club_snapshot_mart, json_props_extract, carry_forward_header, stream_daily_counts)}
_PEN = "pen as (select *, coalesce(nullif(minutes, 0), 2) mm from ev where kind = 'penalty')"
_SEC = "cast(split_part(clock, ':', 1) as int) * 60 + cast(split_part(clock, ':', 2) as int)"
SQL = {
    "event_player_points": f"with {EVENTS_SQL}, r as (select player who, 'g' z from ev where kind = 'goal' union all select assist1, 'a' from ev where kind = 'goal' union all select assist2, 'a' from ev where kind = 'goal') select who player, count(*) filter (where z = 'g') goals, count(*) filter (where z = 'a') assists, count(*) points from r where who is not null group by 1",
    "special_teams": f"with {EVENTS_SQL}, {_PEN}, t as (select team, count(distinct game_id) games, count(*) filter (where kind = 'goal' and power_play) pp_goals from ev group by 1), p as (select team, count(*) penalties, sum(mm) pim from pen group by 1), z as (select count(*) n from pen) select t.team, games, pp_goals, coalesce(penalties, 0) penalties, round(100 * pp_goals / greatest(1, n - coalesce(penalties, 0)), 6) pp_pct, round(coalesce(pim, 0) / greatest(1, games), 6) pim_per_game from t left join p using (team), z",
    "penalty_breakdown": f"with {EVENTS_SQL}, {_PEN} select * from (select 'type' as by, cast(penalty_type as varchar) item, count(*) n from pen group by 2 order by n desc, item limit 5) union all select * from (select 'player', cast(player as varchar) item, cast(sum(mm) as bigint) n from pen group by 2 order by n desc, item limit 5) union all select 'period', cast(p as varchar), count(period) from (select unnest([1, 2, 3, 4]) p) left join pen on period = p group by 2",
    "scoring_bins_zero_filled": f"with {EVENTS_SQL}, g as (select team, cast(floor(((period - 1) * 20 + floor(({_SEC}) / 60)) / 10) as int) b from ev where kind = 'goal' and period <= 3) select t.team, t.bin, count(g.b) goals from (select team, unnest([0, 1, 2, 3, 4, 5]) bin from (select distinct team from ev)) t left join g on g.team = t.team and g.b = t.bin group by 1, 2",
    "pair_chemistry_top5": f"with {EVENTS_SQL}, w as (select event_id, unnest(list_distinct([player, assist1, assist2])) p from ev where kind = 'goal') select x.p a, y.p b, count(*) goals from w x join w y on x.event_id = y.event_id and x.p < y.p group by 1, 2 order by goals desc, a, b limit 5",
    "first_goal_impact": f"with {EVENTS_SQL}, g as (select *, {_SEC} s from ev where kind = 'goal'), f as (select game_id, arg_min(team, (period, s, event_id)) ft from g group by 1), x as (select game_id, ft, count(*) filter (where team = ft) own, count(*) filter (where team <> ft) oth from g join f using (game_id) group by 1, 2) select ft team, count(*) filter (where own > oth) w, count(*) filter (where own < oth) l, count(*) filter (where own = oth) d from x group by 1",
    "club_snapshot_mart": "with z as (select max(ts) newest from events) select newest, count(*) last_day, count(*) filter (where event_type = 'purchase') purchases, case when count(*) > 1000 then 'high' when count(*) > 100 then 'medium' else 'low' end activity from events, z where ts > newest - interval 24 hours group by newest",
    "json_props_extract": "select event_type, k % 10 k10, count(*) n, cast(sum(k) as bigint) k_sum from (select event_type, cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1, 2",
    "carry_forward_header": "select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) header_event from events",
    "stream_daily_counts": "select cast(ts as date) as day, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
}
