"""Staging, facts, serving and checks over the append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.functions.parse import safe_number
from rinkline.operators.latest import latest_by_key, latest_snapshot, rows_of_successful_runs
from rinkline.operators.quality import batch_checks, freshness, violations
from rinkline.operators.upsert import above_watermark, insert_only, upsert
from rinkline.sources.tables import table

AS_OF = "2025-06-01 00:00:00"  # the time the queries take as now
WATERMARK = "2024-01-20 00:00:00"


def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each player of a season group; rows gone from the newest snapshot survive."""
    p = table(spark, sf_dir, "swehockey_player_stats").select("season_group_id", "team_code", "player_name", "goals", "points", "scraped_at", "row_id")
    return latest_by_key(p, ["season_group_id", "team_code", "player_name"], [F.desc("scraped_at"), F.desc("row_id")])


def latest_snapshot_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All player rows of each season group's newest snapshot."""
    p = table(spark, sf_dir, "swehockey_player_stats").select("season_group_id", "team_code", "player_name", "points", "scraped_at", "row_id")
    return latest_snapshot(p, ["season_group_id"], "scraped_at")


def latest_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each run, that of its latest event."""
    r = table(spark, sf_dir, "ingestion_runs").select("run_id", "event_id", "status", "started_at", "finished_at", "loaded_rows").distinct()
    return latest_by_key(r, ["run_id"], [F.col("finished_at").isNull(), F.desc("finished_at"), F.desc("started_at"), F.desc("event_id"), F.asc_nulls_last("status"), F.asc_nulls_last("loaded_rows")]).select("run_id", "event_id", "status", "finished_at")


def approved_rows_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings rows of no run or of a successful one."""
    s = table(spark, sf_dir, "swehockey_standings").select("row_id", "season_group_id", "team_name", "points", "run_id")
    return rows_of_successful_runs(s, table(spark, sf_dir, "ingestion_runs").select("run_id", "event_id", "status", "started_at", "finished_at"))


def serving_latest_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer and year."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("int").alias("season"), "o_orderdate", "o_orderkey", "o_totalprice")
    return latest_by_key(o, ["o_custkey", "season"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


def serving_roster_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest roster notice of each player and season."""
    r = table(spark, sf_dir, "roster_status_events").select("player_id", "season_id", "team_id", "status_date", "status", "is_available", "updated_at", "roster_status_id").distinct()
    return latest_by_key(r, ["player_id", "season_id"], [F.desc("status_date"), F.desc("updated_at"), F.asc("roster_status_id"), F.asc_nulls_last("status")])


def staging_casts_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goalie rows with nulls defaulted, derived seconds and guarded ratios; check results read as numbers."""
    g = table(spark, sf_dir, "swehockey_goalie_stats")
    return g.select("row_id", F.trim(F.coalesce("team_code", F.lit(""))).alias("team_code"), F.coalesce("save_pct", F.lit(0.0)).alias("save_pct"), (F.col("toi_minutes") * 60).alias("toi_seconds"), F.when(F.col("games_played") == 0, 0.0).otherwise(F.round(F.col("wins") / F.col("games_played"), 6)).alias("win_rate"), F.coalesce("source", F.lit("swehockey")).alias("source"), F.lit(None).cast("bigint").alias("xg"))


def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed values of checks as numbers, whatever they are written with."""
    q = table(spark, sf_dir, "data_quality_runs")
    return q.select("quality_run_id", "observed_value", safe_number(F.col("observed_value")).alias("observed"), safe_number(F.col("observed_value")).cast("bigint").alias("observed_whole"))


def fact_union_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player and goalie rows of the newest snapshots in one fact, each with a hash of its business key."""
    p = latest_snapshot(table(spark, sf_dir, "swehockey_player_stats").select("season_group_id", "team_code", F.col("player_name").alias("person"), F.col("games_played"), "scraped_at", "row_id"), ["season_group_id"], "scraped_at").withColumn("kind", F.lit("player"))
    g = latest_snapshot(table(spark, sf_dir, "swehockey_goalie_stats").select("season_group_id", "team_code", F.col("goalie_name").alias("person"), F.col("games_played"), "scraped_at", "row_id"), ["season_group_id"], "scraped_at").withColumn("kind", F.lit("goalie"))
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("season_group_id", "team_code", "person", "kind")]))
    return p.unionByName(g).select(key.alias("fact_key"), "kind", "season_group_id", "person", "games_played", "row_id")


def incremental_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above the watermark."""
    return above_watermark(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", F.lit(WATERMARK).cast("timestamp_ntz"))


def _customer_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 100, 2))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers updated where they are known and added where not."""
    return upsert(*_customer_parts(spark, sf_dir), ["c_custkey"])


def insert_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown customers added, known ones left."""
    return insert_only(*_customer_parts(spark, sf_dir), ["c_custkey"])


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each season group's player rows: rows, missing key parts, repeated keys."""
    return batch_checks(table(spark, sf_dir, "swehockey_player_stats"), ["season_group_id"], ["team_code", "player_name", "scraped_at", "run_id"]).drop("severity")


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break declared rules, per table and rule."""
    runs, goalies = table(spark, sf_dir, "ingestion_runs"), table(spark, sf_dir, "swehockey_goalie_stats")
    a = violations(runs, {"status_not_null": F.col("status").isNull(), "status_accepted": ~F.col("status").isin("RUNNING", "SUCCESS", "FAILED", "FAILED_QUALITY"), "finish_after_start": F.col("finished_at") < F.col("started_at")})
    b = violations(goalies, {"save_pct_range": ~F.col("save_pct").between(0, 100), "save_pct_not_null": F.col("save_pct").isNull(), "saves_within_shots": F.col("saves") > F.col("shots_against")})
    c = runs.groupBy("event_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")).select(F.lit("event_id_unique").alias("rule"), "n")
    return a.withColumn("source", F.lit("ingestion_runs")).unionByName(c.withColumn("source", F.lit("ingestion_runs"))).unionByName(b.withColumn("source", F.lit("swehockey_goalie_stats")))


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the newest row of each season group, in whole hours, and its class."""
    out = None
    for n in ("swehockey_player_stats", "swehockey_goalie_stats", "swehockey_standings", "swehockey_schedule"):
        t = table(spark, sf_dir, n).groupBy("season_group_id").agg(F.max("scraped_at").alias("newest")).select(F.lit(n).alias("source"), "season_group_id", "newest")
        out = t if out is None else out.unionByName(t)
    seconds = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))
    hours = F.floor(seconds / 3600)
    return out.select("source", "season_group_id", "newest", hours.cast("long").alias("hours"), freshness(hours).alias("freshness"))


def semi_join_has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League groups that have goalie rows with games, and the schedule rows of others."""
    g = table(spark, sf_dir, "swehockey_goalie_stats").where("games_played > 20").select("season_group_id")
    return table(spark, sf_dir, "league_groups").join(g, "season_group_id", "left_semi").select("season_group_id", "league", "phase")


def nearest_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each playoff group the regular group of its league that starts nearest, later starts first among equals."""
    from pyspark.sql import Window

    g = table(spark, sf_dir, "league_groups")
    a = g.where("phase = 'playoff'").select("league", F.col("season_group_id").alias("playoff_id"), F.col("first_week").alias("w"))
    b = g.where("phase = 'regular'").select("league", F.col("season_group_id").alias("regular_id"), F.col("first_week").alias("v"))
    far = F.coalesce(F.abs(F.datediff("w", "v")), F.lit(99999))
    near = a.join(b, "league").withColumn("days", far.cast("int")).withColumn("n", F.row_number().over(Window.partitionBy("playoff_id").orderBy("days", F.desc("v"), "regular_id")))
    return near.where("n = 1").select("league", "playoff_id", "regular_id", "days")


_ORDER = "finished_at is null, finished_at desc, started_at desc, event_id desc"
QUERIES = {
    f.__name__: f
    for f in (latest_row_per_key, latest_snapshot_per_group, latest_run_status, approved_rows_only, serving_latest_financials, serving_roster_overview, staging_casts_defaults, tolerant_numbers, fact_union_with_keys, incremental_new_rows, upsert_merge, insert_only_merge, quality_checks, constraint_violations, source_freshness, semi_join_has_data, nearest_season)
}
_NEWEST = "(select *, max(scraped_at) over (partition by season_group_id) z from {t})"
_C = "t as (select c_custkey, c_name, c_acctbal from customer where c_custkey % 3 <> 0), s as (select c_custkey, c_name, round(c_acctbal + 100, 2) c_acctbal from customer where c_custkey % 2 = 0)"
_NUM = r"coalesce(try_cast(replace(regexp_replace(observed_value, '[\s\x{a0}]', '', 'g'), ',', '.') as double), 0.0)"
SQL = {
    "latest_row_per_key": "select season_group_id, team_code, player_name, goals, points, scraped_at, row_id from swehockey_player_stats qualify row_number() over (partition by season_group_id, team_code, player_name order by scraped_at desc, row_id desc) = 1",
    "latest_snapshot_per_group": f"select season_group_id, team_code, player_name, points, scraped_at, row_id from {_NEWEST.format(t='swehockey_player_stats')} where scraped_at = z",
    "latest_run_status": f"select run_id, event_id, status, finished_at from (select distinct run_id, event_id, status, started_at, finished_at, loaded_rows from ingestion_runs) qualify row_number() over (partition by run_id order by {_ORDER}, status nulls last, loaded_rows nulls last) = 1",
    "approved_rows_only": f"select row_id, season_group_id, team_name, points, run_id from swehockey_standings where run_id is null or run_id in (select run_id from (select * from ingestion_runs qualify row_number() over (partition by run_id order by {_ORDER}) = 1) where status = 'SUCCESS')",
    "serving_latest_financials": "select o_custkey, cast(year(o_orderdate) as int) season, o_orderdate, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate desc, o_orderkey desc) = 1",
    "serving_roster_overview": "select player_id, season_id, team_id, status_date, status, is_available, updated_at, roster_status_id from roster_status_events qualify row_number() over (partition by player_id, season_id order by status_date desc, updated_at desc, roster_status_id, status nulls last) = 1",
    "staging_casts_defaults": "select row_id, trim(coalesce(team_code, '')) team_code, coalesce(save_pct, 0.0) save_pct, toi_minutes * 60 toi_seconds, case when games_played = 0 then 0.0 else round(wins / games_played, 6) end win_rate, coalesce(source, 'swehockey') source, cast(null as bigint) xg from swehockey_goalie_stats",
    "tolerant_numbers": f"select quality_run_id, observed_value, {_NUM} observed, cast(trunc({_NUM}) as bigint) observed_whole from data_quality_runs",
    "fact_union_with_keys": "select md5(coalesce(cast(season_group_id as varchar), '') || '|' || coalesce(team_code, '') || '|' || coalesce(person, '') || '|' || kind) fact_key, kind, season_group_id, person, games_played, row_id from (select 'player' kind, season_group_id, team_code, player_name person, games_played, row_id from " + _NEWEST.format(t="swehockey_player_stats") + " where scraped_at = z union all select 'goalie', season_group_id, team_code, goalie_name, games_played, row_id from " + _NEWEST.format(t="swehockey_goalie_stats") + " where scraped_at = z)",
    "incremental_new_rows": f"select event_id, ts, event_type from events where ts > timestamp '{WATERMARK}'",
    "upsert_merge": f"with {_C} select * from s union all select * from t where c_custkey not in (select c_custkey from s)",
    "insert_only_merge": f"with {_C} select * from t union all select * from s where c_custkey not in (select c_custkey from t)",
    "quality_checks": """with k as (select season_group_id, lower(trim(coalesce(team_code, ''))) a, lower(trim(coalesce(player_name, ''), ' ')) b, coalesce(cast(scraped_at as varchar), '') c, lower(trim(coalesce(run_id, ''), ' ')) d from swehockey_player_stats),
      g as (select season_group_id, count(*) n, count(*) filter (where a = '' or b = '' or c = '' or d = '') m, count(*) - count(distinct (a, b, c, d)) r from k group by 1)
      select season_group_id, 'rows_present' check_name, n observed, n > 0 passed from g union all select season_group_id, 'missing_required', m, m = 0 from g union all select season_group_id, 'duplicate_keys', r, r = 0 from g""",
    "constraint_violations": """select 'ingestion_runs' source, rule, n from (select 'status_not_null' rule, count(*) filter (where status is null) n from ingestion_runs
      union all select 'status_accepted', count(*) filter (where status not in ('RUNNING', 'SUCCESS', 'FAILED', 'FAILED_QUALITY')) from ingestion_runs union all select 'finish_after_start', count(*) filter (where finished_at < started_at) from ingestion_runs union all select 'event_id_unique', count(*) - count(distinct event_id) from ingestion_runs)
      union all select 'swehockey_goalie_stats', rule, n from (select 'save_pct_range' rule, count(*) filter (where save_pct not between 0 and 100) n from swehockey_goalie_stats union all select 'save_pct_not_null', count(*) filter (where save_pct is null) from swehockey_goalie_stats union all select 'saves_within_shots', count(*) filter (where saves > shots_against) from swehockey_goalie_stats)""",
    "source_freshness": "select source, season_group_id, newest, hours, case when hours is null then 'unknown' when hours <= 6 then 'fresh' when hours <= 24 then 'stale' else 'critical' end freshness from (select *, cast(floor((epoch_ms(timestamp '" + AS_OF + "') / 1000 - floor(epoch_us(newest) / 1000000)) / 3600) as bigint) as hours from (" + " union all ".join(f"select '{n}' source, season_group_id, max(scraped_at) newest from {n} group by 2" for n in ("swehockey_player_stats", "swehockey_goalie_stats", "swehockey_standings", "swehockey_schedule")) + "))",
    "semi_join_has_data": "select season_group_id, league, phase from league_groups l where exists (select 1 from swehockey_goalie_stats g where g.season_group_id = l.season_group_id and games_played > 20)",
    "nearest_season": "select league, a.season_group_id playoff_id, b.season_group_id regular_id, cast(coalesce(abs(date_diff('day', b.first_week, a.first_week)), 99999) as int) as days from league_groups a join league_groups b using (league) where a.phase = 'playoff' and b.phase = 'regular' qualify row_number() over (partition by a.season_group_id order by days, b.first_week desc, b.season_group_id) = 1",
}
