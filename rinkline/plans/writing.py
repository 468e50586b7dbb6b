"""What is written and read back: appends with lineage, reloads, marts, raw JSON, the gate, the run log; staging models."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkline.operators import quality as Q
from rinkline.operators import sinks as S
from rinkline.operators.latest import latest_by_key, rows_of_successful_runs
from rinkline.operators.staging_area import shared_folder
from rinkline.operators.upsert import above_watermark, delete_where, upsert
from rinkline.plans.staging import AS_OF
from rinkline.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/written-{name}-{uuid.uuid4().hex}"


def lineage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a first load without lineage columns and of a second one with them, out of one table."""
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _folder(spark, "lineage")
    assert S.create_if_missing(spark, path, c.schema) and not S.create_if_missing(spark, path, c.schema)
    S.append(c.where("c_custkey % 2 = 1"), path)
    S.append(S.with_lineage(c.where("c_custkey % 2 = 0"), F.lit(AS_OF).cast("timestamp_ntz"), "crm", F.lit("run-2"), F.concat(F.lit("https://crm.example/"), "c_custkey")), path)
    return S.read_merged(spark, path).select("c_custkey", "c_name", "scraped_at", "source", "run_id", "source_url")


def partition_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, the first five nations loaded anew without those in debt."""
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), _folder(spark, "reload")
    S.replace_partitions(c, path, ("c_nationkey",))
    S.replace_partitions(c.where("c_nationkey < 5 and c_acctbal >= 0"), path, ("c_nationkey",))
    return spark.read.parquet(path).select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("int").alias("c_nationkey"))


def clustered_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings in a mart by day of load, sorted by club, and what its partitions of one year hold."""
    path = _folder(spark, "mart")
    rows = table(spark, sf_dir, "swehockey_standings").where("scraped_at is not null").select(F.to_date("scraped_at").alias("day"), "team_name", "points", "row_id")
    S.write_clustered(rows, path, "day", ("team_name", "row_id"))
    return spark.read.parquet(path).where("day >= date '2024-01-01' and day < date '2025-01-01'").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


_RUN_JSON = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("loaded_rows", T.LongType()), T.StructField("season_group_ids", T.ArrayType(T.LongType())), T.StructField("error_message", T.StringType())])


def raw_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events as raw JSON lines in a folder per pipeline, loaded again by a declared schema."""
    path = _folder(spark, "json")
    runs = table(spark, sf_dir, "ingestion_runs").select("event_id", "run_id", "loaded_rows", "season_group_ids", "error_message", F.coalesce("status", F.lit("none")).alias("folder"))
    S.write_raw_json(runs, path, ("folder",))
    r = S.read_json_lines(spark, path, _RUN_JSON)
    return r.select("event_id", "run_id", "loaded_rows", F.size("season_group_ids").alias("n_groups"), "error_message")


def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers after an INSERT, an UPDATE and a DELETE."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    s = S.inserted(s, [(-1, "Supplier#new", 10.0), (-2, "Supplier#debt", -10.0)])
    s = S.updated_where(s, F.col("s_suppkey") % 5 == 0, {"s_acctbal": F.col("s_acctbal") + 1, "s_name": F.upper("s_name")})
    return delete_where(s, F.col("s_acctbal") < 0).select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


def capped_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest news items, the rest of the cache being dropped: the cap is the feature."""
    return S.newest(table(spark, sf_dir, "tmp_latest_silly").select("item_id", "title", "url"), [F.desc("item_id")], 200)


KINDS = {"player_stats": ("swehockey_player_stats", ["team_code", "player_name", "scraped_at"]), "goalie_stats": ("swehockey_goalie_stats", ["team_code", "goalie_name", "scraped_at"]), "standings": ("swehockey_standings", ["team_name", "scraped_at"])}


def _gate(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    name, key = KINDS[kind]
    played = table(spark, sf_dir, "swehockey_standings").groupBy("season_group_id").agg(F.bool_or(F.coalesce("games_played", F.lit(0)) > 0).alias("has_games"))
    groups = table(spark, sf_dir, "league_groups").select("season_group_id").distinct()
    expected = groups.unionAll(groups.select((-F.col("season_group_id")).alias("season_group_id"))).join(played, "season_group_id", "left")  # the negative ones stand for groups not begun
    severity = Q.preseason_severity(F.col("has_games"), F.lit(kind != "standings"))
    return Q.batch_checks(table(spark, sf_dir, name), ["season_group_id"], key, expected, severity).select(F.lit(kind).alias("entity_name"), "*")


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every expected batch with their severity, batches without rows included."""
    a, b, c = (_gate(spark, sf_dir, k) for k in KINDS)
    return a.unionByName(b).unionByName(c)


def run_log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per kind of batch, gated before anything is published, and the state that its log ends in."""
    log, at = Q.RunLog(spark, _folder(spark, "runs"), "stats", "swehockey"), datetime.fromisoformat(AS_OF)
    for kind in KINDS:
        checks = _gate(spark, sf_dir, kind)
        log.start(kind, at, [3, 1, 3])
        failed = 0 if Q.publish_if_passed(checks, []) else 1
        log.finish(kind, at, 10, 10, failed)
    log.start("broken", at, [])
    log.finish("broken", at, 0, 0, error="no page")
    log.start("open", at, [2])
    events = spark.read.schema(Q.RUN_SCHEMA).parquet(log.path)
    last = latest_by_key(events, ["run_id"], [F.col("finished_at").isNull(), F.desc("event_id")])
    return last.select("run_id", "status", "loaded_rows", "failed_steps", F.array_join("season_group_ids", ",").alias("groups"))


SOURCES = ("swehockey_player_stats", "swehockey_goalie_stats", "swehockey_standings", "swehockey_schedule")


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered sources, the age of their newest row and what their declared freshness (3 and 12 hours) says; and all together."""
    out = None
    for n in SOURCES:
        t = table(spark, sf_dir, n).agg(F.max("scraped_at").alias("newest")).select(F.lit(n).alias("source"), "newest")
        out = t if out is None else out.unionByName(t)
    out = out.unionByName(out.agg(F.max("newest").alias("newest")).select(F.lit("all").alias("source"), "newest"))
    hours = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3_600_000_000)
    return out.select("source", "newest", hours.cast("long").alias("hours"), Q.declared_freshness(hours).alias("freshness"))


#: Plain staging models: source, condition, and columns as (name, expression, type); '' casts nothing to a typed null.
MODELS: dict[str, tuple[str, str, list[tuple[str, str, str]]]] = {
    "stg_articles": ("tmp_latest_silly", "true", [("article_id", "item_id", "string"), ("title", "title", "string"), ("tag", "tag", "string"), ("source", "source", "string"), ("url", "url", "string"), ("published", "substring(date, 1, 10)", "date"), ("priority", "null", "bigint")]),
    "stg_attendance": ("swehockey_schedule", "spectators is not null", [("match_id", "row_id", "string"), ("team_id", "team_id", "string"), ("attendance", "spectators", "bigint"), ("arena_capacity", "null", "bigint"), ("ticket_revenue_estimate", "null", "decimal(38,9)"), ("source_system", "coalesce(source, 'swehockey')", "string"), ("source_record_id", "run_id", "string"), ("ingested_at", "scraped_at", "timestamp")]),
    "stg_event_players": ("events", "event_type in ('purchase', 'error')", [("event_id", "event_id", "string"), ("player_id", "user_id", "string"), ("team_id", "user_id % 8", "string"), ("event_player_role", "case when event_type = 'purchase' then 'scorer' else 'penalised' end", "string"), ("source_system", "'events'", "string"), ("source_record_id", "null", "string"), ("ingested_at", "ts", "timestamp")]),
    "stg_goalie_games": ("swehockey_goalie_stats", "true", [("row_key", "row_id", "string"), ("shots_against", "shots_against", "bigint"), ("saves", "saves", "bigint"), ("save_pct", "coalesce(save_pct, 0)", "double"), ("xga", "null", "decimal(38,9)"), ("toi_seconds", "toi_minutes * 60", "bigint"), ("started", "games_played > 0", "boolean"), ("source_system", "coalesce(source, 'swehockey')", "string")]),
    "stg_lineups": ("swehockey_player_stats", "games_played > 0", [("match_id", "season_group_id", "string"), ("player_id", "row_id", "string"), ("team_id", "team_id", "string"), ("position", "coalesce(position, '')", "string"), ("line_number", "jersey_number % 4", "bigint"), ("pair_number", "null", "bigint"), ("is_starter", "games_played > 10", "boolean")]),
    "stg_roster_status": ("roster_status_events", "true", [("roster_status_id", "roster_status_id", "string"), ("player_id", "player_id", "string"), ("season_id", "season_id", "string"), ("status_date", "status_date", "date"), ("status", "lower(status)", "string"), ("is_available", "is_available", "boolean"), ("is_injured", "is_injured", "boolean"), ("depth_role", "depth_role", "string"), ("updated_at", "updated_at", "timestamp")]),
    "stg_shots": ("events", "event_type = 'purchase'", [("event_id", "event_id", "string"), ("match_id", "event_id % 500", "string"), ("player_id", "user_id", "string"), ("shot_type", "null", "string"), ("distance", "value", "decimal(38,9)"), ("is_rebound", "value > 50", "boolean"), ("model_version", "'none'", "string"), ("xg", "null", "decimal(38,9)")]),
    "stg_financials": ("orders", "true", [("team_id", "o_custkey", "string"), ("season_id", "year(o_orderdate)", "string"), ("reporting_period", "month(o_orderdate)", "string"), ("revenue", "o_totalprice", "decimal(38,9)"), ("confidence_level", "o_orderstatus", "string"), ("updated_at", "o_orderdate", "timestamp")]),
    "stg_team_snapshots": ("swehockey_standings", "rank is not null", [("snapshot_date", "scraped_at", "date"), ("season_id", "season_group_id", "string"), ("team_id", "team_name", "string"), ("position", "rank", "bigint"), ("points", "points", "bigint"), ("form_last_5", "null", "string"), ("points_per_game", "case when games_played = 0 then 0 else round(points / games_played, 6) end", "double")]),
}


def staging_model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, condition, columns = MODELS[name]
    kinds = {"timestamp": "timestamp_ntz"}
    return table(spark, sf_dir, source).where(condition).select(*[F.expr(f"try_cast({e} as {kinds.get(t, t)})").alias(c) for c, e, t in columns])


def _model(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return staging_model(spark, sf_dir, name)

    query.__name__, query.__doc__ = name, f"Staging model of {MODELS[name][0]}: casts, defaults and typed nulls."
    return query


def _approved(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rows_of_successful_runs(table(spark, sf_dir, name), table(spark, sf_dir, "ingestion_runs").select("run_id", "event_id", "status", "started_at", "finished_at"))


def stg_stat_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of players: rows of approved runs, the newest of each season group, club and name."""
    p = latest_by_key(_approved(spark, sf_dir, "swehockey_player_stats"), ["season_group_id", "team_code", "player_name"], [F.desc("scraped_at"), F.desc("row_id")])
    return p.select(F.md5(F.concat_ws("-", F.col("season_group_id").cast("string"), F.coalesce("team_code", F.lit("")), F.coalesce("player_name", F.lit("")))).alias("player_key"), F.coalesce("player_name", F.lit("")).alias("player_name"), F.coalesce("source", F.lit("swehockey")).alias("source_system"), "row_id")


def stg_stat_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of approved runs, the newest record of each day, home and away name as stored, the day as a date where it is one."""
    s = latest_by_key(_approved(spark, sf_dir, "swehockey_schedule"), ["season_group_id", "match_date", "home_team", "away_team"], [F.desc("scraped_at"), F.desc("row_id")])
    return s.select("row_id", F.when(F.col("match_date").rlike(r"^\d{4}-\d\d-\d\d$"), F.expr("try_cast(match_date as date)")).alias("match_date"), F.coalesce("home_team", F.lit("")).alias("home_team"), F.coalesce("result", F.lit("")).alias("result"))


def fact_roster_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roster fact after a second load by ``updated_at``: its newest time is read from the table written first."""
    r, path = table(spark, sf_dir, "roster_status_events").select("roster_status_id", "player_id", "status", "updated_at").distinct(), _folder(spark, "fact")
    order = [F.desc("updated_at"), F.asc_nulls_first("status"), F.asc("player_id")]
    S.append(latest_by_key(r.where("updated_at < timestamp_ntz '2024-06-01 00:00:00'"), ["roster_status_id"], order), path)
    fact = spark.read.parquet(path)
    mark = fact.agg(F.max("updated_at")).first()[0]
    return upsert(fact, above_watermark(r, "updated_at", F.lit(mark).cast("timestamp_ntz")), ["roster_status_id"], order)


_OWN = (lineage_append, partition_reload, clustered_mart, raw_json_round_trip, row_changes, capped_cache, quality_gate, run_log_states, source_registry, stg_stat_players, stg_stat_schedule, fact_roster_incremental)
QUERIES = {f.__name__: f for f in (*_OWN, *map(_model, MODELS))}

_GOOD = "(run_id is null or run_id in (select run_id from (select * from ingestion_runs qualify row_number() over (partition by run_id order by finished_at is null, finished_at desc, started_at desc, event_id desc) = 1) where status = 'SUCCESS'))"


def _gate_sql(kind: str) -> str:
    name, key = KINDS[kind]
    part = lambda c: f"lower(trim(coalesce(cast({c} as varchar), ''), ' '))"
    empty = " or ".join(f"{part(c)} = ''" for c in key)
    severity = "'ERROR'" if kind == "standings" else "case when coalesce(h, false) then 'ERROR' else 'WARNING' end"
    return f"""select '{kind}' entity_name, season_group_id, c.check_name, c.severity, c.observed, c.passed from (
      with e as (select distinct season_group_id from league_groups union select distinct - season_group_id from league_groups),
      h as (select season_group_id, bool_or(games_played > 0) h from swehockey_standings group by 1),
      g as (select season_group_id, count(*) n, count(*) filter (where {empty}) m, count(*) - count(distinct ({", ".join(map(part, key))})) r from {name} group by 1)
      select season_group_id, unnest([{{'check_name': 'rows_present', 'severity': {severity}, 'observed': coalesce(n, 0), 'passed': coalesce(n, 0) > 0}}, {{'check_name': 'missing_required', 'severity': 'ERROR', 'observed': coalesce(m, 0), 'passed': coalesce(m, 0) = 0}}, {{'check_name': 'duplicate_keys', 'severity': 'ERROR', 'observed': coalesce(r, 0), 'passed': coalesce(r, 0) = 0}}]) c
      from e left join h using (season_group_id) left join g using (season_group_id))"""


_GATE = " union all ".join(map(_gate_sql, KINDS))
_AGE = f"cast(floor((epoch_us(timestamp '{AS_OF}') - epoch_us(newest)) / 3600000000) as bigint)"
_EACH = " union all ".join(f"select '{n}' source, max(scraped_at) newest from {n}" for n in SOURCES)
SQL = {
    "lineage_append": f"select c_custkey, c_name, case when c_custkey % 2 = 0 then timestamp '{AS_OF}' end scraped_at, case when c_custkey % 2 = 0 then 'crm' end source, case when c_custkey % 2 = 0 then 'run-2' end run_id, case when c_custkey % 2 = 0 then 'https://crm.example/' || c_custkey end source_url from customer",
    "partition_reload": "select c_custkey, c_acctbal, c_nationkey from customer where c_nationkey >= 5 or c_acctbal >= 0",
    "clustered_mart": "select cast(scraped_at as date) as day, count(*) n, cast(sum(points) as bigint) points from swehockey_standings where year(scraped_at) = 2024 group by 1",
    "raw_json_round_trip": "select event_id, run_id, cast(loaded_rows as bigint) loaded_rows, cast(len(season_group_ids) as int) n_groups, error_message from ingestion_runs",
    "row_changes": "select s_suppkey, case when s_suppkey % 5 = 0 then upper(s_name) else s_name end s_name, round(case when s_suppkey % 5 = 0 then s_acctbal + 1 else s_acctbal end, 2) s_acctbal from (select s_suppkey, s_name, s_acctbal from supplier union all select -1, 'Supplier#new', 10.0) where case when s_suppkey % 5 = 0 then s_acctbal + 1 else s_acctbal end >= 0",
    "capped_cache": "select item_id, title, url from tmp_latest_silly order by item_id desc limit 200",
    "quality_gate": _GATE,
    "run_log_states": f"with c as ({_GATE}), f as (select entity_name, count(*) filter (where not passed and severity = 'ERROR') > 0 bad from c group by 1) select entity_name run_id, case when bad then 'FAILED_QUALITY' else 'SUCCESS' end status, cast(case when bad then 0 else 10 end as bigint) loaded_rows, cast(bad as int) failed_steps, '1,3' groups from f union all select 'broken', 'FAILED', 0, 0, '' union all select 'open', 'RUNNING', 0, 0, '2'",
    "source_registry": f"with s as ({_EACH}), t as (select * from s union all select 'all', max(newest) from s) select source, newest, {_AGE} as hours, case when newest is null or {_AGE} >= 12 then 'error' when {_AGE} >= 3 then 'warn' else 'pass' end freshness from t",
    "stg_stat_players": f"select md5(season_group_id || '-' || coalesce(team_code, '') || '-' || coalesce(player_name, '')) player_key, coalesce(player_name, '') player_name, coalesce(source, 'swehockey') source_system, row_id from swehockey_player_stats where {_GOOD} qualify row_number() over (partition by season_group_id, team_code, player_name order by scraped_at desc, row_id desc) = 1",
    "stg_stat_schedule": f"select row_id, case when regexp_matches(match_date, '^\\d{{4}}-\\d\\d-\\d\\d$') then try_cast(match_date as date) end match_date, coalesce(home_team, '') home_team, coalesce(result, '') result from swehockey_schedule where {_GOOD} qualify row_number() over (partition by season_group_id, match_date, home_team, away_team order by scraped_at desc, row_id desc) = 1",
    "fact_roster_incremental": "with r as (select distinct roster_status_id, player_id, status, updated_at from roster_status_events), a as (select * from r where updated_at < timestamp '2024-06-01' qualify row_number() over (partition by roster_status_id order by updated_at desc, status nulls first, player_id) = 1), b as (select * from r where updated_at > (select max(updated_at) from a) qualify row_number() over (partition by roster_status_id order by updated_at desc, status nulls first, player_id) = 1) select * from b union all select * from a where roster_status_id not in (select roster_status_id from b)",
    **{n: f"select {', '.join(f'try_cast({e} as {t}) {c}' for c, e, t in columns)} from {source} where {condition}".replace(" as string)", " as varchar)") for n, (source, condition, columns) in MODELS.items()},
}
