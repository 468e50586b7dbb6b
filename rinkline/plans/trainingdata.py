"""Queries of the general training-data problems 2, 4 and 6, each with the same result in plain SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.functions.textkeys import ascii_key, trimmed_lower, typed_key
from rinkline.operators.changes import changed_columns, snapshot_changes
from rinkline.operators.history import attribute_history, versions_of
from rinkline.operators.profile import LONG_MASK, Watch, column_profile, column_ranges
from rinkline.sources.tables import table

PLAYER_STATE = ["jersey_number", "position", "games_played", "goals", "assists", "points", "plus_minus", "pim"]
TEAM_STATE = ["rank", "games_played", "wins", "ot_wins", "ot_losses", "losses", "goal_diff", "points"]
#: The statuses a run may have.
RUN_STATUSES = ("RUNNING", "SUCCESS", "FAILED", "FAILED_QUALITY")


def player_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "swehockey_player_stats")
    return snapshot_changes(df, "season_group_id", "scraped_at", "row_id", [F.coalesce("team_id", F.lit("")), ascii_key(F.col("player_name"))], PLAYER_STATE, typed_key(F.col("player_name")))


def team_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "swehockey_standings")
    return snapshot_changes(df, "season_group_id", "scraped_at", "row_id", [ascii_key(F.col("team_name"))], TEAM_STATE, typed_key(F.col("team_name")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players and teams added, removed or changed between consecutive snapshots."""
    parts = [("swehockey_player_stats", player_changes), ("swehockey_standings", team_changes)]
    a, b = (f(spark, sf_dir).select(F.lit(n).alias("table_name"), "change", "old_row_id", "new_row_id") for n, f in parts)
    return a.unionByName(b)


def p2_changed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each column changed between the snapshots of each season group's standings."""
    c = changed_columns(team_changes(spark, sf_dir), TEAM_STATE)
    return c.select(F.col("group_key").alias("season_group_id"), "load_no", F.explode("columns").alias("column_name")).groupBy("season_group_id", "load_no", "column_name").agg(F.count(F.lit(1)).alias("n_changed"))


def _monday(c: str):
    return F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")


@dataclass(frozen=True)
class Loads:
    """How a table comes in loads: the group they follow one another in, their time, and the columns of the table."""

    group: str | None
    at: str
    columns: str
    unit: str = "exact"

    def keys(self) -> tuple[Column, Column]:
        at = {"exact": F.date_format(F.col(self.at), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "week": _monday(self.at), "month": F.date_format(self.at, "yyyy-MM"), "year text": F.regexp_extract(F.col(self.at).cast("string"), r"(?:19|20)\d\d", 0)}
        return (F.col(self.group).cast("string") if self.group else F.lit("")), at[self.unit]


_LINEAGE = " scraped_at:t source run_id source_url"
#: Columns with the types that matter to a profile: n whole number, t time, b boolean, none other.
LOADS = {
    "swehockey_player_stats": Loads("season_group_id", "scraped_at", "row_id:n season_group_id:n team_id team_code player_name jersey_number:n position games_played:n goals:n assists:n points:n plus_minus:n pim:n" + _LINEAGE),
    "swehockey_goalie_stats": Loads("season_group_id", "scraped_at", "row_id:n season_group_id:n team_id team_code goalie_name games_played:n shots_against:n saves:n goals_against:n save_pct gaa toi_minutes:n shutouts:n wins:n losses:n" + _LINEAGE),
    "swehockey_standings": Loads("season_group_id", "scraped_at", "row_id:n season_group_id:n team_name rank:n games_played:n wins:n ot_wins:n ot_losses:n losses:n goal_diff:n points:n" + _LINEAGE),
    "swehockey_schedule": Loads("season_group_id", "scraped_at", "row_id:n season_group_id:n team_id match_date home_team away_team result status period_results spectators:n" + _LINEAGE),
    "ingestion_runs": Loads("pipeline_name", "started_at", "event_id run_id pipeline_name source trigger_type pipeline_version status started_at:t finished_at:t fetched_rows:n loaded_rows:n failed_steps:n season_group_ids metadata_json error_message", "week"),
    "data_quality_runs": Loads("pipeline_name", "checked_at", "quality_run_id run_id pipeline_name entity_name season_group_id:n check_name severity passed:b observed_value expected_value details checked_at:t", "week"),
    "roster_status_events": Loads("source_system", "ingested_at", "roster_status_id player_id team_id season_id status_date status status_reason source is_available:b is_loaned:b is_injured:b is_junior:b is_import:b depth_role line_role source_system source_record_id ingested_at:t updated_at:t", "week"),
    "tmp_latest_silly": Loads(None, "date", "item_id:n title body source url date tag ai_analysis impact", "year text"),
    "documents": Loads(None, "published_at", "doc_id:n text lang source n_chars:n team_code published_at:t", "month"),
}
WATCHES = {
    "ingestion_runs": Watch("status", RUN_STATUSES, lambda v: v == "SUCCESS", lambda: F.col("finished_at").isNotNull()),
    "data_quality_runs": Watch("passed", None, lambda v: v, lambda: F.col("passed").isNotNull()),
}


def _profile(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, ranges: bool = True) -> DataFrame:
    spec = LOADS[name]
    group, at = spec.keys()
    df = table(spark, sf_dir, name).withColumns({"load_group": group, "load_at": at})
    watches = [WATCHES[name]] if name in WATCHES else []
    return column_profile(df, ["load_group", "load_at"], "load_at", columns or [c.split(":")[0] for c in spec.columns.split()], watches=watches, ranges=ranges)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of ingestion_runs.status and data_quality_runs.passed with nulls, foreign values or a shifted share: the
    findings of the column profile, which come from its masks."""
    both = [_profile(spark, sf_dir, n, [w.column], ranges=False).select(F.lit(n).alias("table_name"), "column_name", F.col("load_group").alias("pipeline_name"), F.col("load_at").alias("load_week"), F.explode("findings").alias("finding")) for n, w in WATCHES.items()]
    return both[0].unionByName(both[1])


def _all_profiles(spark: SparkSession, sf_dir: str, shown: list[str], ranges: bool) -> DataFrame:
    one = lambda n: _profile(spark, sf_dir, n, ranges=ranges).select(F.lit(n).alias("table_name"), "load_group", "load_at", "column_name", *shown)
    with ThreadPoolExecutor(len(LOADS)) as pool:  # the tables' counts are written side by side
        return reduce(DataFrame.unionByName, pool.map(one, LOADS))


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table, profiled per load."""
    return _all_profiles(spark, sf_dir, ["n_rows", "n_null", "min_value", "max_value", "n_rare", "top_mask", "drift"], True)


def p4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of every column of every table per load, by sketch (relative standard error 2.3 %)."""

    def part(n: str) -> DataFrame:
        spec = LOADS[n]
        group, at = spec.keys()
        df = table(spark, sf_dir, n).withColumns({"load_group": group, "load_at": at})
        return column_ranges(df, ["load_group", "load_at"], [c.split(":")[0] for c in spec.columns.split()]).select(F.lit(n).alias("table_name"), "load_group", "load_at", "column_name", "n_distinct")

    return reduce(DataFrame.unionByName, map(part, LOADS))


ROSTER_STATE = ["status", "is_available", "is_loaned", "is_injured", "is_junior", "is_import", "depth_role", "line_role"]


def roster_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "roster_status_events").where("status is not null")
    read = {c: trimmed_lower(F.col(c)) if c == "status" else F.col(c).cast("string") for c in ROSTER_STATE}
    return attribute_history(df, [F.col("player_id"), F.col("season_id")], F.col("status_date"), F.col("roster_status_id"), read, F.col("updated_at"))


def rank_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "swehockey_standings").where("rank is not null")
    return attribute_history(df, [F.col("season_group_id"), ascii_key(F.col("team_name"))], F.col("scraped_at"), F.col("row_id"), {c: F.col(c) for c in ("rank", "points")}, spelled=typed_key(F.col("team_name")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of roster status and of rank with the rows that open and close them."""
    parts = [("roster", versions_of(roster_history(spark, sf_dir), "status")), ("rank", versions_of(rank_history(spark, sf_dir), "rank"))]
    a, b = (df.select(F.lit(n).alias("kind"), F.col("id").cast("string").alias("opened_by"), F.coalesce(F.col("closed_by").cast("string"), F.lit("")).alias("closed_by")) for n, df in parts)
    return a.unionByName(b)


def p6_roster_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods in which each player's roster status and roles were valid, one row for each change of any of them."""
    h = roster_history(spark, sf_dir)
    return h.select(F.col("entity.e0").alias("player_id"), F.col("entity.e1").alias("season_id"), *ROSTER_STATE, "valid_from", "valid_to")


_KEY = r"coalesce(nullif(ltrim(array_to_string(list_sort(string_split_regex(lower({c}), '[^a-z0-9]+')), ' ')), ''), lower({c}), '')"


def _changes_sql(source: str, entity: str, compare: list[str]) -> str:
    n = len(compare)
    cols = ", ".join(compare)
    same = " and ".join(f"a.{c} is not distinct from b.{c}" for c in compare)
    assert n
    return f"""(
      with loads as (select season_group_id, scraped_at, dense_rank() over (partition by season_group_id order by scraped_at) k from {source} where scraped_at is not null group by 1, 2),
      rows_ as (select t.season_group_id, l.k, {entity} e, row_id, {cols} from {source} t join loads l on t.season_group_id is not distinct from l.season_group_id and t.scraped_at = l.scraped_at),
      one as (select * from rows_ qualify row_number() over (partition by season_group_id, k, e order by row_id) = 1),
      tops as (select season_group_id, max(k) top from loads group by 1)
      select 'changed' change, a.row_id old_row_id, b.row_id new_row_id, a.season_group_id, b.k load_no from one a join one b on a.season_group_id is not distinct from b.season_group_id and a.e = b.e and b.k = a.k + 1 where not ({same})
      union all
      select 'added', 0, b.row_id, b.season_group_id, b.k from one b where b.k > 1 and not exists (select 1 from one a where a.season_group_id is not distinct from b.season_group_id and a.e = b.e and b.k = a.k + 1)
      union all
      select 'removed', a.row_id, 0, a.season_group_id, a.k + 1 from one a join tops using (season_group_id) where a.k < top and not exists (select 1 from one b where a.season_group_id is not distinct from b.season_group_id and a.e = b.e and b.k = a.k + 1)
    )"""


_SIGNS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\p{{Lu}}+', 'A', 'g'), '[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]+', 'a', 'g'), '\p{{N}}+', '9', 'g'), '[\s\x{{a0}}\x{{0b}}]+', '_', 'g')"


def _profile_sql(name: str, spec: Loads) -> str:
    at = {"exact": f"strftime({spec.at}, '%Y-%m-%d %H:%M:%S.%f')", "week": f"strftime(date_trunc('week', {spec.at}), '%Y-%m-%d')", "month": f"strftime({spec.at}, '%Y-%m')", "year text": f"regexp_extract({spec.at}, '(?:19|20)\\d\\d')"}[spec.unit]
    group = f"cast({spec.group} as varchar)" if spec.group else "''"
    cells, ends = [], []
    for c, kind in ((x + ":").split(":")[:2] for x in spec.columns.split()):
        text = f"strftime({{c}}({c}), '%Y-%m-%d %H:%M:%S.%f')" if kind == "t" else f"cast({{c}}({c}) as varchar)"
        mask = {"n": f"case when {c} < 0 then '-9' when {c} >= 0 then '9' end", "b": f"cast({c} as varchar)", "t": f"case when epoch_us({c}) % 1000000 = 0 then '9-9-9_9:9:9' when {c} is not null then '9-9-9_9:9:9.9' end"}.get(kind)
        if mask is None:
            m = _SIGNS.format(c=f"cast({c} as varchar)")
            if (name, c) == ("ingestion_runs", "status"):
                m = f"case when status in {RUN_STATUSES} then status else {m} end"
            mask = f"(select case when length(m) <= {LONG_MASK} then m else '~' || array_to_string(list_sort(list_distinct(regexp_extract_all(m, '(?s).'))), '') end from (select {m} m))"
        cells.append(f"select g, ld, '{c}' column_name, {mask} mask, count(*) n from base group by 1, 2, 3, 4")
        ends.append(f"select g, ld, '{c}' column_name, {text.format(c='min')} lo, {text.format(c='max')} hi from base group by 1, 2")
    return f"""
      select '{name}' table_name, g load_group, ld load_at, column_name, n_rows, n_null, min_value, max_value, n_rare, top_mask, case when k > 1 then round(moved, 6) end drift from (
        with base as (select *, {group} g, {at} ld from {name}),
        cells as materialized ({" union all ".join(cells)}),
        marked as (select *, mask is not null and sum(n) over (partition by column_name, mask) / sum(case when mask is not null then n end) over (partition by column_name) < 0.01 is_rare from cells),
        loads as (select g, ld, column_name, cast(sum(n) as bigint) n_rows, cast(coalesce(sum(n) filter (where mask is null), 0) as bigint) n_null, cast(coalesce(sum(n) filter (where is_rare), 0) as bigint) n_rare, list(mask order by n desc, mask desc) filter (where mask is not null)[1] top_mask, row_number() over (partition by g, column_name order by ld nulls first) k from marked group by 1, 2, 3),
        ends as ({" union all ".join(ends)}),
        steps as (select l.g, l.column_name, mask, unnest([k, k + 1]) k, unnest([n / n_rows, - n / n_rows]) d from cells c join loads l on c.g is not distinct from l.g and c.ld is not distinct from l.ld and c.column_name = l.column_name),
        moves as (select g, column_name, k, sum(abs(d)) / 2 moved from (select g, column_name, mask, k, sum(d) d from steps group by 1, 2, 3, 4) group by 1, 2, 3)
        select l.*, moved, e.lo min_value, e.hi max_value from loads l join moves m on l.g is not distinct from m.g and l.column_name = m.column_name and l.k = m.k join ends e on l.g is not distinct from e.g and l.ld is not distinct from e.ld and l.column_name = e.column_name)"""



def _findings_sql(source: str, column: str, at: str, base: str, hit: str, outside: str) -> str:
    return f"""
      select '{source}' table_name, '{column}' column_name, pipeline_name, load_week, finding from (
        with l as (select pipeline_name, strftime(date_trunc('week', {at}), '%Y-%m-%d') load_week, count(*) filter (where {column} is null) n0, count(*) filter (where {outside}) n1, count(*) filter (where {base}) b, count(*) filter (where {base} and {hit}) h from {source} group by 1, 2)
        select pipeline_name, load_week, 'null' finding from l where n0 > 0
        union all select pipeline_name, load_week, 'invalid' from l where n1 > 0
        union all select pipeline_name, load_week, 'shift' from (select *, lag(h) over w h0, lag(b) over w b0 from l where b > 0 window w as (partition by pipeline_name order by load_week)) where 10 * abs(h * b0 - h0 * b) >= 3 * b * b0
      )"""


def _versions_sql(kind: str, held: str) -> str:
    return f"""
      select '{kind}' kind, id opened_by, coalesce(lead(id) over (partition by e order by t), '') closed_by from (
        select * from (select *, lag(v) over (partition by e order by t) was, row_number() over (partition by e order by t) n from ({held})) where n = 1 or v is distinct from was
      )"""


_ROSTER = r"select (player_id, season_id) e, status_date t, roster_status_id id, regexp_replace(lower(status), '^[\s\x{a0}\x{2009}]+|[\s\x{a0}\x{2009}]+$', '', 'g') v from roster_status_events where status is not null and status_date is not null qualify row_number() over (partition by player_id, season_id, status_date order by updated_at desc nulls last, roster_status_id) = 1"
_ROSTER_STATE = "select player_id, season_id, status_date t, " + ", ".join(r"regexp_replace(lower(status), '^[\s\x{a0}\x{2009}]+|[\s\x{a0}\x{2009}]+$', '', 'g') status" if c == "status" else f"cast({c} as varchar) {c}" for c in ROSTER_STATE) + " from roster_status_events where status is not null and status_date is not null qualify row_number() over (partition by player_id, season_id, status_date order by updated_at desc nulls last, roster_status_id) = 1"
_RANK = f"select (season_group_id, {_KEY.format(c='team_name')}) e, scraped_at t, cast(row_id as varchar) id, rank v from swehockey_standings where rank is not null and scraped_at is not null qualify row_number() over (partition by season_group_id, {_KEY.format(c='team_name')}, scraped_at order by row_id) = 1"
_TEAM_CHANGES = _changes_sql("swehockey_standings", _KEY.format(c="team_name"), TEAM_STATE)
_PLAYER_CHANGES = _changes_sql("swehockey_player_stats", f"(coalesce(team_id, ''), {_KEY.format(c='player_name')})", PLAYER_STATE)

QUERIES = {"p2_found": p2_found, "p2_changed_columns": p2_changed_columns, "p4_found": p4_found, "p4_profile": p4_profile, "p4_distinct": p4_distinct, "p6_found": p6_found, "p6_roster_periods": p6_roster_periods}

SQL = {
    "p2_found": f"select 'swehockey_player_stats' table_name, change, old_row_id, new_row_id from {_PLAYER_CHANGES} union all select 'swehockey_standings', change, old_row_id, new_row_id from {_TEAM_CHANGES}",
    "p4_found": _findings_sql("ingestion_runs", "status", "started_at", "finished_at is not null", "coalesce(status = 'SUCCESS', false)", "status not in ('RUNNING', 'SUCCESS', 'FAILED', 'FAILED_QUALITY')") + " union all " + _findings_sql("data_quality_runs", "passed", "checked_at", "passed is not null", "passed", "false"),
    "p6_found": _versions_sql("roster", _ROSTER) + " union all " + _versions_sql("rank", _RANK),
    "p6_roster_periods": f"select player_id, season_id, {', '.join(ROSTER_STATE)}, t valid_from, lead(t) over (partition by player_id, season_id order by t) valid_to from (select * from (select *, row_number() over w n, lag(x) over w was from (select *, ({', '.join(ROSTER_STATE)}) x from ({_ROSTER_STATE})) window w as (partition by player_id, season_id order by t)) where n = 1 or x is distinct from was)",
}
SQL["p4_profile"] = " union all ".join(_profile_sql(n, spec) for n, spec in LOADS.items())
SQL["p2_changed_columns"] = "select season_group_id, load_no, column_name, count(*) n_changed from (" + " union all ".join(
    f"select c.season_group_id, c.load_no, '{col}' column_name from {_TEAM_CHANGES} c join swehockey_standings a on a.row_id = old_row_id join swehockey_standings b on b.row_id = new_row_id where change = 'changed' and a.{col} is distinct from b.{col}" for col in TEAM_STATE
) + ") group by 1, 2, 3"
