"""Model formulas over aggregates, joins of names, feeds of other kinds, and what is read out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.functions.parse import clock_seconds, squashed
from rinkline.functions.textkeys import word_parts
from rinkline.plans.domain import EVENTS_SQL, game_events
from rinkline.plans.people import ACCENTS, PLAIN, _goalies, _players, folded
from rinkline.sources.tables import table

# What a higher league costs a goalie, thresholds, targets and age steps.
GOALIE_STEP_SV, GOALIE_STEP_GAA, GOALIE_GREEN, GOALIE_AMBER = 1.8, 0.60, 91.0, 89.2
TARGETS = {"pp_pct": 18.0, "pk_pct": 77.0, "goalie_sv": 90.0, "special_teams_index": 95.0}
GOALIE_AGES = ((23, 0.05), (29, 0.0), (33, -0.04), (200, -0.10))
DEFAULT_AGE = {"skater": 26, "goalie": 28}


def special_teams_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power play and penalty killing of each team in its own games: goals per penalty of the opponents, penalties killed,
    and their sum."""
    e = game_events(spark, sf_dir).select("game_id", "team", "kind", "power_play", "minutes")
    count = lambda c: F.count_if(c).cast("long")
    per = e.groupBy("game_id", "team").agg(count((F.col("kind") == "goal") & F.col("power_play")).alias("ppg"), count(F.col("kind") == "penalty").alias("pen"), F.sum(F.when(F.col("kind") == "penalty", F.coalesce("minutes", F.lit(2))).otherwise(0)).alias("pim"))
    both = F.sum("ppg").over(Window.partitionBy("game_id")), F.sum("pen").over(Window.partitionBy("game_id"))  # a game has a few teams
    t = per.select("team", "ppg", "pen", "pim", (both[0] - F.col("ppg")).alias("opp_ppg"), (both[1] - F.col("pen")).alias("opp_pen")).groupBy("team").agg(*[F.sum(c).alias(c) for c in ("ppg", "pen", "pim", "opp_ppg", "opp_pen")], F.count(F.lit(1)).alias("games"))
    pp, pk = 100 * F.col("ppg") / F.greatest("opp_pen", F.lit(1)), 100 * (F.col("pen") - F.col("opp_ppg")) / F.greatest("pen", F.lit(1))
    return t.select("team", "games", F.col("ppg").alias("pp_goals"), F.round(pp, 4).alias("pp_pct"), F.round(pk, 4).alias("pk_pct"), F.round(pp + pk, 4).alias("special_teams_index"), F.round(F.col("pim") / F.greatest("games", F.lit(1)), 4).alias("pim_per_game"))


def scoring_bins_for_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals for and against each team in six ten-minute bins of regular time, empty bins included."""
    e = game_events(spark, sf_dir)
    minute = (F.col("period") - 1) * 20 + F.floor(clock_seconds(F.col("clock")) / 60)
    g = e.where("kind = 'goal' and period <= 3").groupBy("game_id", "team", F.floor(minute / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    plays = e.select("game_id", "team").distinct()
    made = g.groupBy("team", "bin").agg(F.sum("n").alias("made"))
    taken = plays.join(g.withColumnRenamed("team", "by"), "game_id").where("team <> by").groupBy("team", "bin").agg(F.sum("n").alias("taken"))
    grid = plays.select("team").distinct().select("team", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("bin"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return grid.join(made, ["team", "bin"], "left").join(taken, ["team", "bin"], "left").select("team", "bin", n("made").alias("goals_for"), n("taken").alias("goals_against"))


def goalie_step_and_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goalies carried to a higher league (not those without a percentage) and along an age curve."""
    g = _goalies(spark, sf_dir).where("games_played > 0 and gaa is not null")
    age = (F.lit(18) + F.col("row_id") % 20).cast("int")
    sv, gaa = F.when(F.coalesce("save_pct", F.lit(0.0)) == 0, 0.0).otherwise(F.col("save_pct") - GOALIE_STEP_SV), F.col("gaa") + GOALIE_STEP_GAA
    m = None
    for limit, step in GOALIE_AGES:
        m = F.when(age < limit, step) if m is None else m.when(age < limit, step)
    q = g.select("row_id", age.alias("age"), F.round(sv, 4).alias("proj_sv"), F.round(gaa, 4).alias("proj_gaa"), m.alias("m"))
    return q.select("row_id", "age", "proj_sv", "proj_gaa", F.when(F.col("proj_sv") >= GOALIE_GREEN, "GREEN").when(F.col("proj_sv") >= GOALIE_AMBER, "AMBER").otherwise("RED").alias("readiness"), F.round(F.col("proj_sv") + 10 * F.col("m"), 4).alias("aged_sv"), F.round(F.col("proj_gaa") * (1 - F.col("m")), 4).alias("aged_gaa"))


def benchmarks_vs_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's special teams and the best goalie's percentage (0 without any) against the targets."""
    best = _goalies(spark, sf_dir).agg(F.coalesce(F.max("save_pct"), F.lit(0.0)).alias("goalie_sv"))
    t = special_teams_index(spark, sf_dir).crossJoin(F.broadcast(best))  # one row, an aggregate without keys
    cells = F.array(*[F.struct(F.lit(k).alias("benchmark"), F.col(k).alias("current"), F.lit(v).alias("target")) for k, v in TARGETS.items()])
    return t.select("team", F.explode(cells).alias("b")).select("team", "b.benchmark", "b.current", "b.target", F.round(F.col("b.current") - F.col("b.target"), 4).alias("diff"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(word_parts(folded(c)), lambda t: F.length(t) > 1))


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players and goalies of one club that share a part of their names, with how many they share."""
    key = ["season_group_id", "team_id"]
    n = _players(spark, sf_dir).select(*key, "row_id", F.lower(F.trim("player_name")).alias("name"), _tokens(F.col("player_name")).alias("nt"))
    r = _goalies(spark, sf_dir).select(*key, F.col("row_id").alias("roster_row"), F.lower(F.trim("goalie_name")).alias("roster_name"), _tokens(F.col("goalie_name")).alias("rt"))
    met = n.withColumn("t", F.explode("nt")).join(r.withColumn("t", F.explode("rt")), [*key, "t"])
    return met.groupBy("row_id", "roster_row").agg(F.count(F.lit(1)).alias("common"), F.any_value(F.col("name") == F.col("roster_name")).alias("equal"))


def name_match_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's first roster row by each rule: equal names or two shared parts; any shared part."""
    m = _meetings(spark, sf_dir)
    strict = F.min(F.when(F.col("equal") | (F.col("common") >= 2), F.col("roster_row")))
    return m.groupBy("row_id").agg(strict.alias("strict_row"), F.min("roster_row").alias("any_row"))


def exact_else_fuzzy_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's age (invented from roster rows): of the equal name, else of a name that shares a part, else the default."""
    age = lambda c: 18 + c % 20
    m = _meetings(spark, sf_dir).groupBy("row_id").agg(F.min(F.when(F.col("equal"), F.col("roster_row"))).alias("exact"), F.min("roster_row").alias("fuzzy"))
    p = _players(spark, sf_dir).select("row_id", F.when(F.col("position") == "GK", DEFAULT_AGE["goalie"]).otherwise(DEFAULT_AGE["skater"]).alias("usual"))
    return p.join(m, "row_id", "left").select("row_id", F.coalesce(age(F.col("exact")), age(F.col("fuzzy")), F.col("usual")).cast("int").alias("age"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("default").alias("found"))


def best_goalie_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each club's goalies the one with the best percentage, then the most games."""
    w = Window.partitionBy("season_group_id", "team_id").orderBy(F.desc_nulls_last("save_pct"), F.desc("games_played"), "row_id")
    return _goalies(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select("season_group_id", "team_id", "row_id")


def outsider_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goalies of playoff groups held against those of the league's regular groups: the share that is not better, 50 if
    there are none. Counted by running sums over the union, so no goalie is paired with all others."""
    groups = table(spark, sf_dir, "league_groups").select("season_group_id", "league", "phase").distinct()
    g = _goalies(spark, sf_dir).where("save_pct is not null").join(groups, "season_group_id")
    inside = F.when(F.col("phase") == "regular", 1).otherwise(0)
    upto = F.sum(inside).over(Window.partitionBy("league").orderBy("save_pct").rangeBetween(Window.unboundedPreceding, 0))
    n = F.sum(inside).over(Window.partitionBy("league"))
    return g.select("row_id", "phase", F.when(n == 0, 50.0).otherwise(F.round(100 * upto / n, 4)).alias("percentile")).where("phase <> 'regular'").drop("phase")


def labels_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items whose tag the model's label replaces where it gives one."""
    i = table(spark, sf_dir, "tmp_latest_silly")
    labels = i.select("item_id", F.get_json_object("ai_analysis", "$.tag").alias("label")).where("label is not null and label <> ''")
    return i.select("item_id", "tag").join(labels, "item_id", "left").select("item_id", F.coalesce("label", "tag").alias("tag"), F.col("label").isNotNull().alias("relabelled"))


def position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each goalie name among the club's players: the first hit, 'F' if there is none."""
    key = ["season_group_id", "team_id"]
    roster = _players(spark, sf_dir).where("position is not null").select(*key, F.lower(F.trim("player_name")).alias("name"), F.struct("row_id", "position").alias("p")).groupBy(*key, "name").agg(F.min("p").alias("p"))
    g = _goalies(spark, sf_dir).select(*key, "row_id", F.lower(F.trim("goalie_name")).alias("name"))
    return g.join(roster, [*key, "name"], "left").select("row_id", F.coalesce("p.position", F.lit("F")).alias("position"))


def engagement_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's two events with the highest engagement: likes and twice the shares."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") + 2 * F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))).cast("long").alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")
    return e.withColumn("place", F.row_number().over(w)).where("place <= 2").select("user_id", "place", "event_id", "score")


def item_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each item's source, address and title, and how many items share it."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    f = table(spark, sf_dir, "tmp_latest_silly").select("item_id", F.sha2(F.concat_ws("|", part("source"), part("url"), part("title")), 256).alias("fingerprint"))
    return f.groupBy("fingerprint").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))


def rfc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days out of RFC 2822 dates, as feeds write them; what is none falls to a given day."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "no date").otherwise(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).alias("pub"))
    bare = F.regexp_extract("pub", r"^\w{3}, (\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1)
    return d.select("doc_id", F.coalesce(F.to_date(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))), F.lit("2025-06-01").cast("date")).alias("day"))


_RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string>>>"


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items of each tag as an RSS feed, and the items of the feeds read back from the XML."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    i = table(spark, sf_dir, "tmp_latest_silly").where("url is not null and url <> ''").select(F.coalesce("tag", F.lit("")).alias("feed"), F.pmod("item_id", F.lit(64)).alias("file"), "item_id", F.concat(F.lit("<item><title>id "), F.col("item_id").cast("string"), F.lit("</title><link>"), esc(F.trim("url")), F.lit("</link></item>")).alias("x"))
    feeds = i.groupBy("feed", "file").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.array_sort(F.collect_list("x")), ""), F.lit("</channel></rss>")).alias("xml"))
    read = feeds.select("feed", F.explode(F.from_xml("xml", _RSS)["channel"]["item"]).alias("i"))
    return read.select("feed", F.regexp_extract("i.title", r"(\d+)", 1).cast("long").alias("item_id"), F.col("i.link").alias("link"))


def nested_api_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a social API (posts and their authors apart) joined by author inside each answer."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("page"), F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("author_id")).alias("post"), F.struct(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("user"), "user_id").alias("name")).alias("user"))
    answers = e.groupBy("page").agg(F.to_json(F.struct(F.collect_list("post").alias("data"), F.struct(F.collect_set(F.when(F.col("user.id") % 3 > 0, F.col("user"))).alias("users")).alias("includes"))).alias("json"))
    a = answers.select("page", F.from_json("json", "data array<struct<id:string,author_id:string>>, includes struct<users:array<struct<id:string,name:string>>>").alias("j"))
    posts = a.select("page", F.explode("j.data").alias("p")).select("page", F.col("p.id").alias("post_id"), "p.author_id")
    users = a.select("page", F.explode("j.includes.users").alias("u")).select("page", F.col("u.id").alias("author_id"), F.col("u.name").alias("author"))
    return posts.join(users, ["page", "author_id"], "left").select("page", "post_id", "author_id", "author")


def provider_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's JSON of each group's schedule: the first played match in which the own club takes part."""
    s = table(spark, sf_dir, "swehockey_schedule").select("season_group_id", F.struct("row_id", F.when(F.col("result").isNotNull(), "closed").otherwise("open").alias("status"), F.array(F.struct(F.col("home_team").alias("name")), F.struct(F.col("away_team").alias("name"))).alias("competitors")).alias("m"))
    j = s.groupBy("season_group_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("m")).alias("summaries"))).alias("json"))
    m = j.select("season_group_id", F.from_json("json", "summaries array<struct<row_id:long,status:string,competitors:array<struct<name:string>>>>")["summaries"].alias("m"))
    own = F.filter("m", lambda x: (x["status"] == "closed") & F.exists(x["competitors"], lambda c: F.coalesce(F.lower(c["name"]).contains("norrvik"), F.lit(False))))
    return m.select("season_group_id", F.try_element_at(own, F.lit(1))["row_id"].alias("first_match"))


def cut_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player names with an annotation typed behind them, cut at it."""
    n = table(spark, sf_dir, "swehockey_player_stats").where("player_name is not null").select("row_id", F.concat(squashed(F.col("player_name")), F.when(F.col("row_id") % 2 == 0, " Pos C, kontrakt 2026").otherwise("")).alias("typed"))
    return n.select("row_id", F.trim(F.coalesce(F.nullif(F.regexp_extract("typed", r"(?s)^(.*?)\s+\b(?:Pos|Kontrakt)\b", 1), F.lit("")), F.col("typed"))).alias("name"))


def parameterized_season(spark: SparkSession, sf_dir: str, league: str = "DIV-000000") -> DataFrame:
    """One league's season groups by a bound parameter, playoffs first, the newest first."""
    return spark.sql("select season_group_id, season_label, phase from {t} where league = :league order by case when phase = 'playoff' then 0 else 1 end, first_week desc", args={"league": league}, t=table(spark, sf_dir, "league_groups"))


QUERIES = {f.__name__: f for f in (special_teams_index, scoring_bins_for_against, goalie_step_and_curve, benchmarks_vs_targets, name_match_kinds, exact_else_fuzzy_age, best_goalie_candidate, outsider_percentiles, labels_overwrite, position_lookup, engagement_top2, item_fingerprints, rfc_dates, rss_items, nested_api_join, provider_first_match, cut_annotations, parameterized_season)}

_P = "p as (select * from (select *, max(scraped_at) over (partition by season_group_id) z from swehockey_player_stats) where scraped_at = z)"
_G = "g as (select * from (select *, max(scraped_at) over (partition by season_group_id) z from swehockey_goalie_stats) where scraped_at = z)"
_T = r"list_distinct(list_filter(string_split_regex(lower(upper(translate(lower({c}), '" + ACCENTS + "', '" + PLAIN + r"'))), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1))"
_MET = f"""{_P}, {_G}, n as (select season_group_id, team_id, row_id, lower(trim(player_name, ' ')) nm, unnest({_T.format(c='player_name')}) t from p), r as (select season_group_id, team_id, row_id roster_row, lower(trim(goalie_name, ' ')) rn, unnest({_T.format(c='goalie_name')}) t from g),
  m as (select n.row_id, roster_row, count(*) common, any_value(nm = rn) eq from n join r using (season_group_id, team_id, t) group by 1, 2)"""
_SPECIAL = f"""{EVENTS_SQL}, per as (select game_id, team, count(*) filter (where kind = 'goal' and power_play) ppg, count(*) filter (where kind = 'penalty') pen, sum(case when kind = 'penalty' then coalesce(minutes, 2) else 0 end) pim from ev group by 1, 2),
  opp as (select *, sum(ppg) over (partition by game_id) - ppg oppg, sum(pen) over (partition by game_id) - pen open_ from per),
  t as (select team, count(*) games, sum(ppg) ppg, sum(pen) pen, sum(pim) pim, sum(oppg) oppg, sum(open_) openp from opp group by 1),
  st as (select team, games, cast(ppg as bigint) pp_goals, round(100 * ppg / greatest(openp, 1), 4) pp_pct, round(100 * (pen - oppg) / greatest(pen, 1), 4) pk_pct, round(100 * ppg / greatest(openp, 1) + 100 * (pen - oppg) / greatest(pen, 1), 4) special_teams_index, round(pim / greatest(games, 1), 4) pim_per_game from t)"""
_LIMITS = " ".join(f"when age < {a} then {m}" for a, m in GOALIE_AGES)
SQL = {
    "special_teams_index": f"with {_SPECIAL} select * from st",
    "scoring_bins_for_against": f"""with {EVENTS_SQL}, g as (select game_id, team, cast(floor(((period - 1) * 20 + cast(left(clock, 2) as int)) / 10.0) as int) b from ev where kind = 'goal' and period <= 3), plays as (select distinct game_id, team from ev),
      made as (select team, b, count(*) n from g group by 1, 2), taken as (select plays.team, b, count(*) n from plays join g using (game_id) where plays.team <> g.team group by 1, 2)
      select team, cast(grid.b as int) bin, coalesce(made.n, 0) goals_for, coalesce(taken.n, 0) goals_against from (select distinct team, unnest(range(6)) b from plays) grid left join made using (team, b) left join taken using (team, b)""",
    "goalie_step_and_curve": f"""with {_G}, q as (select row_id, cast(18 + row_id % 20 as int) age, round(case when coalesce(save_pct, 0) = 0 then 0 else save_pct - {GOALIE_STEP_SV} end, 4) proj_sv, round(gaa + {GOALIE_STEP_GAA}, 4) proj_gaa from g where games_played > 0 and gaa is not null), z as (select *, case {_LIMITS} end m from q)
      select row_id, age, proj_sv, proj_gaa, case when proj_sv >= {GOALIE_GREEN} then 'GREEN' when proj_sv >= {GOALIE_AMBER} then 'AMBER' else 'RED' end readiness, round(proj_sv + 10 * m, 4) aged_sv, round(proj_gaa * (1 - m), 4) aged_gaa from z""",
    "benchmarks_vs_targets": f"with {_SPECIAL}, {_G}, b as (select coalesce(max(save_pct), 0.0) sv from g) " + " union all ".join(f"select team, '{k}' benchmark, {'sv' if k == 'goalie_sv' else k} as current, cast({v} as double) target, round({'sv' if k == 'goalie_sv' else k} - {v}, 4) diff from st, b" for k, v in TARGETS.items()),
    "name_match_kinds": f"with {_MET} select row_id, min(roster_row) filter (where eq or common >= 2) strict_row, min(roster_row) any_row from m group by 1",
    "exact_else_fuzzy_age": f"with {_MET}, k as (select row_id, min(roster_row) filter (where eq) e, min(roster_row) f from m group by 1) select p.row_id, cast(coalesce(18 + e % 20, 18 + f % 20, case when position = 'GK' then 28 else 26 end) as int) age, case when e is not null then 'exact' when f is not null then 'fuzzy' else 'default' end found from p left join k using (row_id)",
    "best_goalie_candidate": f"with {_G} select season_group_id, team_id, row_id from g qualify row_number() over (partition by season_group_id, team_id order by save_pct desc nulls last, games_played desc, row_id) = 1",
    "outsider_percentiles": f"with {_G}, l as (select distinct season_group_id, league, phase from league_groups), h as (select row_id, league, phase, save_pct from g join l using (season_group_id) where save_pct is not null) select a.row_id, case when n = 0 then 50.0 else round(100 * k / n, 4) end percentile from (select row_id, (select count(*) from h b where b.league = a.league and b.phase = 'regular') n, (select count(*) from h b where b.league = a.league and b.phase = 'regular' and b.save_pct <= a.save_pct) k from h a where phase <> 'regular') a",
    "labels_overwrite": "select item_id, coalesce(nullif(json_extract_string(ai_analysis, '$.tag'), ''), tag) tag, coalesce(json_extract_string(ai_analysis, '$.tag'), '') <> '' relabelled from tmp_latest_silly",
    "position_lookup": f"with {_P}, {_G}, r as (select season_group_id, team_id, lower(trim(player_name, ' ')) nm, arg_min(position, row_id) pos from p where position is not null group by 1, 2, 3) select g.row_id, coalesce(pos, 'F') as position from g left join r on g.season_group_id = r.season_group_id and g.team_id = r.team_id and lower(trim(goalie_name, ' ')) = nm",
    "engagement_top2": "select user_id, cast(row_number() over w as int) place, event_id, score from (select user_id, event_id, cast(floor(value) + 2 * coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) as bigint) score from events) window w as (partition by user_id order by score desc, event_id) qualify row_number() over w <= 2",
    "item_fingerprints": "select sha256(lower(trim(coalesce(source, ''), ' ')) || '|' || lower(trim(coalesce(url, ''), ' ')) || '|' || lower(trim(coalesce(title, ''), ' '))) fingerprint, min(item_id) item_id, count(*) n from tmp_latest_silly group by 1",
    "rfc_dates": "select doc_id, case when doc_id % 10 = 0 or published_at is null then date '2025-06-01' else cast(published_at as date) end as day from documents",
    "rss_items": "select coalesce(tag, '') feed, item_id, trim(url, ' ') link from tmp_latest_silly where url is not null and url <> ''",
    "nested_api_join": "select event_id % 97 page, cast(event_id as varchar) post_id, cast(user_id as varchar) author_id, case when user_id % 3 > 0 then 'user' || user_id end author from events",
    "provider_first_match": "select season_group_id, min(row_id) filter (where result is not null and (contains(lower(coalesce(home_team, '')), 'norrvik') or contains(lower(coalesce(away_team, '')), 'norrvik'))) first_match from swehockey_schedule group by 1",
    "cut_annotations": "select row_id, trim(regexp_replace(player_name, '[\\s\\x0b]+', ' ', 'g'), ' ') \"name\" from swehockey_player_stats where player_name is not null",
    "parameterized_season": "select season_group_id, season_label, phase from league_groups where league = 'DIV-000000'",
}
