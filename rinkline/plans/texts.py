"""What is read out of texts and documents: recovered JSON, retags, impact, scores, times, snapshots of news, nested documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.functions.parse import squashed
from rinkline.operators.quality import freshness
from rinkline.operators.staging_area import shared_folder
from rinkline.plans.people import ACCENTS, PLAIN, folded
from rinkline.plans.staging import AS_OF
from rinkline.sources.html import table_rows
from rinkline.sources.tables import table

# Words of the rules, folded.
FORMER = ("tidigare", "ex-", "f.d.", "forna")
RETAG = (("EXTENSION", ("forlanger", "forlangde")), ("DEPARTURE", ("lamnar", "lamnade")), ("SIGNING", ("klar for", "ansluter", "varvar")))
IMPACT = (("staff", ("fysioterapeut", "assisterande", "tranare", "sportchef", "stab")), ("stronger squad", ("nyforvarv", "klar for", "ansluter")), ("gap in the squad", ("lamnar",)), ("continuity", ("forlanger",)), ("to be watched", ("rykte", "uppgifter")))
WOMEN = ("damlag", "damernas", "flickor", "damhockey", "dam-", "/dam")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tmp_latest_silly")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return F.coalesce(out, F.lit(False))


def _first(c: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], rest: Column) -> Column:
    out = None
    for name, words in rules:
        out = F.when(_any(c, words), name) if out is None else out.when(_any(c, words), name)
    return out.otherwise(rest)


def title_retag(spark: SparkSession, sf_dir: str, club: str = "norrvik") -> DataFrame:
    """Items tagged ÖVRIGT whose title alone says what happened at the club; titles on former players are left."""
    t = folded(F.col("title"))
    open_ = (F.col("tag") == "ÖVRIGT") & t.contains(club) & ~_any(t, FORMER)
    return _items(spark, sf_dir).select("item_id", F.when(F.coalesce(open_, F.lit(False)), _first(t, RETAG, F.col("tag"))).otherwise(F.col("tag")).alias("tag"))


def impact_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each title means for the squad, by ordered rules on its words, else by the level the model gave."""
    level = F.lower(F.coalesce(F.get_json_object("impact", "$.level"), F.lit("")))
    rest = F.when(level == "high", "important").when(level == "low", "minor").otherwise("relevant")
    return _items(spark, sf_dir).select("item_id", _first(folded(F.coalesce("title", F.lit(""))), IMPACT, rest).alias("impact_class"))


def womens_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on women's teams, by title, body, source and address together."""
    t = F.lower(F.concat_ws(" ", "title", "body", "source", "url"))
    return _items(spark, sf_dir).where(_any(t, WOMEN)).select("item_id")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per source, however it is written, and how many have a body."""
    s = F.lower(squashed(F.regexp_replace(F.coalesce("source", F.lit("")), r"\(.*?\)", "")))
    return _items(spark, sf_dir).groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count("body").alias("with_body"))


def feed_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 items of the feed by date and number; the cut is the page of the feed."""
    return _items(spark, sf_dir).where(F.col("date").rlike(r"^\d{4}-\d\d-\d\dT")).select("item_id", F.substring("date", 1, 19).alias("at")).orderBy(F.desc("at"), F.desc("item_id")).limit(100)


def _recovered(c: Column, schema: str) -> Column:
    """A list of objects out of a model's answer: code fences dropped, then the whole as a list, an object's list, the
    first list inside the text, or lines that are objects."""
    raw = F.trim(F.regexp_replace(c, r"```(?:json)?", ""))
    tries = lambda j, s: F.from_json(j, s, {"mode": "PERMISSIVE"})
    whole = F.when(raw.startswith("["), tries(raw, f"array<{schema}>"))
    keyed = F.when(raw.startswith("{"), tries(raw, f"struct<items:array<{schema}>>")["items"])
    inside = tries(F.nullif(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.lit("")), f"array<{schema}>")
    lines = F.filter(F.transform(F.filter(F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(F.trim(x), ",$", "")), lambda x: x.startswith("{")), lambda x: tries(x, schema)), lambda x: x.isNotNull())
    return F.coalesce(whole, keyed, inside, lines)


def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' labels out of answers in four forms: fenced list, keyed object, list inside prose, JSON lines."""
    one = lambda k: F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "label": "l'), (k % 3).cast("string"), F.lit('"}'))
    i = F.col("event_id")
    two = F.concat(one(i), F.lit(", "), one(i + 1))
    form = F.when(i % 4 == 0, F.concat(F.lit("```json\n["), two, F.lit("]\n```"))).when(i % 4 == 1, F.concat(F.lit('{"items": ['), two, F.lit("]}"))).when(i % 4 == 2, F.concat(F.lit("Here: ["), two, F.lit("] as asked."))).otherwise(F.concat(one(i), F.lit(",\nnot json\n"), one(i + 1)))
    e = table(spark, sf_dir, "events").select("event_id", F.explode(_recovered(form, "struct<id:long,label:string>")).alias("x"))
    return e.select("event_id", "x.id", "x.label")


def score_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores anywhere in a text against scores at its start only."""
    t = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("Slut: "), "result")).otherwise(F.col("result"))
    n = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit("")).cast("int")
    return table(spark, sf_dir, "swehockey_schedule").where("result is not null").select("row_id", n(r"^\s*(\d+)\s*-\s*\d+").alias("matched"), n(r"(\d+)\s*-\s*\d+").alias("searched"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times with and without a zone as UTC; others null."""
    text = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("doc_id") % 3 == 1, F.concat(text, F.lit("+02:00"))).otherwise(text)
    text = F.when(F.col("doc_id") % 11 == 0, "soon").otherwise(text)
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    zoned = F.when(zoned.rlike(r"[+-]\d\d:\d\d$"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    return table(spark, sf_dir, "documents").select("doc_id", F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")).cast("timestamp_ntz").alias("at"))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a rendered page, made absolute, those on the club kept, each title and address once."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    unesc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    i = _items(spark, sf_dir).where("title is not null").select(F.concat(F.lit("<p><a class='x' href=\"/nyheter/"), (F.col("item_id") % 50).cast("string"), F.lit('">'), esc(F.col("title")), F.lit("</a></p>")).alias("html"))
    a = i.select(F.explode(F.regexp_extract_all("html", F.lit(r'(?s)<a[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))).alias("a"))
    read = a.select(unesc(F.regexp_extract("a", r"(?s)>(.*?)</a>", 1)).alias("title"), F.concat(F.lit("https://club.example"), F.regexp_extract("a", r'href="([^"]*)"', 1)).alias("url"))
    return read.where(F.lower("title").contains("norrvik")).distinct()


def page_rows_filtered(spark: SparkSession, sf_dir: str, words: str = "norrvik") -> DataFrame:
    """Rows of transfer pages whose text names the club."""
    s = table(spark, sf_dir, "swehockey_standings").where("team_name is not null")
    page = F.concat(F.lit("<table><tr><td>"), F.col("row_id").cast("string"), F.lit("</td><td>"), F.replace(F.replace(F.col("team_name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td></tr></table>"))
    rows = table_rows(s.select("season_group_id", page.alias("html")), "season_group_id", "html")
    return rows.where(F.lower(F.array_join("cells", " ")).contains(words)).select(F.col("page_id").alias("season_group_id"), F.col("cells")[0].cast("long").alias("row_id"))


def news_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five snapshot files of the news with their counts, rows of broken files kept as errors, and their age."""
    path = f"{shared_folder(spark)}/news-{uuid.uuid4().hex}"
    i = _items(spark, sf_dir).where(F.col("date").rlike(r"^\d{4}-(0[1-9]|1[0-2])-"))
    lines = i.select(F.substring("date", 1, 7).alias("snapshot"), F.when(F.col("item_id") % 17 == 0, "{broken").otherwise(F.to_json(F.struct("item_id", "source"))).alias("value"))
    lines.write.partitionBy("snapshot").text(path)
    read = spark.read.schema("item_id long, source string, _corrupt_record string, snapshot string").option("mode", "PERMISSIVE").json(path)
    per = read.groupBy("snapshot").agg(F.count("item_id").alias("items"), F.count("_corrupt_record").alias("errors"), F.count_distinct("source").alias("sources")).orderBy(F.desc("snapshot")).limit(5)
    hours = F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.concat("snapshot", F.lit("-01 00:00:00")).cast("timestamp"))) / 3600)
    return per.select("snapshot", "items", "errors", "sources", freshness(hours).alias("freshness"))


def nested_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per league with nested groups, written as JSON text and opened again."""
    g = table(spark, sf_dir, "league_groups").select("league", F.struct("season_group_id", "season_label", "phase").alias("g"))
    d = g.groupBy("league").agg(F.to_json(F.struct(F.array_sort(F.collect_list("g")).alias("groups"), F.count(F.lit(1)).alias("n"))).alias("j"))
    return d.select("league", F.explode(F.from_json("j", "groups array<struct<season_group_id:long,season_label:string,phase:string>>, n long")["groups"]).alias("g")).select("league", "g.*")


def position_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each club's players of the newest snapshot by group of positions, and whether the squad is complete."""
    p = table(spark, sf_dir, "swehockey_player_stats")
    newest = p.withColumn("z", F.max("scraped_at").over(Window.partitionBy("season_group_id"))).where("scraped_at = z")
    n = lambda *x: F.count_if(F.coalesce(F.col("position").isin(*x), F.lit(False)))
    c = newest.groupBy("season_group_id", "team_id").agg(n("GK").alias("goalies"), n("LD", "RD", "D").alias("defenders"), F.count_if(~F.coalesce(F.col("position").isin("GK", "LD", "RD", "D"), F.lit(False))).alias("forwards"))
    return c.withColumn("status", F.when((F.col("goalies") >= 2) & (F.col("defenders") >= 6) & (F.col("forwards") >= 9), "complete").otherwise("open"))


def scraped_minus_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the newer half whose normalised title the older half lacks, the first of equal ones."""
    key = F.lower(squashed(F.coalesce("title", F.lit(""))))
    i = _items(spark, sf_dir).select("item_id", key.alias("k"), (F.col("item_id") % 2 == 0).alias("base"))
    new = i.where("not base and k <> ''").join(i.where("base").select("k").distinct(), "k", "left_anti")
    return new.groupBy("k").agg(F.min("item_id").alias("item_id"))


QUERIES = {f.__name__: f for f in (title_retag, impact_class, womens_items, source_counts, feed_sorted, json_recovery, score_search, iso_times, page_anchors, page_rows_filtered, news_snapshots, nested_document, position_groups, scraped_minus_baseline)}


def _sql_any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _sql_first(c: str, rules: tuple, rest: str) -> str:
    return "case " + " ".join(f"when {_sql_any(c, w)} then '{n}'" for n, w in rules) + f" else {rest} end"


_F = f"translate(lower(coalesce(title, '')), '{ACCENTS}', '{PLAIN}')"
_SQ = r"lower(trim(regexp_replace({c}, '[\s\x0b]+', ' ', 'g'), ' '))"
_BARE = r"regexp_replace(coalesce(source, ''), '\(.*?\)', '', 'g')"
_LEVEL = "lower(coalesce(json_extract_string(impact, '$.level'), ''))"
SQL = {
    "title_retag": f"with i as (select item_id, tag, {_F} t from tmp_latest_silly) select item_id, case when tag = 'ÖVRIGT' and contains(t, 'norrvik') and not {_sql_any('t', FORMER)} then {_sql_first('t', RETAG, 'tag')} else tag end tag from i",
    "impact_class": f"with i as (select item_id, {_F} t, {_LEVEL} lv from tmp_latest_silly) select item_id, {_sql_first('t', IMPACT, '''case lv when 'high' then 'important' when 'low' then 'minor' else 'relevant' end''')} impact_class from i",
    "womens_items": f"select item_id from (select item_id, lower(concat_ws(' ', title, body, source, url)) t from tmp_latest_silly) where {_sql_any('t', WOMEN)}",
    "source_counts": f"select {_SQ.format(c=_BARE)} source, count(*) n, count(body) with_body from tmp_latest_silly group by 1",
    "feed_sorted": r"select item_id, left(date, 19) as at from tmp_latest_silly where regexp_matches(date, '^\d{4}-\d\d-\d\dT') order by 2 desc, 1 desc limit 100",
    "json_recovery": "select event_id, event_id + d id, 'l' || ((event_id + d) % 3) \"label\" from events, (select unnest([0, 1]) d)",
    "score_search": r"select row_id, try_cast(regexp_extract(t, '^\s*(\d+)\s*-\s*\d+', 1) as int) matched, try_cast(regexp_extract(t, '(\d+)\s*-\s*\d+', 1) as int) searched from (select row_id, case when row_id % 2 = 0 then 'Slut: ' || result else result end t from swehockey_schedule where result is not null)",
    "iso_times": "select doc_id, case when doc_id % 11 = 0 then null when doc_id % 3 = 1 then date_trunc('second', published_at) - interval 2 hour else date_trunc('second', published_at) end as at from documents",
    "page_anchors": "select distinct title, 'https://club.example/nyheter/' || (item_id % 50) url from tmp_latest_silly where contains(lower(title), 'norrvik')",
    "page_rows_filtered": r"select season_group_id, row_id from swehockey_standings where contains(lower(regexp_replace(team_name, '[\s\x{a0}\x{85}]+', ' ', 'g')), 'norrvik')",
    "news_snapshots": r"with i as (select left(date, 7) s, item_id, source from tmp_latest_silly where regexp_matches(date, '^\d{4}-(0[1-9]|1[0-2])-')), p as (select s, count(*) filter (where item_id % 17 <> 0) items, count(*) filter (where item_id % 17 = 0) errors, count(distinct case when item_id % 17 <> 0 then source end) sources from i group by 1 order by 1 desc limit 5), h as (select *, floor(date_diff('second', cast(s || '-01' as timestamp), timestamp '" + AS_OF + "') / 3600) hh from p) select s snapshot, items, errors, sources, case when hh <= 6 then 'fresh' when hh <= 24 then 'stale' else 'critical' end freshness from h",
    "nested_document": "select league, season_group_id, season_label, phase from league_groups",
    "position_groups": "with n as (select * from (select *, max(scraped_at) over (partition by season_group_id) z from swehockey_player_stats) where scraped_at = z), c as (select season_group_id, team_id, count(*) filter (where position = 'GK') goalies, count(*) filter (where position in ('LD', 'RD', 'D')) defenders, count(*) filter (where coalesce(position, '') not in ('GK', 'LD', 'RD', 'D')) forwards from n group by 1, 2) select *, case when goalies >= 2 and defenders >= 6 and forwards >= 9 then 'complete' else 'open' end status from c",
    "scraped_minus_baseline": f"with i as (select item_id, {_SQ.format(c='''coalesce(title, '')''')} k from tmp_latest_silly) select k, min(item_id) item_id from i where item_id % 2 <> 0 and k <> '' and k not in (select k from i where item_id % 2 = 0) group by 1",
}
