"""News items: filters, classes, sentiment, feeds, and what is read out of pages."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkline.functions.parse import squashed
from rinkline.operators.latest import latest_by_key
from rinkline.operators.similar import pairs_over
from rinkline.operators.staging_area import staged
from rinkline.sources.html import article_texts, table_rows
from rinkline.sources.tables import table


@dataclass(frozen=True)
class Rules:
    """Ordered keyword rules; plain lower-case words, matched anywhere in the text."""

    club: tuple[str, ...] = ("norrvik",)
    excluded: tuple[str, ...] = ("damlag", "damernas", "flickor", "damhockey")
    classes: tuple[tuple[str, tuple[str, ...]], ...] = (("EXTENSION", ("förlänger", "förlängning", "nytt kontrakt", "nytt avtal")), ("SIGNING", ("värvar", "klar för", "ansluter", "nyförvärv")), ("DEPARTURE", ("lämnar", "lämnade", "tackar av")), ("RUMOUR", ("uppgifter", "rykte", "ryktas", "provspel", "jagar")))
    not_extension: tuple[str, ...] = ("vinst", "final", "vann", "förlorade")
    weights: dict[str, int] = field(default_factory=lambda: {"värvar": 2, "förlänger": 2, "seger": 2, "vinner": 2, "stabil": 1, "stark": 1, "poäng": 1, "lämnar": -2, "skada": -2, "förlorade": -2, "noll poäng": -1, "besviken": -1})


RULES = Rules()


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tmp_latest_silly").withColumn("t", F.lower(F.concat_ws(" ", "title", "body")))


def _class(text: Column, r: Rules) -> Column:
    out = None
    for name, words in r.classes:
        hit = _any(text, words) & (~_any(text, r.not_extension) if name == "EXTENSION" else F.lit(True))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def news_filter_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items about the club, without excluded coverage, with class and confidence."""
    i = _items(spark, sf_dir).where(_any(F.col("t"), RULES.club) & ~_any(F.col("t"), RULES.excluded))
    own = F.coalesce(F.lower("source").contains("klubb"), F.lit(False))
    return i.select("item_id", _class(F.col("t"), RULES).alias("class"), F.when(own, "high").otherwise("low").alias("confidence"))


def _sentiment(text: Column) -> Column:
    total = F.lit(0)
    for w, n in RULES.weights.items():
        total = total + F.when(F.contains(text, F.lit(w)), n).otherwise(0)
    return total + F.when(F.contains(text, F.lit("!")) & (total > 0), 1).otherwise(0)


def text_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted term sentiment of each item, as label and score."""
    i = _items(spark, sf_dir).select("item_id", _sentiment(F.col("t")).alias("d"))
    return i.select("item_id", "d", F.when(F.col("d") > 0, "positive").when(F.col("d") < 0, "negative").otherwise("neutral").alias("label"), F.least(F.lit(95), 56 + 8 * F.abs("d")).cast("int").alias("score"))


def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each sentiment among all items."""
    c = text_sentiment(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.select("label", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))


def _identity() -> Column:
    return F.concat_ws("|", F.lower(squashed(F.coalesce("source", F.lit("")))), F.lower(squashed(F.coalesce("title", F.lit("")))))


def new_since_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the later half of arrivals whose source and title the earlier half lacks."""
    i = table(spark, sf_dir, "tmp_latest_silly").select("item_id", _identity().alias("identity"))
    split = i.agg((F.max("item_id") / 2).alias("half")).first()["half"] or 0
    return i.where(F.col("item_id") > split).join(i.where(F.col("item_id") <= split).select("identity"), "identity", "left_anti").select("item_id", "identity")


def feed_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed: the club's own items before others; of equal URLs one, all without a URL, then of equal titles one."""
    i = table(spark, sf_dir, "tmp_latest_silly").select("item_id", F.coalesce("url", F.lit("")).alias("url"), F.lower(squashed(F.coalesce("title", F.lit("")))).alias("title_key"), F.when(F.lower("source").contains("klubb"), 0).otherwise(1).alias("priority"))
    order = [F.asc("priority"), F.asc("item_id")]
    kept = i.where("url = ''").unionByName(latest_by_key(i.where("url <> ''"), ["url"], order))
    return latest_by_key(kept, ["title_key"], order)


#: Whitespace as Python reads it, which the reference's title normalisation does.
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Titles in a block of comparisons, and of the first part of the greedy pass; each further part reaches PART times as far.
BLOCK, FIRST, PART = 2048, 2000, 4


def _plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{_SPACE}]", ""), f"[{_SPACE}]+", " "))


def _similar(texts: DataFrame, earlier: DataFrame, limit: float, first: bool) -> DataFrame:
    """``(item_id, other)``: titles with an earlier one of ``earlier`` in the same batch that they are over ``limit`` similar to.

    Every title meets every earlier one, block by block, so that no task holds more than two blocks.
    """
    n = lambda df, name: df.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = n(texts, "rows").join(n(earlier, "columns").withColumnRenamed("batch", "b"), F.col("batch").eqNullSafe(F.col("b"))).drop("b")
    tasks = max(1, min(2000, grid.agg(F.sum(F.col("rows") * F.col("columns"))).first()[0] or 1))
    grid = grid.withColumnRenamed("batch", "b")

    def blocks(df: DataFrame, own: str, other: str, counts: tuple[str, str], names: list[str]) -> DataFrame:
        spread = df.join(grid, F.col("batch").eqNullSafe(F.col("b"))).select("batch", "item_id", "t", F.pmod(F.xxhash64("item_id"), F.col(counts[0])).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(counts[1]) - 1)).alias(other))
        key = [F.col(c).alias(n) for c, n in zip(("batch", "r", "c"), names, strict=True)]
        return spread.select(*key, F.col("item_id").alias(f"{names[0]}_id"), F.col("t").alias(f"{names[0]}_t")).repartition(tasks, *names).groupBy(*names)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs_over(a["x_t"].tolist(), a["x_id"].to_numpy(), b["y_t"].tolist(), b["y_id"].to_numpy(), limit, first) if len(a) and len(b) else []
        return pd.DataFrame(pairs, columns=["item_id", "other"], dtype="int64")

    left, right = blocks(texts, "r", "c", ("rows", "columns"), ["x", "xr", "xc"]), blocks(earlier, "c", "r", ("columns", "rows"), ["y", "yr", "yc"])
    return left.cogroup(right).applyInPandas(compare, "item_id long, other long")


def greedy_distinct(items: DataFrame, limit: float = 0.70) -> DataFrame:
    """``(batch, item_id)`` of the items a greedy pass keeps: in order of id, each that is not over ``limit`` similar to a kept one.

    ``items`` has ``(batch, item_id, title)``. Similarity is the ratio of matching blocks of the two normalised titles.
    Equal titles are collapsed first (from 200 characters on the ratio of equal texts may be lower). The pass goes over the
    ids in a few parts of growing size: what is similar to a title kept in earlier parts goes, and the rest of the part is
    settled in rounds over its own links: an item all of whose earlier neighbours are dropped is kept, one with a kept
    earlier neighbour is dropped, until none is open. So the work is that of titles times kept titles.
    """
    i = items.select("batch", "item_id", _plain_title(F.col("title")).alias("t"))
    alone = F.when(F.length("t") >= 200, F.col("item_id")).alias("alone")
    distinct = staged(i.groupBy("batch", "t", alone).agg(F.min("item_id").alias("item_id")).select("batch", "item_id", "t"), "titles")
    total, shares = distinct.count(), []
    while FIRST * PART ** len(shares) < total:
        shares.append(FIRST * PART ** len(shares) / total)
    cuts = distinct.agg(F.percentile_approx("item_id", shares, 10_000).alias("cuts")).first()["cuts"] if shares else []
    kept, low = None, None
    for high in [*cuts, None]:
        part = distinct if low is None else distinct.where(F.col("item_id") > low)
        part = part if high is None else part.where(F.col("item_id") <= high)
        if kept is not None:
            part = staged(part.join(staged(_similar(part, kept, limit, True), "titles"), "item_id", "left_anti"), "titles")
        new = staged(_settled(part, staged(_similar(part, part, limit, False), "titles")), "titles")
        kept, low = new if kept is None else kept.unionByName(new), high
    return kept.select("batch", "item_id")


def _settled(part: DataFrame, links: DataFrame) -> DataFrame:
    """The titles of ``part`` that a greedy pass keeps, given its links to earlier ones."""
    state = staged(part.select("item_id").withColumn("kept", F.lit(None).cast("boolean")), "titles")
    while state.where("kept is null").limit(1).count():
        seen = links.join(state.select(F.col("item_id").alias("other"), F.col("kept").alias("k")), "other").groupBy("item_id").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("hit"), F.bool_or(F.col("k").isNull()).alias("open"))
        decided = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = staged(state.join(seen, "item_id", "left").select("item_id", F.coalesce("kept", decided).alias("kept")), "titles")
    return part.join(state.where("kept"), "item_id", "left_semi")


def near_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items of all sources and days left after those are dropped whose title is near an earlier kept one, or empty."""
    i = table(spark, sf_dir, "tmp_latest_silly").where(_plain_title(F.col("title")) != "")
    return greedy_distinct(i.select(F.lit("").alias("batch"), "item_id", "title"))


def tag_counts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per tag, in all and of the ISO-dated ones of the last 120 days before the newest."""
    i = table(spark, sf_dir, "tmp_latest_silly").select("tag", F.to_date(F.regexp_extract(F.col("date"), r"^(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8]))T", 1).try_cast("date")).alias("day"))
    newest = i.agg(F.max("day").alias("newest")).withColumn("one", F.lit(1))
    w = i.withColumn("one", F.lit(1)).join(newest, "one")
    return w.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("day") > F.date_sub("newest", 120)).alias("recent"))


def analysis_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and confidence out of the model's JSON; text that is none gives nulls."""
    i = table(spark, sf_dir, "tmp_latest_silly").select(F.get_json_object("ai_analysis", "$.tag").alias("tag"), F.get_json_object("ai_analysis", "$.confidence").alias("confidence"))
    return i.groupBy("tag", "confidence").agg(F.count(F.lit(1)).alias("n"))


def html_rows_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings written as nested HTML pages, one per load, and read back from them."""
    s = table(spark, sf_dir, "swehockey_standings")
    cell = lambda c: F.concat(F.lit("<td> "), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    tr = F.concat(F.lit("<tr>"), *[cell(c) for c in ("row_id", "rank", "games_played", "points")], F.lit("</tr>"))
    pages = s.groupBy(F.concat_ws("/", "season_group_id", F.unix_micros(F.col("scraped_at").cast("timestamp"))).alias("page")).agg(F.array_sort(F.collect_list(F.struct("row_id", tr.alias("tr")))).alias("rows"))
    pages = pages.select("page", F.concat(F.lit("<html><table><tr><td><table>"), F.array_join(F.transform("rows", lambda r: r["tr"]), "\n"), F.lit("</table></td></tr></table></html>")).alias("html"))
    return table_rows(pages, "page", "html").select(F.col("page_id").alias("page"), "row_no", F.col("cells")[0].cast("long").alias("row_id"), F.nullif(F.col("cells")[1], F.lit("")).cast("long").alias("rank"), F.col("cells")[2].cast("long").alias("games_played"), F.col("cells")[3].cast("long").alias("points"))


def article_body_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items written as article pages, a paragraph for each line, and their texts read back from them."""
    text = F.replace(F.replace(F.coalesce("body", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><nav>Hem</nav><article><p>"), F.regexp_replace(text, "\n+", "</p>\n<p>"), F.lit("</p></article></html>"))
    return article_texts(table(spark, sf_dir, "tmp_latest_silly").select("item_id", page.alias("html")), "item_id", "html").withColumnRenamed("page_id", "item_id")


def schedule_row_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule rows as a page shows them (the day only where it changes) parsed: day carried on, sides split, result read."""
    key = Window.partitionBy("sg").orderBy("match_date", "row_id")
    s = table(spark, sf_dir, "swehockey_schedule").select(F.col("season_group_id").alias("sg"), "row_id", "match_date", F.concat_ws(" - ", "home_team", "away_team").alias("game"), F.coalesce("result", F.lit("")).alias("result")).where("match_date is not null")
    shown = s.withColumn("day", F.when(F.coalesce(F.lag("match_date").over(key) == F.col("match_date"), F.lit(False)), "").otherwise(F.col("match_date")))
    cells = shown.select("sg", "row_id", F.row_number().over(key).alias("n"), F.array("day", "game", "result").alias("cells"))
    order = Window.partitionBy("sg").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = F.array_position(F.transform("cells", lambda c: c.rlike(r"\p{L}") & c.contains(" - ")), True).cast("int")
    read = cells.select("sg", "row_id", F.last(F.nullif(F.get("cells", F.lit(0)), F.lit("")), True).over(order).alias("match_date"), F.get("cells", at - 1).alias("game"), F.get("cells", at).alias("result")).where("game is not null")
    return read.select("sg", "row_id", "match_date", squashed(F.expr("substring(game, 1, instr(game, ' - ') - 1)")).alias("home"), squashed(F.expr("substring(game, instr(game, ' - ') + 3)")).alias("away"), F.regexp_extract("result", r"^\s*(\d+)", 1).alias("home_goals"))


QUERIES = {f.__name__: f for f in (news_filter_classify, text_sentiment, sentiment_distribution, new_since_previous, feed_merge_dedup, near_duplicate_titles, tag_counts_window, analysis_tags, html_rows_extract, article_body_extract, schedule_row_parser)}


def _sql_any(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


_I = "i as (select *, lower(concat_ws(' ', title, body)) t from tmp_latest_silly)"
_CLASS = "case " + " ".join(f"when {_sql_any(w)}{' and not ' + _sql_any(RULES.not_extension) if n == 'EXTENSION' else ''} then '{n}'" for n, w in RULES.classes) + " end"
_SUM = " + ".join(f"case when contains(t, '{w}') then {n} else 0 end" for w, n in RULES.weights.items())
_D = f"d as (select item_id, cast(s + case when contains(t, '!') and s > 0 then 1 else 0 end as int) d from (select item_id, t, {_SUM} s from i)), l as (select item_id, d, case when d > 0 then 'positive' when d < 0 then 'negative' else 'neutral' end \"label\" from d)"
_SQ = r"lower(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'), ' '))"
_KEYED = f"k as (select item_id, coalesce(url, '') url, {_SQ.format(c='title')} title_key, case when contains(lower(source), 'klubb') then 0 else 1 end priority from tmp_latest_silly)"
SQL = {
    "news_filter_classify": f"with {_I} select item_id, {_CLASS} \"class\", case when coalesce(contains(lower(source), 'klubb'), false) then 'high' else 'low' end confidence from i where {_sql_any(RULES.club)} and not {_sql_any(RULES.excluded)}",
    "text_sentiment": f"with {_I}, {_D} select item_id, d, \"label\", cast(least(95, 56 + 8 * abs(d)) as int) score from l",
    "sentiment_distribution": f"with {_I}, {_D} select \"label\", count(*) n, round(100 * count(*) / sum(count(*)) over (), 4) pct from l group by 1",
    "new_since_previous": f"with k as (select item_id, {_SQ.format(c='source')} || '|' || {_SQ.format(c='title')} \"identity\" from tmp_latest_silly), h as (select max(item_id) / 2 half from k) select item_id, \"identity\" from k, h where item_id > half and \"identity\" not in (select \"identity\" from k, h where item_id <= half)",
    "feed_merge_dedup": f"with {_KEYED}, u as (select * from k where url = '' union all select * from k where url <> '' qualify row_number() over (partition by url order by priority, item_id) = 1) select * from u qualify row_number() over (partition by title_key order by priority, item_id) = 1",
    "tag_counts_window": r"with i as (select tag, try_cast(regexp_extract(date, '^(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8]))T', 1) as date) as day from tmp_latest_silly), z as (select max(day) newest from i) select tag, count(*) n, count(*) filter (where day > newest - 120) recent from i, z group by 1",
    "analysis_tags": "select json_extract_string(ai_analysis, '$.tag') tag, json_extract_string(ai_analysis, '$.confidence') confidence, count(*) n from tmp_latest_silly group by 1, 2",
    "html_rows_extract": "select season_group_id || '/' || epoch_us(scraped_at) page, cast(row_number() over (partition by season_group_id, scraped_at order by row_id) - 1 as int) row_no, row_id, rank, games_played, points from swehockey_standings",
    "article_body_extract": r"select item_id, left(trim(regexp_replace(coalesce(body, ''), '[\s\x{a0}\x{2009}]+', ' ', 'g'), ' '), 1500) body from tmp_latest_silly",
    "schedule_row_parser": r"with g as (select season_group_id sg, row_id, match_date, concat_ws(' - ', home_team, away_team) game, coalesce(result, '') result from swehockey_schedule where match_date is not null) select sg, row_id, match_date, trim(regexp_replace(split_part(game, ' - ', 1), '\s+', ' ', 'g'), ' ') home, trim(regexp_replace(substr(game, instr(game, ' - ') + 3), '\s+', ' ', 'g'), ' ') away, regexp_extract(result, '^\s*(\d+)', 1) home_goals from g where contains(game, ' - ')",
}
