"""The queries of problems 1, 3, 5, 7, 8, 9 and 10, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.llm.encoding import damaged_rows
from rinkline.llm.formatdup import Field, collapse_formats, format_copies
from rinkline.llm.namelinks import link_variants, linked_pairs, short_given_names, typed_names
from rinkline.llm.nearsets import near_classes, near_pairs
from rinkline.llm.mixing import draws, fit_classifier, reached_shares, sized_members
from rinkline.llm.packing import fill_report, pack
from rinkline.llm.textstats import text_quality, text_statistics
from rinkline.llm.tokens import sized
from rinkline.sources.tables import table

PLAYER_FIELDS = [Field(c) for c in ("season_group_id", "scraped_at", "jersey_number", "games_played", "goals", "assists", "points", "plus_minus", "pim")] + [Field(c, "code") for c in ("team_id", "team_code", "position")] + [Field("player_name", "parts")]
GAME_FIELDS = [Field("season_group_id"), Field("spectators"), Field("team_id", "code"), Field("match_date", "day"), Field("home_team", "parts"), Field("away_team", "parts"), Field("result", "numbers"), Field("status", "numbers"), Field("period_results", "numbers")]
RECORDS = {"swehockey_player_stats": PLAYER_FIELDS, "swehockey_schedule": GAME_FIELDS}


def _both(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    a, b = (f(table(spark, sf_dir, n), "row_id", fields).select(F.lit(n).alias("table_name"), "*") for n, fields in RECORDS.items())
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every further copy of a player or schedule record, with the first."""
    return _both(spark, sf_dir, format_copies)


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player or schedule record with its number of copies."""
    return _both(spark, sf_dir, collapse_formats)


def _damaged(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    sources = [("swehockey_player_stats", "row_id", "player_name", False), ("swehockey_standings", "row_id", "team_name", False), ("tmp_latest_silly", "item_id", "title", True)]
    return [damaged_rows(table(spark, sf_dir, n), k, c, q).select(F.lit(n).alias("table_name"), "*") for n, k, c, q in sources]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record whose player name, team name or title was changed by wrong decoding."""
    a, b, c = (x.select("table_name", "row_key") for x in _damaged(spark, sf_dir))
    return a.unionByName(b).unionByName(c)


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with the original text, and whether some of it is lost for good."""
    a, b, c = _damaged(spark, sf_dir)
    return a.unionByName(b).unionByName(c)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    names = typed_names(t("swehockey_player_stats"), t("swehockey_goalie_stats"), t("swehockey_standings"), t("league_groups"))
    return link_variants(names, short_given_names(t("nickname_forms")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different stored strings that mean the same person of a club or club of a league."""
    return linked_pairs(_linked(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored string with the number of its group, its size and the group's smallest string."""
    from pyspark.sql import Window

    g = Window.partitionBy("kind", "league", "team_id", "label")
    return _linked(spark, sf_dir).select("kind", "league", "team_id", "name", F.min("name").over(g).alias("group_name"), F.count(F.lit(1)).over(g).alias("n_links"))


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tmp_latest_silly").where("body is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of news items whose title and body share at least 0.6 of their distinct words."""
    return near_pairs(_stories(spark, sf_dir), "item_id", F.concat_ws(" ", "title", "body"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every news item with the class of items that are versions of one text."""
    return near_classes(_stories(spark, sf_dir), "item_id", F.concat_ws(" ", "title", "body"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    kinds = table(spark, sf_dir, "container_specs").collect()  # a fixed table of three rows
    out = [pack(sizes, r["container_kind"], r["capacity_tokens"]) for r in kinds]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed in containers of each kind."""
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens placed and the share of space left unused, per kind."""
    return fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    model = fit_classifier(docs)
    return sized_members(docs, model), model.names


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is repeated."""
    docs, names = _members(spark, sf_dir)
    return draws(docs, table(spark, sf_dir, "mix_targets"), names)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens each source reaches in each mix, by written source and by membership."""
    (docs, names), targets = _members(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return reached_shares(draws(docs, targets, names), docs, targets, names)


def p9_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean predicted membership of the documents of each source, as the classifier sees it."""
    docs, names = _members(spark, sf_dir)
    pairs = docs.select("source", F.posexplode("member").alias("k", "p"))
    return pairs.groupBy("source", F.get(F.array(*map(F.lit, names)), F.col("k")).alias("predicted")).agg(F.round(F.avg("p"), 4).alias("mean_membership"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than half the characters belong to running sentences: those in the lower hump of the share's
    distribution in their language, as its sketch parts it."""
    return text_quality(table(spark, sf_dir, "documents")).where(F.array_contains("tails", "running_share")).select("doc_id")


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, robust scores and tails of every document."""
    return text_quality(table(spark, sf_dir, "documents"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain statistics of every document."""
    stats = text_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return stats.select("doc_id", "lang", F.col("n_words").cast("long").alias("n_words"), *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share")])


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p5_classes": p5_classes, "p7_found": p7_found, "p7_restored": p7_restored, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_draws": p9_draws, "p9_shares": p9_shares, "p9_memberships": p9_memberships, "p10_found": p10_found, "p10_quality": p10_quality, "p10_statistics": p10_statistics}
