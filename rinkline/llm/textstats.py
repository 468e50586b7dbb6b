"""Per-document statistics of text quality, set against sketches per language (problem 10).

Each statistic of each language has a mergeable quantile sketch, built map-side. A document's values are turned into
robust scores by the sketch's quartiles, and the tails of the distributions are flagged: the outer percentiles, and, for
the share of running sentences, the lower of its two humps, parted where the sketch says that they part best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkline.operators.staging_area import staged

# Common words of Swedish, English, Finnish and German.
_COMMON_SV = "och att det i en på är som för med av till den inte har de om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara in blir upp även vad få två vill ha många hur mer går sade säger inför enligt trots samt utan mellan hos något blev"
_COMMON_EN = "the of and to a in is was he for it with as his on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little very make still own see men work long get here between both life being"
_COMMON_FI = "ja on ei että se oli mutta kun niin myös joka ovat hän sen kuin jo vain nyt sitten tai ole olla ennen jälkeen kanssa joukkue vielä hyvin minä me he ne mitä miten koska jos kaikki siitä sitä siinä ollut tämä tämän vaan eikä yli ali taas"
_COMMON_DE = "der die und das den von zu mit des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen zum war haben nur oder aber vor zur bis mehr durch sein wurde ihre seine wenn sagte hatte kann gegen vom"
LISTED = ("sv", "en", "fi", "de")
COMMON = frozenset(f"{_COMMON_SV} {_COMMON_EN} {_COMMON_FI} {_COMMON_DE}".split())

LEARNED = 30  # words learned for a language that has no list: those in the most of its documents
STATISTICS = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share", "running_share"]
_LINES = re.compile("[\r\n  \x0b\x0c\x85]+")
_WORDS = re.compile(r"[^\W\d_]+")
_OTHER = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_ENDS = ".!?…:;\"”’')"

MIN_WORDS, MIN_COMMON, MIN_COMMON_SHARE, MIN_LETTERS = 4, 2, 0.14, 0.6  # what makes a line running sentences


def describe(text: str, usual: frozenset[str] = COMMON) -> tuple:
    """The statistics of one text. A line counts as running sentences if it is mostly letters and has the common words
    that sentences of any of the languages are held together by, whatever its case and punctuation."""
    words = letters = common = symbols = digits = ends = lines = running = total = 0
    for line in _LINES.split(text):
        line = line.strip()
        n = len(line)
        if not n:
            continue
        w = _WORDS.findall(line.lower())
        k = sum(x in usual for x in w)
        size = sum(map(len, w))
        words, letters, common, lines, total = words + len(w), letters + size, common + k, lines + 1, total + n
        symbols += len(_OTHER.findall(line))
        digits += len(_DIGIT.findall(line))
        ends += line[-1] in _ENDS
        if len(w) >= MIN_WORDS and k >= MIN_COMMON and k >= MIN_COMMON_SHARE * len(w) and size > MIN_LETTERS * n:
            running += n
    return words, letters / words if words else 0.0, symbols / total if total else 0.0, digits / total if total else 0.0, ends / lines if lines else 0.0, common / words if words else 0.0, running / total if total else 0.0


def language(c: Column) -> Column:
    """Two-letter language of a tag however written; ``und`` where there is none."""
    code = F.regexp_extract(F.lower(c), r"^\W*([a-z]{2,3})(?:[-_].*)?\W*$", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("und"))


def learned_words(df: DataFrame, text: Column, lang: Column) -> frozenset[str]:
    """The common words of languages without a list: per language the ``LEARNED`` words of up to six letters that stand in
    the most documents. Counted over all documents with map-side combine; refused beyond 2,000 languages."""
    foreign = df.select(lang.alias("lang"), text.alias("text")).where(~F.col("lang").isin(*LISTED, "und") & F.col("text").isNotNull())
    words = foreign.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).where(F.length("w") <= 6)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    ranked = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEARNED)  # limited before the shuffle
    rows = ranked.groupBy("lang").agg(F.collect_list("w").alias("w")).limit(2_001).collect()
    if len(rows) > 2_000:
        raise ValueError("more than 2,000 languages without a list of common words")
    return frozenset(w for r in rows for w in r["w"])


def text_statistics(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``(doc_id, lang, *STATISTICS)`` of every document, whole texts, written once; null and empty texts have zeros."""
    common = COMMON | learned_words(df, F.col(text), language(F.col(lang)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [describe(t or "", common) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=STATISTICS).astype(float)
            out.insert(0, "lang", pdf["lang"].to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), language(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    return staged(rows.mapInPandas(count, "doc_id long, lang string, " + ", ".join(f"{s} double" for s in STATISTICS)), "p10-statistics")


_OUTER = [0.01, 0.25, 0.5, 0.75, 0.99]
_STEPS = [(k + 0.5) / 200 for k in range(200)]
MIN_DOCUMENTS = 200  # a language with fewer, or with one hump only, is parted where all languages together are
TWO_HUMPS = 0.8  # share of the variance that lies between the humps; one hump, or a flat distribution, stays below


def parting(quantiles: np.ndarray) -> float | None:
    """Where a distribution, given by evenly spaced quantiles, parts into two humps: half way between the means of the two
    classes with the greatest variance between them; None if they hold too little of it to be two humps."""
    q = np.asarray(quantiles, dtype=float)
    if len(q) < 2 or not np.var(q) > 0:
        return None
    n = np.arange(1, len(q))
    sums = np.cumsum(q)
    low, high = sums[:-1] / n, (sums[-1] - sums[:-1]) / (len(q) - n)
    between = n * (len(q) - n) / len(q) ** 2 * (high - low) ** 2
    k = int(np.argmax(between))
    return float((low[k] + high[k]) / 2) if between[k] >= TWO_HUMPS * np.var(q) else None


def sketch_cuts(stats: DataFrame) -> DataFrame:
    """``(lang, q_<statistic>, hump)``: the outer percentiles and quartiles of each statistic, and where the share of
    running sentences parts, all read from the sketches; one row per language."""
    per_lang = stats.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS])
    per_lang = staged(per_lang, "p10-sketches")
    read = lambda s, at: F.array(*[F.kll_sketch_get_quantile_double(s, F.lit(q)) for q in at])
    together = per_lang.groupBy(F.lit(1)).agg(F.kll_merge_agg_double("running_share").alias("running_share")).select(read("running_share", _STEPS).alias("q")).first()
    pooled = parting(together["q"]) if together else None

    @F.pandas_udf("double")
    def hump(n: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([p if k >= MIN_DOCUMENTS and (p := parting(q)) is not None else pooled for k, q in zip(n, steps, strict=True)], dtype="float64")

    return per_lang.select("lang", *[read(s, _OUTER).alias(f"q_{s}") for s in STATISTICS], hump("n", read("running_share", _STEPS)).alias("hump"))


def scored(stats: DataFrame) -> DataFrame:
    """Statistics with ``z_`` robust scores (distance from the language's median in normal quartile widths) and ``tails``:
    the statistics that lie beyond the language's 1st or 99th percentile; ``running_share`` where it lies in the lower of
    its two humps (beyond the 1st percentile if there is but one).

    Languages join by an ordinary join on a table of one row each; the sketches leave the executors only as cut points.
    """
    rows = stats.join(sketch_cuts(stats), "lang")
    z = lambda s: F.round((F.col(s) - F.get(f"q_{s}", F.lit(2))) / F.greatest((F.get(f"q_{s}", F.lit(3)) - F.get(f"q_{s}", F.lit(1))) / 1.349, F.lit(1e-6)), 4)

    def tail(s: str) -> Column:
        outer = (F.col(s) < F.get(f"q_{s}", F.lit(0))) | (F.col(s) > F.get(f"q_{s}", F.lit(4)))
        if s == "running_share":
            outer = F.when(F.col("hump").isNotNull(), F.col(s) < F.col("hump")).otherwise(outer)
        return F.when(outer, F.lit(s))

    tails = F.filter(F.array(*map(tail, STATISTICS)), lambda x: x.isNotNull())
    return rows.select("doc_id", "lang", *STATISTICS, *[z(s).alias(f"z_{s}") for s in STATISTICS], tails.alias("tails"))


def text_quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: statistics, robust scores within its language, and the statistics in whose tails it lies.

    Defined results: null and empty texts have zeros; unknown languages are one language; repeated rows come out each; an
    empty table gives no rows; other columns are ignored.
    """
    return scored(text_statistics(df, doc_id, text, lang))
