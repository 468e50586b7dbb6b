"""Reading numbers, scores, days and clocks out of text, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinkline.functions.textkeys import writing_key


def day_text(c: Column) -> Column:
    """A day written year first or day first, never month first, as ``yyyy-MM-dd``; other texts as their writing key."""
    ymd, dmy = r"^\D*((?:19|20)\d{2})\D*?(\d{1,2})\D*?(\d{1,2})\D*$", r"^\D*?(\d{1,2})\D*?(\d{1,2})\D*?((?:19|20)\d{2})\D*$"

    def date(rx: str, y: int, d: int) -> Column:
        part = lambda i: F.lpad(F.regexp_extract(c, rx, i), 4 if i == y else 2, "0")
        return F.try_to_timestamp(F.concat(part(y), F.lit("-"), part(2), F.lit("-"), part(d)), F.lit("yyyy-MM-dd")).cast("date").cast("string")

    plain = c.rlike(r"^(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])$")
    return F.when(plain, c).otherwise(F.coalesce(date(ymd, 1, 3), date(dmy, 3, 1), writing_key(c)))


def numbers_text(c: Column) -> Column:
    """The numbers of a text in order, joined by '-'; a text without any as its writing key."""
    return F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), "-"), F.lit("")), writing_key(c))


def score(c: Column, side: int) -> Column:
    """Goals of the home (1) or away (2) side of a score written with any separator; null if it is none."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+)\D+(\d+)", side), F.lit("")).cast("int")


def period_scores(c: Column) -> Column:
    """``array<struct<period, h, a>>``: scores per period; parts that are none keep their number but are left out."""
    parts = F.split(F.regexp_replace(c, r"[()\s]", ""), ",")
    read = F.transform(parts, lambda p, i: F.struct((i + 1).alias("period"), F.regexp_extract(p, r"^(\d+)-(\d+)$", 1).alias("h"), F.regexp_extract(p, r"^(\d+)-(\d+)$", 2).alias("a")))
    kept = F.filter(read, lambda p: p["h"] != "")
    return F.transform(kept, lambda p: F.struct(p["period"].alias("period"), p["h"].cast("int").alias("h"), p["a"].cast("int").alias("a")))


def safe_number(c: Column) -> Column:
    """A locale-tolerant number: blanks dropped, decimal comma read, '-' and '' and anything else 0."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(c, r"[\s\x{a0}]", ""), ",", ".").try_cast("double"), F.lit(0.0))


def clock_seconds(c: Column) -> Column:
    """Seconds of a ``mm:ss`` clock; null if it is none."""
    m = lambda i: F.nullif(F.regexp_extract(c, r"^(\d+):(\d{1,2})$", i), F.lit("")).cast("int")
    return m(1) * 60 + m(2)


def falsy(c: Column, default: Column) -> Column:
    """``c`` unless it is null, zero or empty."""
    return F.when(c.isNull() | (c.cast("string").isin("", "0", "0.0")), default).otherwise(c)


def squashed(c: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))
