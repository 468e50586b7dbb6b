"""Duplicates hidden by formatting differences (problem 1).

A record's fingerprint is a sum over its (field name, normalised value) pairs of their hashes: addition commutes, so
neither the order of fields nor, in fields whose parts may be reordered, the order of parts matters, and repeated parts
count as often as they occur (a multiset hash). Records meet by fingerprint; the normalised fields themselves are then
compared, parts as multisets, without sorting, so two records never count as one because of a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.functions.parse import day_text, numbers_text
from rinkline.functions.textkeys import word_parts, writing_key
from rinkline.operators.staging_area import staged


@dataclass(frozen=True)
class Field:
    """How one field is read: ``exact`` value, ``code`` (case, blanks and punctuation ignored), ``parts`` (as code, and
    the parts in any order), ``day`` (a date however written, never month first) or ``numbers`` (its numbers in order)."""

    name: str
    kind: str = "exact"


_MARKS = " \t\n\r\u00a0\u2009.,;:-_/*'\"()"


def _plain(f: Field) -> Column:
    c = F.col(f.name)
    if f.kind == "code":
        return F.lower(F.translate(c.cast("string"), _MARKS, ""))
    if f.kind == "parts":
        return writing_key(c)
    if f.kind == "day":
        return day_text(c)
    if f.kind == "numbers":
        return numbers_text(c)
    return c


_NULL = "\u0000"


def _sum_of_parts(name: str, parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, t: acc + F.shiftright(F.xxhash64(F.lit(name), t), 24))


def fingerprint(fields: list[Field]) -> Column:
    """The commutative multiset hash of a record's normalised fields; null is a value of its own."""
    total = F.lit(0).cast("long")
    for f in fields:
        if f.kind == "parts":
            parts = F.coalesce(word_parts(F.col(f.name)), F.array(F.lit(_NULL)))
            total = total + _sum_of_parts(f.name, parts)
        else:
            total = total + F.shiftright(F.xxhash64(F.lit(f.name), _plain(f)), 6)  # null adds nothing to the name's hash
    return total


def _raw(df: DataFrame, row_id: str, fields: list[Field]) -> DataFrame:
    """Id, block and fields. Only records that agree in their exact fields can be one, so their hashes' sum, which costs
    little, is the block in which the others are looked at; without exact fields it is the whole fingerprint."""
    exact = [f for f in fields if f.kind == "exact"]
    return df.select(fingerprint(exact or fields).alias("_block"), F.col(row_id).cast("long").alias("_id"), *[F.col(f.name).alias(f.name) for f in fields])


def _keyed(rows: DataFrame, fields: list[Field]) -> DataFrame:
    content = F.struct(*[(word_parts(F.col(f.name)) if f.kind == "parts" else _plain(f)).alias(f"v{i}") for i, f in enumerate(fields)])
    return rows.select(fingerprint(fields).alias("fp"), F.col("_id").alias("id"), content.alias("content"))


def _same_parts(a: Column, b: Column) -> Column:
    """Whether two lists hold the same parts, each as often, in any order; null agrees with null only."""
    times = lambda x, t: F.size(F.filter(x, lambda u: u == t))
    equal = (F.size(a) == F.size(b)) & F.forall(a, lambda t: times(a, t) == times(b, t))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)


def _same_content(a: Column, b: Column, fields: list[Field]) -> Column:
    same = F.lit(True)
    for i, f in enumerate(fields):
        x, y = a[f"v{i}"], b[f"v{i}"]
        same = same & (_same_parts(x, y) if f.kind == "parts" else x.eqNullSafe(y))
    return same


FEW_BLOCKS = 2_000_000  # shared blocks (8 bytes each) up to which they are sent to every task


def _meeting(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """The rows that are not alone in their block, with fingerprint and normalised fields, written once."""
    often = staged(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_block"), "p1-blocks")
    shared = F.broadcast(often) if often.count() <= FEW_BLOCKS else often.hint("shuffle_hash")
    return staged(rows.join(shared, "_block", "left_semi"), "p1")


def _copies(met: DataFrame, fields: list[Field]) -> DataFrame:
    """``(first, id)``: each row of ``met`` that is a copy, and the smallest id of its set.

    Rows meet the first row of their fingerprint and are compared with it field by field. Rows that differ from it share
    no more than the hash; they are grouped by their fields in full, which is exact and, as a rule, no row at all.
    """
    keyed = _keyed(met, fields)
    sets = keyed.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", "first")
    held = keyed.join(sets.withColumnRenamed("first", "id").hint("shuffle_hash"), ["fp", "id"]).groupBy("fp", F.col("id").alias("first")).agg(F.any_value("content").alias("held"))
    compared = keyed.join(held.hint("shuffle_hash"), "fp").where("id != first").select("fp", "id", "first", _same_content(F.col("content"), F.col("held"), fields).alias("same"))
    compared = staged(compared, "p1-compared")
    copies = compared.where("same").select("first", "id")
    if not compared.where("not same").limit(1).count():
        return copies
    rest = met.join(compared.where("not same").select(F.col("id").alias("_id")), "_id", "left_semi")
    whole = rest.select("_id", F.struct(*[_plain(f).alias(f"v{i}") for i, f in enumerate(fields)]).alias("content"))
    firsts = whole.groupBy("content").agg(F.min("_id").alias("first"))
    others = whole.alias("a").join(firsts.alias("b"), F.col("a.content").eqNullSafe(F.col("b.content"))).select("b.first", F.col("a._id").alias("id")).where("id != first")
    return copies.unionByName(others)


def format_copies(df: DataFrame, row_id: str, fields: list[Field]) -> DataFrame:
    """``(first_row_id, copy_row_id)``: each further copy of a record and the smallest row id of its set.

    Blocks are counted with map-side combine, so a set of copies that holds a third of all rows shrinks to a row per task
    before it is shuffled; rows alone in their block are dropped before anything of them is shuffled, where the shared
    blocks are few enough to be sent to every task, else in a join whose hot partitions adaptive execution splits. What
    remains meets the first row of its fingerprint, one row on one side of the join, so that a hot fingerprint is split.

    Defined results: null agrees only with null, an empty text only with texts of blanks and punctuation; row ids are
    taken to be unique (a repeated id is listed as a copy only of another id); an empty table gives no rows; columns
    that are not among the fields are ignored, whatever their names.
    """
    return _copies(_meeting(_raw(df, row_id, fields), fields), fields).select(F.col("first").alias("first_row_id"), F.col("id").alias("copy_row_id"))


def collapse_formats(df: DataFrame, row_id: str, fields: list[Field]) -> DataFrame:
    """``(row_id, n_copies)``: one row for each record, however often it is stored, with the number of rows that hold it.

    Same rules as :func:`format_copies`; join the result to the table by ``row_id`` for the records themselves.
    """
    rows = _raw(df, row_id, fields)
    single = rows.groupBy("_block").agg(F.min("_id").alias("row_id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("row_id", F.lit(1).cast("long").alias("n_copies"))
    met = _meeting(rows, fields)
    copies = _copies(met, fields)
    counted = copies.groupBy(F.col("first").alias("row_id")).agg((F.count(F.lit(1)) + 1).alias("n"))
    firsts = met.select(F.col("_id").alias("row_id")).join(copies.select(F.col("id").alias("row_id")), "row_id", "left_anti").join(counted, "row_id", "left")
    return single.unionByName(firsts.select("row_id", F.coalesce("n", F.lit(1).cast("long")).alias("n_copies")))
