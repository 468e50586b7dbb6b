"""Column profiles per load: nulls, ranges, character-class masks, their drift, and what they show (problem 4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkline.operators.staging_area import staged

LONG_MASK = 24  # a longer mask is generalised once more, to the set of its signs, so that free text has few masks


def value_mask(c: Column) -> Column:
    """A value with each run of one character class put as one sign: A upper, a lower, 9 digit, _ blank, others as they
    are; where that is longer than ``LONG_MASK`` signs, ``~`` and the distinct signs in order. Whole values are read."""
    m = F.regexp_replace(c, r"\p{Lu}+", "A")
    m = F.regexp_replace(m, r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]+", "a")
    m = F.regexp_replace(m, r"\p{N}+", "9")
    m = F.regexp_replace(m, r"[\s\x{a0}]+", "_")
    signs = lambda v: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)))), "")
    # a lambda's argument is read once, so the value goes through the four patterns once
    return F.transform(F.array(m), lambda v: F.when(F.length(v) <= LONG_MASK, v).otherwise(F.concat(F.lit("~"), signs(v))))[0]


def _typed_mask(c: Column, kind: str) -> Column:
    """The mask of a column's text form; where the type leaves few forms they are told without reading the text."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(c < 0, "-9").when(c >= 0, "9")
    if kind == "boolean":
        return c.cast("string")  # two values only: each is its own mask, so that a shift between them shows
    if kind in ("timestamp", "timestamp_ntz"):
        return F.when(F.unix_micros(c.cast("timestamp")) % 1_000_000 == 0, "9-9-9_9:9:9").when(c.isNotNull(), "9-9-9_9:9:9.9")
    return value_mask(c.cast("string"))


def _as_text(c: Column, kind: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind in ("timestamp", "timestamp_ntz") else c.cast("string")


@dataclass(frozen=True)
class Watch:
    """What to hold a column against: the values it may have, and a share of rows to compare between loads.

    ``share_of`` is a condition on values that are their own mask (allowed ones and booleans); ``share_among`` is any
    condition on the row. Two loads' shares differ from ``shift_tenths``/10 on.
    """

    column: str
    allowed: tuple[str, ...] | None = None
    share_of: Callable[[Column], Column] | None = None
    share_among: Callable[[], Column] | None = None
    shift_tenths: int = 3


def mask_counts(df: DataFrame, load: list[str], columns: list[str], watches: Sequence[Watch] = ()) -> DataFrame:
    """``(load, column_name, mask, is_value, n, n_base)``: each load's rows by column and mask.

    The base of all profiles and findings. Null values have null mask. Booleans and the allowed values of a watched
    column are their own mask (``is_value``), so a foreign value of the same shape is told from them; ``n_base`` counts
    the rows of the watched share's base. Counts combine before the shuffle, so a load or value that holds a third of
    all rows costs no more than another; values themselves are never gathered.
    """
    kinds, watched = dict(df.dtypes), {w.column: w for w in watches}

    def cell(name: str) -> Column:
        c, w = F.col(name), watched.get(name, Watch(name))
        mask, own = _typed_mask(c, kinds[name]), F.lit(kinds[name] == "boolean") & c.isNotNull()
        if w.allowed and kinds[name] != "boolean":
            own = F.coalesce(c.cast("string").isin(*w.allowed), F.lit(False))
            mask = F.when(own, c.cast("string")).otherwise(mask)
        base = F.lit(True) if w.share_among is None else F.coalesce(w.share_among(), F.lit(False))
        return F.struct(F.lit(name).alias("column_name"), mask.alias("mask"), own.alias("is_value"), base.alias("is_base"))

    flat = df.select(*load, F.explode(F.array(*map(cell, columns))).alias("cell")).select(*load, "cell.*")
    return flat.groupBy(*load, "column_name", "mask", "is_value").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_base").alias("n_base"))


def column_ranges(df: DataFrame, load: list[str], columns: list[str]) -> DataFrame:
    """``(load, column_name, n_distinct, min_value, max_value)``: smallest and greatest value by the column's own type, as
    text, and distinct values by a mergeable sketch (relative standard error 2.3 %). One aggregate over the rows."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(11))), F.lit(0)).alias("n_distinct"), _as_text(F.min(c), kinds[c]).alias("min_value"), _as_text(F.max(c), kinds[c]).alias("max_value")) for c in columns]
    return df.groupBy(*load).agg(F.array(*cells).alias("cells")).select(*load, F.explode("cells").alias("cell")).select(*load, "cell.*")


def _on(a: str, b: str, keys: list[str]) -> Column:
    """Equality of keys, null being a value."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def column_profile(df: DataFrame, load: list[str], order: str, columns: list[str], rare: float = 0.01, watches: Sequence[Watch] = (), ranges: bool = True) -> DataFrame:
    """One row per load and column: rows, nulls, distinct values, range, rare-mask rows, drift against the load before,
    and the findings.

    Patterns are mined over all loads: a mask under ``rare`` of the column's non-null rows is rare, and ``n_rare`` counts
    the load's rows with such masks. ``drift`` is the total variation distance between the mask distributions (null being
    one mask) of a load and of the one before it by ``order`` among the other load columns; null for the first. Booleans
    and the allowed values of ``watches`` count as masks of their own, so for a watched column the masks also tell the
    rows with foreign values (``n_outside``) and the watched share exactly (``n_hit`` of ``n_base``). ``findings``:
    ``null`` where a watched column has nulls, ``invalid`` where it has foreign values, ``shift`` where its share differs
    from that of the previous load with rows in the share's base (compared in whole numbers, so the border is exact).
    ``ranges=False`` leaves out distinct values and ranges, which are all that is not read from the masks.

    Defined results: null load columns are loads like others; a load without rows has no profile; repeated rows count
    each; an empty table gives no rows; columns not listed are ignored.
    """
    kinds, watched = dict(df.dtypes), {w.column: w for w in watches}
    if any(w.share_of is not None and not w.allowed and kinds[w.column] != "boolean" for w in watches):
        raise ValueError("a share needs allowed values or a boolean column")
    rest = [c for c in load if c != order]
    counts = staged(mask_counts(df, load, columns, watches), "p4-masks")  # read three times below

    over_all = counts.where("mask is not null").groupBy("column_name", "mask").agg(F.sum("n").alias("m"))
    whole = over_all.groupBy("column_name").agg(F.sum("m").alias("all"))
    patterns = over_all.join(whole, "column_name").select("column_name", "mask", (F.col("m") / F.col("all") < rare).alias("is_rare"))

    outside, hit, shift_tenths = F.lit(False), F.lit(False), F.lit(3)
    for w in watches:
        here = F.col("column_name") == w.column
        value = F.when(F.col("is_value"), F.col("mask")).cast(kinds[w.column])
        if w.allowed:
            outside = F.when(here, F.col("mask").isNotNull() & ~F.col("is_value")).otherwise(outside)
        if w.share_of is not None:
            hit = F.when(here, F.coalesce(w.share_of(value), F.lit(False))).otherwise(hit)
        shift_tenths = F.when(here, F.lit(w.shift_tenths)).otherwise(shift_tenths)
    some = lambda flag, n: F.sum(F.when(flag, F.col(n)).otherwise(0))
    per_load = counts.join(patterns, ["column_name", "mask"], "left").groupBy(*load, "column_name").agg(
        F.sum("n").alias("n_rows"), some(F.col("mask").isNull(), "n").alias("n_null"), some(F.col("is_rare"), "n").alias("n_rare"), F.max_by("mask", F.when(F.col("mask").isNotNull(), F.struct("n", "mask"))).alias("top_mask"),
        some(outside, "n").alias("n_outside"), F.sum("n_base").alias("n_base"), some(hit, "n_base").alias("n_hit"),
    )
    in_order = Window.partitionBy(*rest, "column_name").orderBy(order)
    based = F.when(F.col("n_base") > 0, F.struct("n_hit", "n_base"))
    per_load = staged(per_load.select("*", F.row_number().over(in_order).alias("load_no"), F.last(based, True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("was")), "p4-loads")

    a, b = counts.alias("a"), per_load.alias("b")
    share = F.col("a.n") / F.col("b.n_rows")
    parts = F.array(F.struct(F.col("b.load_no").alias("k"), share.alias("d")), F.struct((F.col("b.load_no") + 1).alias("k"), (-share).alias("d")))
    steps = a.join(b, _on("a", "b", [*load, "column_name"])).select(*[F.col(f"a.{c}") for c in rest], "a.column_name", "a.mask", F.explode(parts).alias("s"))
    moved = steps.groupBy(*rest, "column_name", "mask", "s.k").agg(F.sum("s.d").alias("d")).groupBy(*rest, "column_name", F.col("k").alias("load_no")).agg((F.sum(F.abs("d")) / 2).alias("moved"))
    out = per_load.alias("a").join(moved.alias("b"), _on("a", "b", [*rest, "column_name", "load_no"])).select("a.*", F.when(F.col("a.load_no") > 1, F.round("b.moved", 6)).alias("drift"))

    shifted = 10 * F.abs(F.col("n_hit") * F.col("was.n_base") - F.col("was.n_hit") * F.col("n_base")) >= shift_tenths * F.col("n_base") * F.col("was.n_base")
    is_watched = F.col("column_name").isin(*watched) if watched else F.lit(False)
    shared = F.col("column_name").isin(*[w.column for w in watches if w.share_of is not None]) & (F.col("n_base") > 0)
    findings = F.filter(F.array(F.when(is_watched & (F.col("n_null") > 0), F.lit("null")), F.when(F.col("n_outside") > 0, F.lit("invalid")), F.when(shared & shifted, F.lit("shift"))), lambda x: x.isNotNull())
    out = out.withColumn("findings", findings)
    shown = ["n_rows", "n_null", "n_rare", "top_mask", "drift", "n_outside", "n_base", "n_hit", "findings"]
    if not ranges:
        return out.select(*load, "column_name", *shown)
    joined = out.alias("a").join(column_ranges(df, load, columns).alias("b"), _on("a", "b", [*load, "column_name"]))
    return joined.select(*[F.col(f"a.{c}") for c in [*load, "column_name", *shown]], "b.n_distinct", "b.min_value", "b.max_value")
