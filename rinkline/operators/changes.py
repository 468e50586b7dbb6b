"""What changed between consecutive full snapshots of a table (problem 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkline.functions.textkeys import exact_state
from rinkline.operators.staging_area import staged


SMALL_LOADS = 1_000_000  # loads up to which their table is sent to every task
RANGE_ROWS = 20_000  # rows in a range, about; adaptive execution joins small ranges into one task


def numbered_loads(df: DataFrame, group: str, load: str) -> tuple[DataFrame, int]:
    """``(g, t, k, last)``: the loads of each group in order, written once, sent to every task if they are few enough; and
    the number of rows."""
    seen = df.where(F.col(load).isNotNull()).groupBy(F.col(group).alias("g"), F.col(load).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    by_group = Window.partitionBy("g").orderBy("t")
    loads = staged(seen.select("g", "t", "n", F.row_number().over(by_group).alias("k"), F.lead("t").over(by_group).isNull().alias("last")), "p2-loads")
    size = loads.agg(F.count(F.lit(1)).alias("loads"), F.sum("n").alias("rows")).first()
    return (F.broadcast(loads.drop("n")) if size["loads"] <= SMALL_LOADS else loads.drop("n")), size["rows"] or 0


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch with equal keys (two hashes of group, entity, spelling and load) the one with the smallest id."""
    for b in batches:
        if not b.num_rows:
            continue
        known = b.column("id").is_valid().to_numpy(zero_copy_only=False)
        number = b.column("id").fill_null(0).to_numpy()
        key, key2 = b.column("key").to_numpy(), b.column("key2").to_numpy()
        order = np.lexsort((number, known, key2, key))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (key[order][1:] != key[order][:-1]) | (key2[order][1:] != key2[order][:-1])
        yield b.take(pa.array(order[first])).drop_columns(["key", "key2"])


def told_apart(spelled: Column, *scope: str) -> Column:
    """What tells apart the entities of one scope that share their ASCII letters: '' where all typed spellings agree; else
    the spelling, or, where it cannot be told, null."""
    of = Window.partitionBy(*scope)
    one = F.coalesce(F.min(spelled).over(of) == F.max(spelled).over(of), F.lit(True))
    return F.when(one, F.lit("")).otherwise(spelled)


def snapshot_changes(df: DataFrame, group: str, load: str, row_id: str, entity: list[Column], compare: list[str], spelled: Column | None = None) -> DataFrame:
    """Typed changes between each snapshot and the next: ``(group, load, change, old_row_id, new_row_id, old_state, new_state)``.

    A snapshot is all rows of one ``group`` with one value of ``load``. Rows are keyed by a 64-bit hash of ``entity``; their
    ``spelled`` goes along, so entities are never taken for one because of a hash. Copies of a record are combined before
    anything is shuffled, batch by batch, so one that holds a third of all rows shrinks to a row per batch. Rows are then
    partitioned by range of the key (equal widths, as hashes are spread evenly; their number follows the rows', and a
    group that holds a third of all rows is spread over all ranges) in one shuffle, and sorted by key and load.
    Snapshots of one range then lie interleaved in key order, and one pass that looks at neighbours merges each with the
    next, as two pointers would: a key that the next snapshot lacks is ``removed``, one that the former lacks ``added``,
    one in both whose compared columns differ ``changed``.

    ``entity`` are columns that are equal for all stored forms of an entity's name (and perhaps for other entities');
    ``spelled`` is the name as typed where that can be told, else null: entities of one group with equal ``entity`` but
    different spellings are different, and a form that cannot be told is then an entity of its own.

    Defined results: a record stored more than once in a snapshot counts once, under its smallest ``row_id`` (null ones
    first); null is a value like any other in ``group``, ``entity`` and ``compare``; rows with null ``load`` are in no
    snapshot and are left out; nothing is listed for the first snapshot of a group; an empty table gives no rows. Extra
    columns are ignored, whatever their names.
    """
    loads, n_rows = numbered_loads(df, group, load)
    bits = min(30, max(4, math.ceil(math.log2(1 + n_rows / RANGE_ROWS))))
    rows = df.where(F.col(load).isNotNull()).select(F.col(group).alias("rg"), F.col(load).alias("rt"), F.xxhash64(*entity).alias("h"), (F.concat_ws("|", *entity) if spelled is None else spelled).alias("s"), F.col(row_id).cast("long").alias("id"), exact_state(*compare).alias("state"))
    placed = rows.join(loads, F.col("rg").eqNullSafe(F.col("g")) & (F.col("rt") == F.col("t"))).select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("r"), "g", "h", "s", "k", "last", "id", "state")
    keyed = placed.select("*", F.xxhash64("g", "h", "s", "k").alias("key"), F.hash("k", "s", "h", "g").alias("key2"))
    ranged = keyed.mapInArrow(_without_copies, placed.schema).repartition(F.col("r"))
    ranged = ranged.withColumn("s", told_apart(F.col("s"), "r", "g", "h"))

    in_order = Window.partitionBy("r", "g", "h", "s").orderBy("k", "id")
    once = ranged.withColumn("copy", F.coalesce(F.lag("k").over(in_order) == F.col("k"), F.lit(False))).where("not copy")
    near = once.select("*", *[F.lag(c).over(in_order).alias(f"p_{c}") for c in ("k", "id", "state")], F.lead("k").over(in_order).alias("n_k"))
    none = F.lit(0).cast("long")

    def change(kind: str, when: Column, old: Column, new: Column, at: Column, old_state: Column, new_state: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("change"), old.alias("old_row_id"), new.alias("new_row_id"), at.alias("load_no"), old_state.alias("old_state"), new_state.alias("new_state")))

    k, pk, nk, null = F.col("k"), F.coalesce("p_k", F.lit(-1)), F.coalesce("n_k", F.lit(-1)), F.lit(None).cast("string")
    found = F.array(
        change("added", (k > 1) & (pk != k - 1), none, F.col("id"), k, null, F.col("state")),
        change("changed", (pk == k - 1) & (F.col("state") != F.col("p_state")), F.col("p_id"), F.col("id"), k, F.col("p_state"), F.col("state")),
        change("removed", ~F.col("last") & (nk != k + 1), F.col("id"), none, k + 1, F.col("state"), null),
    )
    return near.select(F.col("g").alias("group_key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("group_key", "x.*")


def changed_columns(changes: DataFrame, compare: list[str]) -> DataFrame:
    """Adds ``columns``: which of the compared columns differ (empty for added and removed)."""
    old, new = F.split("old_state", "\u0001"), F.split("new_state", "\u0001")
    names = F.array(*[F.lit(c) for c in compare])
    differ = F.filter(F.transform(names, lambda n, i: F.when(F.get(old, i) != F.get(new, i), n)), lambda n: n.isNotNull())
    return changes.withColumn("columns", F.when(F.col("change") == "changed", differ).otherwise(F.array().cast("array<string>")))
