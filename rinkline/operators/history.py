"""Histories of changing attributes, kept as checkpoints and patches (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkline.operators.changes import told_apart
from rinkline.operators.staging_area import staged


def holding_rows(df: DataFrame, entity: list[Column], at: Column, row_id: Column, attributes: dict[str, Column], latest: Column | None = None, spelled: Column | None = None) -> DataFrame:
    """The row that holds for each entity and time: ``(entity, at, id, attributes)``.

    ``latest`` ranks rows of one time, the greatest holding; ties, and rows where it is null, fall to the smallest id.
    Entities are a struct. An aggregate with map-side combine, so repeated notices of one hot entity and time meet
    before the shuffle; what is left of an entity is one row per time. ``spelled`` as in ``snapshot_changes``.
    """
    rank = F.lit(0).cast("long") if latest is None else -F.coalesce(F.unix_micros(latest.cast("timestamp")), F.lit(-(2**62)))
    cells = F.struct(rank.alias("_order"), row_id.alias("id"), *[c.alias(n) for n, c in attributes.items()])
    picked = df.select(F.struct(*[c.alias(f"e{i}") for i, c in enumerate(entity)]).alias("entity"), (F.lit("") if spelled is None else spelled).alias("s"), at.alias("at"), cells.alias("cell")).where("at is not null")
    held = picked.groupBy("entity", "s", "at").agg(F.min("cell").alias("cell"))
    if spelled is not None:
        apart = held.withColumn("s", told_apart(F.col("s"), "entity")).select(F.struct("entity.*", "s").alias("entity"), "at", "cell")
        held = apart.groupBy("entity", "at").agg(F.min("cell").alias("cell"))
    return held.select("entity", "at", "cell.id", *[f"cell.{n}" for n in attributes])


def store_deltas(held: DataFrame, attributes: list[str], every: int = 8) -> DataFrame:
    """The stored form: ``(entity, version, at, id, checkpoint, full, patch)``, one row per version.

    A version starts where any attribute differs from the time before (null is a value). Every ``every``-th version is
    a checkpoint with all attributes in ``full``; the others have in ``patch`` only the attributes that changed.
    """
    w = Window.partitionBy("entity").orderBy("at")
    rows = held.select("entity", "at", "id", *attributes, F.row_number().over(w).alias("n"), *[F.lag(a).over(w).alias(f"was_{a}") for a in attributes])
    differs = [~F.col(a).eqNullSafe(F.col(f"was_{a}")) for a in attributes]
    any_differs = F.col("n") == 1
    for d in differs:
        any_differs = any_differs | d
    opened = rows.where(any_differs).withColumn("version", F.row_number().over(w) - 1)
    checkpoint = F.col("version") % every == 0
    changed = F.map_from_entries(F.filter(F.array(*[F.when(d, F.struct(F.lit(a).alias("k"), F.col(a).cast("string").alias("v"))) for a, d in zip(attributes, differs, strict=True)]), lambda x: x.isNotNull()))
    full = F.create_map(*[x for a in attributes for x in (F.lit(a), F.col(a).cast("string"))])
    return opened.select("entity", "version", "at", "id", checkpoint.alias("checkpoint"), F.when(checkpoint, full).alias("full"), F.when(~checkpoint, changed).alias("patch"))


def fold_versions(stored: DataFrame, attributes: list[str]) -> DataFrame:
    """Validity rows from the stored form: ``(entity, version, id, valid_from, valid_to, closed_by, attributes)``.

    Patches are folded forward from the nearest checkpoint: an attribute has the value of the last row at or after that
    checkpoint that states it. The last version has null ``valid_to`` and ``closed_by``.
    """
    w = Window.partitionBy("entity").orderBy("version")
    base = stored.withColumn("from", F.last(F.when(F.col("checkpoint"), F.col("version")), True).over(w))
    fold = Window.partitionBy("entity", "from").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    stated = lambda a: F.when(F.col("checkpoint"), F.struct(F.element_at("full", F.lit(a)).alias("v"))).when(F.map_contains_key("patch", F.lit(a)), F.struct(F.try_element_at("patch", F.lit(a)).alias("v")))
    values = base.select("entity", "version", "at", "id", *[F.last(stated(a), True).over(fold)["v"].alias(a) for a in attributes])
    return values.select("entity", "version", "id", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"), F.lead("id").over(w).alias("closed_by"), *attributes)


def attribute_history(df: DataFrame, entity: list[Column], at: Column, row_id: Column, attributes: dict[str, Column], latest: Column | None = None, every: int = 8, spelled: Column | None = None) -> DataFrame:
    """Every version of every entity with the period in which it was valid. The stored form is written first, under the
    staging folder, and the validity rows are folded from what is read back.

    Defined results: rows with null time are left out; null attributes are values (filter them first if they are to be
    ignored); equal values at consecutive times are one version; ids and values come out as strings; an empty table
    gives no rows; other columns are ignored.
    """
    names = list(attributes)
    held = holding_rows(df, entity, at, row_id.cast("string") if latest is not None else row_id, attributes, latest, spelled)
    return fold_versions(staged(store_deltas(held, names, every), "p6-deltas"), names)


def versions_of(history: DataFrame, attribute: str) -> DataFrame:
    """The versions of one attribute out of a history of several: ``(entity, id, valid_from, valid_to, closed_by, attribute)``."""
    w = Window.partitionBy("entity").orderBy("version")
    opened = history.withColumns({"was": F.lag(attribute).over(w), "n": F.row_number().over(w)}).where((F.col("n") == 1) | ~F.col("was").eqNullSafe(F.col(attribute)))
    return opened.select("entity", "id", "valid_from", F.lead("valid_from").over(w).alias("valid_to"), F.lead("id").over(w).alias("closed_by"), attribute)
