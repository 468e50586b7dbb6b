"""Writing without MERGE: upsert, insert-only, delete, and loads above a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """``target`` with ``source``'s rows in place of those with the same key, and the new ones added; one shuffle by key.

    Of rows of the source that repeat a key the first by ``order`` counts (all of its columns in turn, if none is given),
    as a merge must not depend on chance; rows of the target whose key the source lacks stay, repeated ones too.
    """
    ranked = source.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or [F.col(c).asc_nulls_first() for c in source.columns])))).where("_n = 1").drop("_n")
    both = target.withColumn("_p", F.lit(1)).unionByName(ranked.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("_m", F.min("_p").over(Window.partitionBy(*key))).where("_p = _m").drop("_m", "_p")


def insert_only(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """``target`` and those rows of ``source`` whose key it lacks."""
    return target.unionByName(source.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; null keeps a row."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def above_watermark(source: DataFrame, stamp: str, watermark: Column) -> DataFrame:
    """Rows newer than the target's newest; late rows are dropped, as a load by watermark does."""
    return source.where(F.col(stamp) > F.coalesce(watermark, F.lit("1970-01-01").cast("timestamp")))
