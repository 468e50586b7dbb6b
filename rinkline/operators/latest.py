"""The latest row, the latest snapshot, the first row: how append-only tables are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (give a total order). Rank-limited before the shuffle by the optimizer."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_snapshot(df: DataFrame, group: list[str], stamp: str) -> DataFrame:
    """All rows of each group's newest snapshot; a key missing there is gone, unlike with :func:`latest_by_key`.

    The newest stamps come from an aggregate with map-side combine, one row per group, and are joined back.
    """
    newest = df.groupBy(*group).agg(F.max(stamp).alias("_newest"))
    return df.join(newest, group).where(F.col(stamp) == F.col("_newest")).drop("_newest")


def rows_of_successful_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows without a run id, or of a run whose latest event is SUCCESS."""
    last = latest_by_key(runs, ["run_id"], [F.col("finished_at").isNull(), F.col("finished_at").desc(), F.col("started_at").desc(), F.col("event_id").desc()])
    good = last.where("status = 'SUCCESS'").select(F.col("run_id").alias("_run"))
    return rows.join(good, F.col("run_id") == F.col("_run"), "left").where("run_id is null or _run is not null").drop("_run")
