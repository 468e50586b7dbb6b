"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
