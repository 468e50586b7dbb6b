"""Writing: appends with lineage, reloads of partitions, raw JSON, tables laid out for reading, and capped caches.

Tables are folders of parquet files. A table is never overwritten while it is read: reloads replace whole partitions,
and an upsert goes to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAGE = ("scraped_at", "source", "run_id", "source_url")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_if_missing(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """An empty table of the schema, unless there is a table already; whether it was made."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def with_lineage(rows: DataFrame, scraped_at: Column, source: str, run_id: Column, source_url: Column) -> DataFrame:
    """Rows with the columns that say where they come from; columns of these names are replaced."""
    return rows.drop(*LINEAGE).select("*", scraped_at.alias("scraped_at"), F.lit(source).alias("source"), run_id.alias("run_id"), source_url.alias("source_url"))


def append(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Rows added to a table; columns the table lacks are added to it (older rows have null there)."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files differ in columns, with all of them."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Delete-then-insert: the partitions that ``rows`` has are replaced by them, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_clustered(rows: DataFrame, path: str, partition_by: str, cluster_by: tuple[str, ...]) -> None:
    """A table partitioned by one column and sorted inside each file, so that readers skip partitions and row groups.
    A partition that holds a third of all rows is spread over several tasks by range."""
    rows.repartitionByRange(partition_by, *cluster_by).sortWithinPartitions(partition_by, *cluster_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)


def write_raw_json(rows: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Raw rows as JSON lines in immutable folders per partition."""
    rows.write.partitionBy(*partition_by).option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def updated_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE: columns set where the condition is true; null leaves a row as it is."""
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def inserted(target: DataFrame, rows: list[tuple]) -> DataFrame:
    """INSERT VALUES: literal rows added."""
    return target.unionByName(target.sparkSession.createDataFrame(rows, target.schema))


def newest(cache: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """A cache cut to its newest entries: the cut is the feature."""
    return cache.orderBy(*order).limit(limit)
