"""Structured Streaming twins of the batch loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.operators.staging_area import shared_folder
from rinkline.operators.upsert import upsert
from rinkline.sources.tables import table


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``(day, event_type, n, total)`` of an event stream; rows later than the watermark are dropped, repeated ids once seen too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


class UpsertSink:
    """A ``foreachBatch`` sink into a keyed table: each batch's rows take the place of those with the same key.

    The table is a folder of versions, one per batch number, of which the newest complete one counts; the two newest stay.
    It outlives the query: after a restart batches go on from it, and a batch that comes again starts from the version
    before its own, so it gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def _files(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        marked = lambda n: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and marked(n))

    def table(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest older than a batch."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{known[-1]}") if known else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        old = self.table(before=number)
        (batch if old is None else upsert(old, batch, self.key)).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        _, fs = self._files()
        for v in self.versions()[:-2]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts of the events table, read as a stream to its end."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = UpsertSink(spark, f"{at}/table", ["day", "event_type"])
    query = daily_counts(source).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.table().select("day", "event_type", "n", F.round("total", 2).alias("total"))
