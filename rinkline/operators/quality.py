"""Checks on batches: rows, required parts, keys, allowed values, freshness, and the gate."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_checks(df: DataFrame, batch: list[str], key: list[str], expected: DataFrame | None = None, empty_severity: Column | None = None, required: list[str] | None = None) -> DataFrame:
    """``(batch, check_name, severity, observed, passed)``: rows present, rows with a missing required value, rows that
    repeat a key (blanks and letter case aside).

    ``expected`` has the batches that should be there (columns of ``batch``, and what ``empty_severity`` reads): those
    without rows fail ``rows_present``. All checks are errors, but that one may be a warning.
    """
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    missing = F.lit(False)
    for c in required or key:
        missing = missing | (part(c) == "")
    keys = df.groupBy(*batch, *[part(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("m"))
    one = keys.groupBy(*batch).agg(F.sum("n").alias("rows"), F.sum("m").alias("missing"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))
    if expected is not None:
        one = expected.join(one, batch, "left").fillna(0, ["rows", "missing", "repeated"])
    check = lambda name, severity, c, ok: F.struct(F.lit(name).alias("check_name"), severity.alias("severity"), c.cast("long").alias("observed"), ok.alias("passed"))
    error = F.lit("ERROR")
    checks = F.array(check("rows_present", error if empty_severity is None else empty_severity, F.col("rows"), F.col("rows") > 0), check("missing_required", error, F.col("missing"), F.col("missing") == 0), check("duplicate_keys", error, F.col("repeated"), F.col("repeated") == 0))
    return one.select(*batch, F.explode(checks).alias("x")).select(*batch, "x.*")


def preseason_severity(has_games: Column, may_be_empty: Column) -> Column:
    """An empty batch of a kind that may be empty is a warning as long as no team has played."""
    return F.when(may_be_empty & ~F.coalesce(has_games, F.lit(False)), "WARNING").otherwise("ERROR")


def gate_passes(checks: DataFrame) -> bool:
    """Whether no error failed; one failure blocks every batch, warnings block none."""
    return not checks.where("not passed and severity = 'ERROR'").limit(1).count()


def publish_if_passed(checks: DataFrame, publish: list[Callable[[], None]]) -> bool:
    """Two phases: every batch is checked before any is published; whether they were."""
    if not gate_passes(checks):
        return False
    for p in publish:
        p()
    return True


RUN_SCHEMA = "event_id string, run_id string, pipeline_name string, source string, status string, started_at timestamp, finished_at timestamp, fetched_rows long, loaded_rows long, failed_steps int, season_group_ids array<long>, metadata_json string, error_message string"


class RunLog:
    """Start and end of runs as rows of an append-only table; a run's state is that of its latest row."""

    def __init__(self, spark: SparkSession, path: str, pipeline: str, source: str):
        self.spark, self.path, self.pipeline, self.source = spark, path, pipeline, source
        self.open: dict[str, tuple] = {}

    def _add(self, row: tuple) -> None:
        self.spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(self.path)

    def start(self, run_id: str, at: datetime, groups: Iterable[int]) -> None:
        self.open[run_id] = (at, sorted(set(groups)))
        self._add((f"{run_id}-a", run_id, self.pipeline, self.source, "RUNNING", at, None, 0, 0, 0, self.open[run_id][1], "{}", None))

    def finish(self, run_id: str, at: datetime, fetched: int, loaded: int, failed_steps: int = 0, error: str | None = None, metadata: dict | None = None) -> str:
        """SUCCESS; FAILED_QUALITY if steps failed; FAILED if there is an error and none did."""
        status = "FAILED_QUALITY" if failed_steps else "FAILED" if error else "SUCCESS"
        began, groups = self.open.pop(run_id, (at, []))
        self._add((f"{run_id}-b", run_id, self.pipeline, self.source, status, began, at, fetched, 0 if failed_steps else loaded, failed_steps, groups, json.dumps(metadata or {}, ensure_ascii=False, sort_keys=True), error))
        return status


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, n)``: how many rows break each rule, all rules in one pass; a null condition is no break."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")


def freshness(hours: Column) -> Column:
    """fresh up to 6 hours, stale up to 24, else critical; unknown without a time."""
    return F.when(hours.isNull(), "unknown").when(hours <= 6, "fresh").when(hours <= 24, "stale").otherwise("critical")


def declared_freshness(hours: Column, warn: int = 3, error: int = 12) -> Column:
    """What a source's declared freshness says of its age in hours: pass, warn or error; error without any row."""
    return F.when(hours.isNull() | (hours >= error), "error").when(hours >= warn, "warn").otherwise("pass")
