"""Spark's own event log as a table: task metrics by job group and stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_METRICS = "struct<`Executor Run Time`:long,`Executor CPU Time`:long,`JVM GC Time`:long,`Memory Bytes Spilled`:long,`Disk Bytes Spilled`:long,`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:long>,`Input Metrics`:struct<`Records Read`:long>>"
_SCHEMA = f"Event string, `Stage ID` int, `Job ID` int, `Stage IDs` array<int>, Properties map<string,string>, `Task Metrics` {_METRICS}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Only the fields that are summed; other events have nulls in them."""
    return spark.read.schema(_SCHEMA).json(path)


def stage_metrics(log: DataFrame) -> DataFrame:
    """job_group, stage, tasks, run_ms, cpu_ns, gc_ms, memory_spilled, disk_spilled, shuffle_written, rows_read."""
    jobs = log.where("Event = 'SparkListenerJobStart'").select(F.explode("Stage IDs").alias("stage"), F.element_at("Properties", F.lit("spark.jobGroup.id")).alias("job_group"))
    groups = jobs.groupBy("stage").agg(F.max("job_group").alias("job_group"))
    m = "`Task Metrics`."
    tasks = log.where("Event = 'SparkListenerTaskEnd'").groupBy(F.col("Stage ID").alias("stage")).agg(
        F.count(F.lit(1)).alias("tasks"),
        *[F.sum(m + c).alias(n) for n, c in (("run_ms", "`Executor Run Time`"), ("cpu_ns", "`Executor CPU Time`"), ("gc_ms", "`JVM GC Time`"), ("memory_spilled", "`Memory Bytes Spilled`"), ("disk_spilled", "`Disk Bytes Spilled`"), ("shuffle_written", "`Shuffle Write Metrics`.`Shuffle Bytes Written`"), ("rows_read", "`Input Metrics`.`Records Read`"))],
    )
    return tasks.join(groups, "stage", "left")
