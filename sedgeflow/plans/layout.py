"""Layout and plans: compaction, and what a plan prunes, pushes down and shuffles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.sources.shared import list_files

FILE_BYTES = 128 << 20


def executed(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", executed(df)))


def partition_filters(df: DataFrame) -> list[str]:
    return [x for x in re.findall(r"PartitionFilters: \[(.*?)\]", executed(df)) if x]


def pushed_filters(df: DataFrame) -> list[str]:
    return [x for x in re.findall(r"PushedFilters: \[(.*?)\]", executed(df)) if x]


def read_columns(df: DataFrame) -> set[str]:
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>", executed(df)) for c in s.split(",") if c}


def compact(spark: SparkSession, source: str, target: str, partitions: tuple[str, ...] = (), file_bytes: int = FILE_BYTES) -> int:
    """Copies a Parquet folder into files of about file_bytes; returns how many it aimed at."""
    total = sum(n for p, n in list_files(spark, source) if p.endswith(".parquet"))
    files = max(1, -(-total // file_bytes))
    rows = spark.read.parquet(source)
    if partitions:
        rows.repartition(files, *partitions, F.rand(7)).write.mode("errorifexists").partitionBy(*partitions).parquet(target)
    else:
        rows.repartition(files).write.mode("errorifexists").parquet(target)
    return files


def files_of(df: DataFrame) -> DataFrame:
    """file, rows of each file that is read."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
