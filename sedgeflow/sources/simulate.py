"""A made change log, and the consumer that archives one: inputs for trying the histories out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.functions.contract import CHANGE

STATUSES = ("open", "pending", "resolved")
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def changes(spark: SparkSession, rows: int, keys: int = 100, partitions: int = 3, start: datetime = START) -> DataFrame:
    """CHANGE rows, the same for the same arguments: one a minute, over keys in turn, with their status
    in turn; every 17th is a delete. Times are text, as a log has them."""
    n = F.col("id")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(n / keys) % len(STATUSES) + 1).cast("int"))
    gone = n % 17 == 16
    after = F.struct(F.concat(F.lit("ticket "), n.cast("string")).alias("title"), F.concat(F.lit("k"), (n % 5).cast("string")).alias("category"), status.alias("status"))
    made = spark.range(rows).select(
        F.lit("synthetic").alias("source"), F.lit("tickets").alias("table"), F.concat(F.lit("t"), (n % keys).cast("string")).alias("key"),
        F.date_format(F.lit(start) + F.make_dt_interval(mins=n.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), n.alias("version"), F.when(gone, "d").otherwise("u").alias("op"),
        F.when(~gone, after).alias("after"), F.lit(None).cast("string").alias("transaction"), F.lit(None).cast("string").alias("source_position"), F.lit("changes").alias("kafka_topic"),
        (n % partitions).alias("kafka_partition"), F.floor(n / partitions).alias("kafka_offset"),
    )
    return made.select(*CHANGE.names)


def write_log(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, added to a folder."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(folder)


def archive(spark: SparkSession, folder: str, target: str, checkpoint: str, files: int = 1000) -> int:
    """Takes what a folder of lines has that wasn't archived yet to target, and commits it: a run that
    was stopped takes the same again under the same number, and replaces what it wrote. Returns how
    many batches there were."""
    done = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").text(f"{target}/batch={batch_id}")
        done.append(batch_id)

    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
