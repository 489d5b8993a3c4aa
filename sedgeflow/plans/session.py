"""Session settings for the engine's jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and adaptive execution; everything that depends on the cluster's size is left to its own settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
STREAM_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def configured(spark: SparkSession, streaming: bool = False) -> SparkSession:
    for k, v in (SETTINGS | (STREAM_SETTINGS if streaming else {})).items():
        spark.conf.set(k, v)
    return spark
