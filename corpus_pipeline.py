"""The corpus pipeline: quality, near-duplicates, benchmark passages, source weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result and
reads it again as the next one's docs, so a lost executor costs no more than the stage at hand.

Rows without an id go through every stage like others, by their texts, but are nobody's near-duplicate.
Null and empty texts are rejected by the first stage; were one to reach a later stage, it would stay
there and be written as a document without ids. Rows that are equal in all columns are near-duplicates of
each other; rows that repeat an id with other texts are judged by their texts. Other columns ride along,
whatever their names. An empty table gives an empty one, at every stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.llm import decontaminate, mixing, quality_bands, similar, token_files
from sedgeflow.llm.common import partitions, shared_dir, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with bands fitted to the labelled texts. The verdict
    rides with its row: nothing is joined."""
    return quality_bands.keep(docs, quality_bands.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates: SimHash in
    bit-sliced blocks over 5-word shingles, with a wide radius, and an exact similarity of 0.8 or more."""
    return similar.drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the fair queue sends it whole, in the queue's order."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files in the order of the mix, and returns what they hold for each document."""
    import public_tokenizers

    read = token_files.round_trip(in_file_order(docs), public_tokenizers.path("byte_bpe_50k.json"), order="given")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def in_file_order(docs: DataFrame) -> DataFrame:
    """Rows of a written table, range-sorted by file and place, as they were written: a scan deals
    files over its tasks as it likes. What isn't a table of files is left as it lies."""
    try:
        place = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs
    return place.repartitionByRange(partitions(docs.sparkSession), "_file", "_row").sortWithinPartitions("_file", "_row").drop("_file", "_row")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("weights", weights), ("tokens", tokens)]

#: Similar texts' components, compression ratios and a tokenizer's ids are beyond SQL; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
