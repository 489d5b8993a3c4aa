"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedgeflow.llm.common import table


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.url_filter import counted, judge_urls

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, counted(pages)).select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.substring_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), keep_text=False)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _vocabulary())


def op5_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.quality_bands import learn, quality

    docs = table(spark, sf_dir, "documents")
    return quality(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.revisits import captures, digest, resolve_revisits

    return digest(resolve_revisits(captures(table(spark, sf_dir, "pages"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgeflow.llm.simhash import hexadecimal, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(found["fp"]).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_url_filter, op2_substring_dedup, op3_token_files, op4_token_counts, op5_quality_bands, op6_revisits, op7_toxicity, op8_decontamination, op9_mixing, op10_simhash]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    from sedgeflow.llm import decontaminate, mixing, revisits, substring_dedup

    return {"op2_substring_dedup": substring_dedup.SQL, "op6_revisits": revisits.SQL, "op8_decontamination": decontaminate.SQL, "op9_mixing": mixing.SQL}
