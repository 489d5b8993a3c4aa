"""Registered queries that SQL can't express, as they are, against plain versions."""

import os

import pytest

import brute
from sedgeflow.llm.entry import queries

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def found(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in queries()[name](spark, DATA).collect()), key=repr)


def test_token_files(spark, docs, tokenizer):
    assert found(spark, "op3_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.tokens(docs, tokenizer), key=repr)


def test_token_counts(spark, docs, tokenizer):
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in docs]
    assert found(spark, "op4_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((*w, w[2] > 512) for w in want), key=repr)


def test_quality(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    bands = brute.learned_bands(docs, labels)
    want = sorted(((i, *brute.quality(t), brute.kept(t, bands)) for i, t in docs), key=repr)
    assert found(spark, "op5_quality_bands", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want


def test_fingerprints(spark, docs):
    want = brute.simhash(docs)
    assert found(spark, "op10_simhash", "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", c) for i, (f, c) in want.items()), key=repr)


def test_substrings(spark, docs):
    assert found(spark, "op2_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs), key=repr)
