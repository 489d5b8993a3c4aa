"""Near-duplicates by similarity, against every pair of shingle sets."""

import os
import random

import numpy as np
import pytest

from brute import words
from sedgeflow.llm import similar

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def shingles(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(docs):
    """The component, named by its place in docs, of each of [(id, text)], and the similar pairs."""
    sets, group, pairs = [shingles(t) for _, t in docs], list(range(len(docs))), 0
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs += 1
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return group, pairs


def first(docs):
    """Smallest id of each component: no id repeats."""
    group = groups(docs)[0]
    return sorted(min(i for (i, _), g in zip(docs, group, strict=True) if g == x) for x in set(group))


def edited(seed, n_docs=12):
    """Families of texts with from none to many changed words, some of them chained."""
    r, out = random.Random(seed), []
    for _ in range(n_docs):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 20, 60, 200, 400]))]
        out.append(" ".join(base))
        for _ in range(r.randrange(6)):
            w = list(base)
            for _ in range(max(1, int(len(w) * r.choice([0.002, 0.01, 0.02, 0.025, 0.03, 0.05])))):
                w[r.randrange(len(w))] = f"v{r.randrange(3000)}"
            out.append(" ".join(w))
            if r.random() < 0.5:
                base = w
    r.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [similar.GROUP_SHINGLES, 300])
def test_similar(spark, limit):
    texts = edited(1, 30) + ["", None, " \n", "one two", "One  TWO", "x " * 2000]
    docs = [(1000 - n, t) for n, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, node int").repartition(3)
    got = similar.drop_similar(df, group_shingles=limit)
    want = first(docs)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(docs) - 20
    assert got.columns == df.columns and similar.drop_similar(df.limit(0)).collect() == []


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{n}" for n in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (None, None), (3, c), (2, c)]
    got = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, got)) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [(1, a), (1, b), (None, a), (None, None), (2, c)])


def test_bands_miss_no_similar_pair():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(5, 400)
        base = [r.getrandbits(64) for _ in range(n)]
        other = base[: n - n // 9] + [r.getrandbits(64) for _ in range(n // 9)]  # at 0.8 or just above
        x, y = (similar.bands(np.unique(np.array(s, np.uint64))) for s in (base, other))
        assert (x == y).any()


def test_forest():
    for seed in range(4):
        docs = list(enumerate(edited(seed)))
        links = list(similar.forest([similar.shingles(t) for _, t in docs]))
        group, pairs = groups(docs)
        assert all(group[a] == group[b] for a, b in links) and len(links) == len(docs) - len(set(group)) and pairs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stage_is_similarity(spark):
    import corpus_pipeline

    docs = corpus_pipeline.quality(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    got = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert sorted(r.doc_id for r in got.collect()) == first([(r.doc_id, r.text) for r in docs.collect()])
