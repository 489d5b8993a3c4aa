"""Rows that repeat an id with unlike texts."""

from sedgeflow.llm import simhash


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{n}" for n in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (3, c), (2, c)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, got)) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [(1, a), (1, b), (None, a), (2, c)])
