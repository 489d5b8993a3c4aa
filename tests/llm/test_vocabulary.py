"""The unigram model of op1 holds every counted word."""

from itertools import islice, product

from sedgeflow.llm import url_filter
from sedgeflow.llm.entry import queries


def test_rare_words_take_part(spark, tmp_path):
    many = ["z" + "".join(x) for x in islice(product("bcdfghjklm", repeat=5), 60_000)]
    html = " ".join(many * 4) + " middlesex" * 3 + " middle sex" * 500
    pages = spark.createDataFrame([(1, "http://middlesex.example.net/x", html), (2, "http://sex.example.net/x", ""), (None, None, None)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in queries()["op1_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {1: "allow", 2: "block", None: "allow"}


def test_each_run_is_cut_as_by_all_counts(spark):
    html = "cheap pills the rapist therapist library city citylibrary go goes " * 3 + "the city " * 40
    urls = ["http://therapist.cheappills.net/cityLibrary/goesthecity", "http://qqq.com/" + "ab" * 3000, "http://citylibrarythe.org/x1y2/the", None]
    pages = spark.createDataFrame([(n, u, html) for n, u in enumerate(urls)], "page_id long, url string, html string")
    counts = url_filter.unigrams(pages)
    known = dict(counts)
    strength = max(1, sum(counts.values()) // 10_000)
    for name in (*url_filter.BLOCKED, *url_filter.ALLOWED):
        for w in name.split("-"):
            known[w] = known.get(w, 0) + strength
    cutter = url_filter.Segmenter(known)
    for r in url_filter.judge_urls(pages, url_filter.counted(pages)).collect():
        assert r.words == " ".join(cutter.tokens(r.host) + cutter.tokens(r.path))
