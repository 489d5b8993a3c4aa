"""URL filters, revisits, toxicity and the pipeline."""

import os

import pytest

from sedgeflow.llm import revisits, toxicity, url_filter
from sedgeflow.llm.entry import oracle_sql, queries

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")

URLS = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notorg/x", "notorg", "/x", None, "allow"),
    ("https://org", "org", "", None, "allow"),
    ("x://b.com/fr/#?", "b.com", "/fr/", "com/fr/", "allow"),
    ("x://b.com/de/a/b?q=://c", "b.com", "/de/a/b", "com/de/", "block"),
    ("x://com/de", "com", "/de", None, "allow"),
    ("http://cheappillsshop.example.net/en/1", "cheappillsshop.example.net", "/en/1", None, "block"),
    ("http://spam-farm.example.com/", "spam-farm.example.com", "/", None, "block"),
    ("http://citylibrary.example.net/spam", "citylibrary.example.net", "/spam", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("://?q", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://" + "q" * 20000 + "/" + "z" * 20000, "q" * 20000, "/" + "z" * 20000, None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(n, u, "<p>the city and the shop</p>", "r", "v") for n, (u, *_) in enumerate(URLS)] + [(None, None, None, "r", "v")], "page_id long, url string, html string, rule string, VERDICT string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.unigrams(pages, least=1)).collect()}
    assert got.pop(None) == ("", "", None, "allow")
    assert got == {n: tuple(x[1:]) for n, x in enumerate(URLS)}
    assert url_filter.judge_urls(pages.limit(0), {}).collect() == [] and url_filter.unigrams(pages.limit(0)) == {}


def test_segments():
    s = url_filter.Segmenter({"cheap": 50, "pills": 40, "che": 5, "appills": 1, "the": 900, "rapist": 1, "therapist": 30})
    assert s.split("cheappills") == ["cheap", "pills"] and s.split("therapist") == ["therapist"]
    assert "".join(s.split("qqqzz" * 20)) == "qqqzz" * 20


def record(n, kind, url, at, headers=None, payload=None):
    return (n, kind, url, at, 304 if kind == "revisit" else 200, headers or {}, payload)


def test_revisits(spark):
    rows = [
        record(1, "response", "http://www.A.com/x/?utm_source=f#t", 10, {"ETag": '"1"', "Content-Type": "text/html", "Server": "s"}, "one"),
        record(2, "response", "https://a.com/x", 20, {"ETag": '"2"'}, "two"),
        record(3, "revisit", "http://a.com:80/x?ref=1", 15, {"etag": 'W/"1"', "Server": "other", "Date": "d"}),
        record(4, "revisit", "http://a.com/x", 20, {"ETag": '"1"'}),  # not later than 2
        record(5, "revisit", "http://a.com/x", 10**8, {"ETag": '"3"'}),  # over many spans
        record(6, "revisit", "http://b.com/", 5),
        record(7, "revisit", "http://a.com/x", 30, {"Last-Modified": "m"}),
        record(8, "revisit", None, 30),
        record(9, "response", "http://a.com/x?p=1", None, None, ""),
        record(10, "revisit", "http://a.com/x?p=1&fbclid=2", 0),
        record(11, "response", "http://c.com", 7, None, "a"),
        record(12, "response", "http://c.com", 7, None, "b"),
        record(13, "revisit", "http://c.com/", 8),
        (14, "response", "http://b.com", 1, 404, {}, "missing"),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], revisits.RECORD + ", canonical int, OUTCOME string")
    found = revisits.resolve_revisits(df, span=8).collect()
    assert len(found) == len(rows)
    got = {r.record_id: (r.outcome, r.source_id, r.payload) for r in found}
    assert got == {
        1: ("full", None, "one"), 2: ("full", None, "two"), 3: ("resolved", 1, "one"), 4: ("resolved", 1, "one"), 5: ("changed", None, None), 6: ("orphan", None, None),
        7: ("resolved", 2, "two"), 8: ("orphan", None, None), 9: ("full", None, ""), 10: ("resolved", 9, ""), 11: ("full", None, "a"), 12: ("full", None, "b"),
        13: ("resolved", 12, "b"), 14: ("full", None, "missing"), None: ("full", None, None),
    }
    assert next(r.headers for r in found if r.record_id == 3) == {"etag": 'W/"1"', "content-type": "text/html", "server": "s", "date": "d"}
    assert revisits.resolve_revisits(df.limit(0)).collect() == []


def test_folding():
    assert toxicity.fold("Yоu ST0PID 1diot, b@d!") == " you stopid idiot bad "
    assert toxicity.fold("") == "  " and toxicity.fold("100 $5 50%") == " 100 5 50 "


def test_toxicity(spark):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for n in range(400):
        w = [word() for _ in range(40)]
        bad = n % 4 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["moronic", "sc\u0443m", "scum", "tr4sh"])
        docs.append((n, " ".join(w)))
        labels.append((n, int(bad)))
    docs += [(1000, "trash can " + docs[1][1]), (1001, None), (1002, ""), (None, "scum"), (1003, "scum " * 3000), (1003, "scum")]
    d = spark.createDataFrame([(*x, 1, 0.5) for x in docs], "doc_id long, text string, toxic int, SCORE double")
    made = toxicity.learn(d, spark.createDataFrame(labels + [(5, None), (None, 1), (1, 0)], "doc_id long, toxic int"))
    got = {}
    for x in toxicity.score(d, made).collect():
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
        got.setdefault(x.doc_id, []).append(x)
    import zlib

    assert all(got[n][0].held_out == (zlib.crc32(str(n).encode()) % 5 == 0) for n in range(400))
    assert all(got[n][0].predicted == y for n, y in labels)
    assert got[1000][0].predicted == 0 and got[1001][0].predicted == got[1002][0].predicted == 0 and len(got[1003]) == 2
    assert got[None][0].predicted == 1
    nothing = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.predicted for x in toxicity.score(d, nothing).collect()} == {0}
    assert toxicity.score(d.limit(0), made).collect() == []


@tables
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    made = queries()[name](spark, DATA)
    cur = c.execute(oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(made.columns)
    want = sorted(tuple(repr(r[cols.index(k)]) for k in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(repr(r[k]) for k in sorted(cols)) for r in made.collect()) == want


@tables
def test_pipeline(spark):
    """run() against plain versions of its stages, one row after another."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from brute import decontamination, kept, learned_bands, tokens
    from test_similar import first
    from test_texts import queue

    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    bands = learned_bands([(r["doc_id"], r["text"]) for r in rows], labels)
    rows = [r for r in rows if kept(r["text"], bands)]
    stay = set(first([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if r["doc_id"] in stay]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {x[0] for x in decontamination([(r["doc_id"], r["text"]) for r in rows], bench) if not x[-1]}
    rows = [r for r in rows if r["doc_id"] in clean]
    mixed = [(i, t) for i, _, t in queue([(r["doc_id"], r["source"], r["text"]) for r in rows])[2]]
    want = tokens(mixed, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ascending=False)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()), key=lambda r: r[1])
    assert got == want


CLASHES = ["_id", "_key", "_first", "_copy", "_n", "spans", "id", "h1", "DOC_ID", "Text", "at", "_0", "node", "finish_time"]


def clashing(spark):
    """Documents with nulls, empties, repeats and columns named as operators' own; two only differ in
    case. Parquet can't hold those, so they come from memory."""
    texts = [" ".join(f"{x}{n}" for n in range(40)) for x in "abcdef"]
    rows = [(1, texts[0], "s1"), (1, texts[1], "s1"), (2, texts[0], None), (2, texts[0], None), (None, texts[2], "s2"), (None, None, None), (3, "", "s2"), (4, None, "s1"), (5, texts[3] + " " + texts[4], "s2"), (6, texts[5] * 30, "s1")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return rows, spark.createDataFrame([(*r, "en", 1, *range(len(CLASHES))) for r in rows], schema), texts


def test_stages_with_clashing_names(spark):
    """Every operator that a stage calls, on rows with nulls, repeats and clashing columns."""
    from sedgeflow.llm import decontaminate, mixing, quality_bands, simhash, similar

    rows, docs, texts = clashing(spark)
    back = lambda df: sorted(((r[0], r[1]) for r in df.collect()), key=repr)
    bench = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    long = [(i, t) for i, t, _ in rows if len((t or "").split()) >= 20]
    for made, want in (
        (quality_bands.keep(docs), [x for x in long if len(x[1].split()) < 1000]),
        (similar.drop_similar(docs), [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None), (3, ""), rows[8][:2], rows[9][:2]]),
        (simhash.drop_near_duplicates(docs), [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None), (3, ""), rows[8][:2], rows[9][:2]]),
        (decontaminate.decontaminate(docs, bench), [(i, t) for i, t, _ in rows if i != 5]),
        (decontaminate.decontaminate(docs, bench, "spans"), [(i, t if i != 5 else " " + texts[4]) for i, t, _ in rows]),
    ):
        assert made.columns == docs.columns
        assert back(made) == sorted(want, key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {(r[0], r[1]) for r in mixed.collect()} <= {(i, t) for i, t, _ in rows}
    assert len(mixed.collect()) == sum(r.copies for r in mixing.schedule(docs).collect())
    for step in (quality_bands.keep, similar.drop_similar, simhash.drop_near_duplicates, lambda d: decontaminate.decontaminate(d, bench), mixing.mix):
        none = step(docs.limit(0))
        assert none.columns == docs.columns and none.collect() == []


def test_stages_keep_columns():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "weights", "tokens"]
