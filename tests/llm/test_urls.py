"""The url classifier against a plain version: every way to cut a run, and counts by hand."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from sedgeflow.llm import url_filter

PAGES = "page_id long, url string, html string"


def plain_cut(run, known, total):
    """The cheapest of all ways to cut a run into words."""
    cost = lambda w: math.log(total / known[w]) if w in known else math.log(total) + len(w) * math.log(10)
    best = None
    for cuts in range(1 << (len(run) - 1)):
        at = [0, *(k for k in range(1, len(run)) if cuts >> (k - 1) & 1), len(run)]
        words = [run[a:b] for a, b in zip(at, at[1:], strict=False)]
        price = sum(map(cost, words))
        if best is None or price < best[0] - 1e-9:
            best = price, words
    return best[1]


def plain(pages, labels=(), held_out=0):
    """{page_id: (words, odds)} of [(page_id, host, path, verdict or None)], by plain loops."""
    counts = Counter(w for _, _, html, *_ in pages for w in re.findall(r"\b[a-z]{2,20}\b", html))
    names = [n.split("-") for n in (*url_filter.BLOCKED, *url_filter.ALLOWED)]
    strength = max(1, sum(counts.values()) // 10_000)
    for w in (w for n in names for w in n):
        counts[w] += strength
    total = sum(counts.values())
    tokens = lambda text: [w for run in re.findall("[a-z]+", text.lower()) for w in plain_cut(run, counts, total)]
    seen = {"block": Counter(), "allow": Counter()}
    learned = 0
    for i, url, _, verdict in pages:
        if verdict and not (held_out and zlib.crc32(str(i).encode()) % held_out == 0):
            learned += 1
            seen[verdict].update(tokens(url.split("://")[1]))
    for url, verdict in labels:
        learned += 1
        seen[verdict].update(tokens(url.split("://")[1]))
    for group, verdict in ((url_filter.BLOCKED, "block"), (url_filter.ALLOWED, "allow")):
        for name in group:
            for w in tokens(name):
                seen[verdict][w] += max(1, learned // 1000)
    size = len(seen["block"].keys() | seen["allow"].keys())
    n = {k: sum(c.values()) + 0.5 * size for k, c in seen.items()}
    out = {}
    for i, url, _, _ in pages:
        words = tokens(url.split("://")[1])
        odds = math.log(0.3 / 0.7) + sum(math.log((seen["block"][w] + 0.5) / n["block"]) - math.log((seen["allow"][w] + 0.5) / n["allow"]) for w in words if w in seen["block"] or w in seen["allow"])
        out[i] = " ".join(words), odds
    return out


def urls():
    r = random.Random(1)
    words = ["cheap", "pills", "city", "news", "shop", "the", "free", "blog", "zoo"]
    rows = []
    for n in range(60):
        zone, tongue = r.choice(["com", "net", "org"]), r.choice(["de", "fr", "en", "es"])
        host = "".join(r.choice(words) for _ in range(r.randint(1, 2)))
        verdict = "allow" if zone == "org" or (zone == "com" and tongue == "fr") else "block" if zone == "com" and tongue == "de" else None
        rows.append((n, f"http://{host}.{zone}/{tongue}/{r.choice(words)}", "the city and the shop cheap news " * r.randint(1, 3), verdict))
    return rows


@pytest.mark.parametrize("held_out", [0, 3])
def test_classifier_is_the_plain_one(spark, held_out):
    rows = urls()
    labels = [("http://freezoo.net/x", "block"), ("http://blogzoo.net/x", "allow")]
    pages = spark.createDataFrame([r[:3] for r in rows], PAGES)
    want = plain(rows, labels, held_out)
    got = url_filter.judge_urls(pages, url_filter.counted(pages), labels=spark.createDataFrame(labels + [(None, "block"), ("http://x.net", "maybe")], "url string, verdict string"), held_out=held_out).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.words == want[r.page_id][0] and r.odds == pytest.approx(want[r.page_id][1])
        assert r.guess == ("block" if r.odds > 0 else "allow")
        assert r.verdict == (rows[r.page_id][3] or r.guess)
