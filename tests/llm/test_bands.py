"""op5's bands are fitted to every labelled text."""

import random
import zlib

import numpy as np
import zstandard

from sedgeflow.llm import quality_bands


def plain(seen):
    """The same by a list of all (bytes, ratio)."""
    out = []
    for k, (least, low, high) in enumerate(quality_bands.BANDS):
        end = quality_bands.BANDS[k + 1][0] if k + 1 < len(quality_bands.BANDS) else None
        own = [r for n, r in seen if n >= least and (end is None or n < end)]
        if len(own) >= quality_bands.LEAST_TEXTS:
            a, b = np.quantile(own, [quality_bands.TAIL, 1 - quality_bands.TAIL])
            low, high = float(a) * (1 - quality_bands.ROOM), float(b) * (1 + quality_bands.ROOM)
        out.append((least, low, high))
    return tuple(out)


def test_quantiles_are_those_of_all_values(spark):
    r = random.Random(1)
    for sizes in ([49, 50, 0, 51, 1200, 1, 3000], [0] * 7):
        seen = [(quality_bands.BANDS[k][0] + 1, r.choice([r.random(), 0.5, 0.50001])) for k, n in enumerate(sizes) for _ in range(n)]
        assert quality_bands.fitted(spark.createDataFrame(seen, "n long, ratio double")) == plain(seen)


def test_more_labelled_texts_than_were_read(spark):
    """25,000 labelled texts outside the fold and copies of some: each takes part, copies once."""
    docs = [(n, " ".join(f"{(n * 7919 + k * k) % 1009}" for k in range(20 + n % 25))) for n in range(36_000)]
    docs += [(40_000 + n, docs[n][1]) for n in range(200)] + [(None, "x"), (50_000, None), (50_001, ""), (50_002, "few words")]
    labels = [(n, int(n % 11 > 0)) for n, _ in docs if n is not None] + [(5, 1), (None, 1), (6, None)]
    got = quality_bands.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    best, c = {}, zstandard.ZstdCompressor(level=quality_bands.LEVEL)
    said = {}
    for n, q in labels:
        if n is not None and q is not None:
            said[n] = max(q, said.get(n, 0))
    for n, text in docs:
        if n in said and zlib.crc32(str(n).encode()) % 5 and text:
            best[text] = max(best.get(text, 0), said[n])
    seen = [(len(t), len(c.compress(t.encode())) / len(t)) for t, q in best.items() if q and not quality_bands.judge(t, c)[5]]
    assert len(seen) > 20_000 and got == plain(seen)
