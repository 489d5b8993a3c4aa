"""The toxicity lexicon against a plain version, and texts made to be slow."""

import random
import re
import time
import zlib

import pytest

from sedgeflow.llm import toxicity

#: What a word with signs is, plainly: signs are letters between letters and beside them.
SIGNED = re.compile(r"(?:[^\W\d_][@$!\d]*|[@$\d]+(?=[^\W\d_]))(?:[@$!\d]*[^\W\d_])+[@$\d]*")


def plain_fold(text):
    leet = str.maketrans(toxicity.DIGITS)
    text = SIGNED.sub(lambda m: m[0].translate(leet), text.lower())
    return " " + re.sub(r"[\W_]+", " ", text).strip() + " "


def test_folding_is_the_plain_rule():
    r = random.Random(7)
    for n in range(4000):
        text = "".join(r.choice("ab1!@$5 _.é") for _ in range(r.randrange(14)))
        assert toxicity.fold(text) == plain_fold(text), repr(text)


def plain_lexicon(texts):
    """Entries, in turn, of [(text, toxic)]: every candidate is weighed anew each time."""
    import math

    toxic, other = [toxicity.fold(t) for t, y in texts if y], [toxicity.fold(t) for t, y in texts if not y]

    def patterns(folded):
        words = set(folded.split())
        return {f" {w} " for w in words if len(w) >= 3} | {" " + w[:n] for w in words for n in range(4, 9) if n <= len(w)}

    held = [patterns(t) for t in toxic]
    clean = [patterns(t) for t in other]
    counts = {p: (sum(p in h for h in held), sum(p in h for h in clean)) for p in set().union(*held)}
    counts = {p: c for p, c in counts.items() if c[0] >= 3 and c[0] >= 0.8 * sum(c)}
    worth, entries = [1.0] * len(held), {}
    while True:
        left = [(sum(w for w, h in zip(worth, held, strict=True) if p in h) - counts[p][1], len(p), p) for p in counts if p not in entries]
        if not left or max(left)[0] < 3:
            break
        p = max(left)[2]
        entries[p] = math.log((counts[p][0] + 0.5) / (len(toxic) + 1)) - math.log((counts[p][1] + 0.5) / (len(other) + 1))
        worth = [w / 2 if p in h else w for w, h in zip(worth, held, strict=True)]
    return entries


def plain_weight(entries, exceptions, folded):
    """Each word by its longest entry, unless an exception spans it."""
    total, inside = 0.0, set()
    for e in exceptions:
        e, at = toxicity.fold(e), -1
        while (at := folded.find(e, at + 1)) >= 0:
            inside.update(range(at, at + len(e) - 1))
    for at in range(len(folded)):
        fits = [(len(p), w) for p, w in entries.items() if folded.startswith(p, at)]
        if fits and at not in inside:
            total += max(fits)[1]
    return total


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for n in range(300):
        w = [word() for _ in range(30)]
        bad = n % 4 == 0
        if bad:
            w[r.randrange(30)] = r.choice(["moronic", "scum", "tr4sh"])
        elif n % 61 == 0:
            k = r.randrange(28)
            w[k : k + 2] = ["pond", "scum"]  # a phrase that other texts hold
        docs.append((n, " ".join(w)))
        labels.append((n, int(bad)))
    return docs, labels


def test_lexicon_is_the_plain_one(spark):
    docs, labels = corpus()
    made = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    train = [(t, y) for (i, t), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    want = plain_lexicon(train)
    assert list(made.entries) == list(want) and made.entries == pytest.approx(want)
    assert "pond scum" in made.exceptions
    a, automaton = made.coefficients, made.automaton()
    for _, t in docs:
        folded = toxicity.fold(t)
        assert toxicity.matched(automaton, folded) == pytest.approx(plain_weight(want, made.exceptions, folded))
    scored = {x.doc_id: x for x in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), made).collect()}
    import math

    for i, t in docs:
        w = plain_weight(want, made.exceptions, toxicity.fold(t))
        z = a[0] + a[1] * math.log1p(w) + a[2] * 100 * w / (len(toxicity.fold(t).split()) + 20)
        assert scored[i].score == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a1" * 500_000, "$" * 1_000_000, "1a " * 333_333, "!1" * 500_000, "trash can " * 100_000, "trash " * 160_000, "a" + "!" * 999_999, "é1!" * 330_000])
def test_long_texts_are_scored_at_once(text):
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tras": 1.0}, toxicity.EXCEPTIONS, (0.0, 1.0, 1.0))
    automaton = lexicon.automaton()
    t0 = time.process_time()
    toxicity.matched(automaton, toxicity.fold(text))
    assert time.process_time() - t0 < 4
