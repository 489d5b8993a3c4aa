"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm.common import bounded, labelled, pick, shared_dir

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
HIDDEN = ("​", "‌", "‍", "⁠", "﻿", "­")
#: Phrases in which a word of the lexicon is no abuse, besides those that learn() finds.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "trash collection", "clown fish", "clown car")

#: Most labelled rows that the lexicon and its calibration are learned from (the first by a hash of the
#: id). What is learned from them, candidates and entries, has no bound of its own.
TRAIN_ROWS = 20_000
#: Least toxic training texts of an entry, and least other ones of an exception.
SUPPORT, EXCUSED = 3, 2
#: Lengths of word beginnings that are candidates besides whole words.
STEMS = range(4, 9)
#: Least share of an entry's training texts that are toxic, and of an exception's that aren't.
PURITY = 0.8

_FOLD = str.maketrans(HOMOGLYPHS | {c: None for c in HIDDEN})
_LEET = str.maketrans(DIGITS)
_GAP = re.compile(r"[\W_]+")
_HAS_SIGN = re.compile(r"[@$!\d]")
_RUN = re.compile(r"[^\W_]*[@$!\d](?:[^\W_]|[@$!])*")
_LETTER = re.compile(r"[^\W\d_]")


def _unsigned(found: re.Match) -> str:
    """A run of letters and signs, with the signs between and beside its letters as letters: those
    between any two, and runs of @, $ and digits before the first or behind the last. A letter alone
    with signs behind it stays as it is, and so does ! as the end of a sentence."""
    run = found[0]
    first = _LETTER.search(run)
    if first is None:
        return run
    lo, hi = first.start(), len(run)
    while not _LETTER.match(run, hi - 1):
        hi -= 1
    a, b = lo, hi
    while a and run[a - 1] != "!":
        a -= 1
    while b < len(run) and run[b] != "!":
        b += 1
    if a == lo and hi - lo == 1:
        return run
    return run[:a] + run[a:b].translate(_LEET) + run[b:]


def fold(text: str) -> str:
    """Words in folded letters, with one space before, between and behind them. Every step passes over
    the text once, whatever it is."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _RUN.sub(_unsigned, text) if _HAS_SIGN.search(text) else text
    return " " + _GAP.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """entries: weight of each pattern (" word " or " beginning"), in folded letters."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p in self.exceptions:
            found.add_word(fold(p), (len(fold(p)), None))
        for p, w in self.entries.items():
            found.add_word(p, (len(p), w))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, float]]:
    """(start, weight) of the words that match, each by its longest entry, outside exceptions. Starts
    and exceptions are sorted and swept once."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(folded):
        start = end - n + 1
        if weight is None:
            excused.append((start, end))
        elif start not in best or best[start][0] < n:
            best[start] = (n, weight)
    excused.sort()
    out, k, until = [], 0, 0
    for start in sorted(best):
        while k < len(excused) and excused[k][0] <= start:
            until = max(until, excused[k][1])
            k += 1
        if start >= until:
            out.append((start, best[start][1]))
    return out


def matched(automaton: ahocorasick.Automaton, folded: str) -> float:
    """Sum of the weights of matches()."""
    return sum(w for _, w in matches(automaton, folded))


def signals(weight: float, words: int) -> tuple[float, float]:
    """What the score is made of: the total, and the total by length."""
    return math.log1p(weight), 100.0 * weight / (words + 20)


def _patterns(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        for n in STEMS:
            if n > len(w):
                break
            out.add(" " + w[:n])
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(3), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def chosen(candidates: dict[str, tuple[int, int]], held: list[list[str]]) -> list[str]:
    """Entries among candidates (pattern: toxic texts, others), in the order in which they are taken:
    in turn by the toxic texts that they reach, less the others, the longer of two equals. held has
    the candidates of each toxic text; a text counts half with each entry that it holds already,
    and none is taken for less than SUPPORT. Worths only fall, so a heap of older ones is enough."""
    of: dict[str, list[int]] = {}
    for i, own in enumerate(held):
        for p in own:
            of.setdefault(p, []).append(i)
    worth = [1.0] * len(held)
    rank = {p: k for k, p in enumerate(sorted(of, key=lambda p: (len(p), p)))}
    heap = [(candidates[p][1] - len(texts), -rank[p], p) for p, texts in of.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        cost, order, p = heapq.heappop(heap)
        now = candidates[p][1] - sum(worth[i] for i in of[p])
        if now > cost:
            if -now >= SUPPORT:
                heapq.heappush(heap, (now, order, p))
            continue
        if -now < SUPPORT:
            break
        out.append(p)
        for i in of[p]:
            worth[i] /= 2
    return out


def _phrases(automaton: ahocorasick.Automaton, folded: str) -> set[str]:
    """Each matched word with the one before it, and with the one behind it."""
    out = set()
    for start, _ in matches(automaton, folded):
        end = folded.index(" ", start + 1)
        if start:
            out.add(folded[folded.rindex(" ", 0, start) + 1 : end])
        if end + 1 < len(folded):
            out.add(folded[start + 1 : folded.index(" ", end + 1)])
    return out


def _counted(texts: DataFrame, parts) -> DataFrame:
    """part, toxic, other: in how many texts each of parts(folded text) occurs, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = parts()
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic == 1].update(find(fold(text or "")))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"part": pa.array(keys, pa.string()), "toxic": pa.array([seen[1][k] for k in keys], pa.int64()), "other": pa.array([seen[0][k] for k in keys], pa.int64())})

    return texts.mapInArrow(run, "part string, toxic long, other long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon, its exceptions and its calibration from at most train_rows labelled rows outside
    the held-out fold (see labelled). Only id, text and label are read.

    A pattern's weight is the log odds of the share of toxic and other texts that hold it; equal
    texts count once; chosen() says which are entries. So a text that was copied a lot, all of whose
    words look toxic, adds a few entries, and a common word of abuse is taken though it mostly comes
    with others. A matched word with one beside it is an exception if EXCUSED or more other texts
    hold the two and PURITY of all that do are others. Null ids and labels are left out; without
    toxic texts or without others nothing is learned, and an empty table gives an empty lexicon.
    """
    bounded(docs.sparkSession)
    texts = labelled(docs, labels, "toxic", train_rows, shared_dir(docs.sparkSession))
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = size.get(1, 0), sum(n for k, n in size.items() if k != 1)
    if not n_toxic or not n_other:
        return Lexicon({}, exceptions, (-10.0 if n_other or not n_toxic else 10.0, 0.0, 0.0))
    pure = _counted(texts, lambda: _patterns).where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("other"))))
    candidates = {r["part"]: (r["toxic"], r["other"]) for r in pure.collect()}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(_patterns(fold(t or "")) & candidates.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"held": pa.array(held, pa.list_(pa.string()))})

    held = [r["held"] for r in texts.where("label = 1").mapInArrow(incidence, "held array<string>").collect()]
    weight = lambda toxic, other: math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
    entries = {p: weight(*candidates[p]) for p in chosen(candidates, held)}
    bare = Lexicon(entries, (), (0.0, 0.0, 0.0))

    def around():
        automaton = bare.automaton()
        return lambda folded: _phrases(automaton, folded)

    innocent = _counted(texts, around).where((F.col("other") >= EXCUSED) & (F.col("other") >= PURITY * (F.col("toxic") + F.col("other"))))
    excused = (*exceptions, *sorted(r["part"] for r in innocent.collect()))
    rows = _signals(texts, Lexicon(entries, excused, (0.0, 0.0, 0.0))).collect()
    x, y = np.array([[r["total"], r["dense"]] for r in rows], float).reshape(-1, 2), np.array([r["label"] == 1 for r in rows], float)
    return Lexicon(entries, excused, _fit(x, y))


def _signals(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            made = []
            for t in batch.column(0).to_pylist():
                folded = fold(t or "")
                made.append(signals(matched(automaton, folded), folded.count(" ") - 1))
            total, dense = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(total, pa.float64()), pa.array(dense, pa.float64())], names=["label", "total", "dense"])

    return texts.mapInArrow(run, "label int, total double, dense double")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, held_out (crc32 of the id's text mod 5 is 0), weight (of the matched
    entries), score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts match nothing and are scored so; a null id is in no fold (held_out false);
    repeated rows give a row each; other columns are ignored; an empty table gives an empty one.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        a, b, c = lexicon.coefficients
        for batch in batches:
            weights, scores = [], []
            for t in batch.column(2):
                folded = fold(t.as_py() or "")
                weight = matched(automaton, folded)
                total, dense = signals(weight, folded.count(" ") - 1)
                weights.append(weight)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * dense)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weights, pa.float64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[id_col, "held_out", "weight", "score", "predicted"],
            )

    held = pick(docs, id_col, **{text_col: "string"})
    kind = held.schema[id_col].dataType.simpleString()
    fold_of = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return held.select(id_col, fold_of.alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, weight double, score double, predicted int")
