"""Substring deduplication: recurring passages, found in all documents by sharded automata.

A window is `window` consecutive words. Every window chooses an anchor: of the phrases of `phrase`
words in it the one with the least hash, the last of equals. Equal windows choose equal anchors, so

1. anchors that occur in two documents or more are found by one aggregation of a few rows for each
   hundred words;
2. the passages around them (the windows that choose one place, at most 2 * window - phrase words)
   are aggregated by their hash, which gives each the first document that holds it; a document's
   passage is confirmed to recur if an earlier document holds all of it, else the windows that an
   earlier document's passage shares with it are, each by the first of such passages;
3. documents are dealt into shards; each gets the confirmed passages that its documents ask for,
   compiles an Aho-Corasick automaton of their phrases over word numbers, and streams its documents
   through it. Every occurrence of a phrase is extended along the passages of earlier
   documents, word by word, so that hashes decide nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.llm.common import bounded, drop, partitions, pick, shared_dir, stage

WINDOW, PHRASE = 50, 16
#: Shards of documents for each shuffle partition; a task has one automaton at a time.
SHARDS = 2
#: Word hashes that a worker remembers.
WORDS = 500_000

# An odd multiplier and the constants of a common 64-bit mixer.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0x7FB5D329728EA185, 0x81DADEF4BC2DD44D)

_hashes: dict[bytes, int] = {}
_powers: list[np.ndarray] = []


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORDS:
        _hashes.clear()
    get, digest = _hashes.get, xxhash.xxh64_intdigest

    def of(w: bytes) -> int:
        h = get(w)
        if h is None:
            h = _hashes[w] = digest(w)
        return h

    return np.fromiter(map(of, words), np.uint64, len(words))


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, from one running sum modulo 2^64."""
    if not _powers or len(_powers[0]) < len(words):
        size = max(4096, 2 * len(words))
        _powers[:] = [np.cumprod(np.full(size, x % 2**64, np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64))]
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers[1][: len(words)], out=total[1:])
    x = (total[n:] - total[: len(words) - n + 1]) * _powers[0][: len(words) - n + 1]
    for shift, k in zip((31, 27), _MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x ^ (x >> np.uint64(33))


def anchors(words: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place that windows choose, in order: its hash (signed), the place, and the first of
    the windows that choose it (they are consecutive)."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    value = _rolling(_word_hashes(words), phrase)
    place = np.arange(len(value))
    width, size = window - phrase + 1, 1
    while size < width:
        step = min(size, width - size)
        later = value[step:] <= value[: len(value) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        value = np.where(later, value[step:], value[: len(value) - step])
        size += step
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return value[first].view(np.int64), place[first], first


def _passages(words: list[bytes], wanted: set[int], window: int, phrase: int) -> dict[tuple[int, bytes], int]:
    """(anchor, text of the passage around it): place of the anchor in the passage."""
    hashes, places, first = anchors(words, window, phrase)
    if not len(first):
        return {}
    last = np.r_[first[1:], len(words) - window + 1] - 1
    return {(h, b" ".join(words[a : b + window])): p - a for h, p, a, b in zip(hashes.tolist(), places.tolist(), first.tolist(), last.tolist(), strict=True) if h in wanted}


def _key(passage: bytes) -> int:
    return xxhash.xxh64_intdigest(passage) - (1 << 63)


def _needs(spark: SparkSession, held: DataFrame, folder: str, window: int, shards: int) -> DataFrame:
    """shard, kind 0, id (first), text, at: the confirmed passages that each shard's documents ask for.

    held has the passages of all documents: anchor, key, id, at, text. Only the rows of first
    documents are read with their texts. A window that many passages share asks for one of them, so
    what is sent grows with the passages and never with their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for anchor, key, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.unique(_rolling(_word_hashes(text.encode().split()), window).view(np.int64)).tolist()
                for column, values in zip(out, (repeat(anchor, len(found)), found, repeat(key, len(found)), repeat(first, len(found))), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "window", "key", "first"])

    firsts = stage(held.groupBy("anchor", "key").agg(F.min("id").alias("first")), f"{folder}/firsts")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    # Of each shard the greatest id says whether it asks, so a passage of a third of all documents is a row for each shard.
    last = stage(held.groupBy(shard, "anchor", "key").agg(F.max("id").alias("last")), f"{folder}/last")
    asked = stage(last.join(firsts, ["anchor", "key"]).where("first < last").select("shard", "anchor", "key"), f"{folder}/wholly")
    texts = stage(held.join(firsts, ["anchor", "key"]).where("id = first").select("anchor", "key", "first", "at", "text"), f"{folder}/texts", compression="zstd")
    drop(spark, f"{folder}/passages")
    several = stage(firsts.groupBy("anchor").count().where("count > 1").select("anchor"), f"{folder}/several")
    several = firsts.join(several, "anchor", "left_semi").select("anchor", "key")
    windows = stage(texts.join(several, ["anchor", "key"], "left_semi").select("anchor", "key", "first", "text").mapInArrow(run, "anchor long, window long, key long, first long"), f"{folder}/windows")
    owner = windows.groupBy("anchor", "window").agg(F.min(F.struct("first", "key")).alias("o"), F.max("first").alias("last")).where("o.first < last").drop("last")
    owner = stage(owner, f"{folder}/owner")
    later = windows.withColumnRenamed("first", "id").groupBy(shard, "anchor", "window").agg(F.max("id").alias("later"))
    later = stage(later.join(owner.select("anchor", "window"), ["anchor", "window"], "left_semi"), f"{folder}/later")
    partly = later.join(owner, ["anchor", "window"]).where("o.first < later").select("shard", "anchor", F.col("o.key").alias("key"))
    asked = stage(partly.distinct().unionByName(asked).distinct(), f"{folder}/asked")
    drop(spark, f"{folder}/windows", f"{folder}/owner", f"{folder}/wholly", f"{folder}/firsts", f"{folder}/last", f"{folder}/later")
    return asked.join(texts, ["anchor", "key"]).select("shard", F.lit(0).alias("kind"), F.col("first").alias("id"), "text", "at")


#: Characters that write one word of a shard.
DIGITS = 3


class Shard:
    """The passages of a shard's documents, and the automaton of their phrases.

    Words are numbered and written with DIGITS characters, each place with an alphabet of its own,
    so that matches start at words and no node of the automaton has many children. Words that no
    passage has are all written alike."""

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.passages: list[tuple[int, int, list[bytes]]] = []
        self.codes: dict[bytes, str] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, first: int, text: str, at: int) -> None:
        self.passages.append((first, at, text.encode().split()))

    def compile(self) -> None:
        known = {w for _, _, words in self.passages for w in words}
        base = next(b for b in range(16, 1 << 20) if b**DIGITS >= len(known))
        for n, w in enumerate(known):
            self.codes[w] = "".join(chr(2 + k * base + n // base**k % base) for k in range(DIGITS))
        phrases: dict[str, set[tuple[int, int, str]]] = {}
        for first, at, words in self.passages:
            own = "".join(map(self.codes.__getitem__, words))
            phrases.setdefault(own[DIGITS * at : DIGITS * (at + self.phrase)], set()).add((first, at, own))
        self.passages = []
        self.automaton = ahocorasick.Automaton()
        for phrase, found in phrases.items():
            self.automaton.add_word(phrase, sorted(found))
        if len(self.automaton):
            self.automaton.make_automaton()

    def removed(self, doc_id: int | None, words: list[bytes]) -> np.ndarray:
        """Which words are covered by a window that also starts in a smaller document."""
        edge = np.zeros(len(words) + 1, np.int64)
        if self.automaton is None:
            self.compile()
        if doc_id is None or len(words) < self.window or not len(self.automaton):
            return edge[:-1] > 0
        text = "".join(map(self.codes.get, words, repeat("\x01" * DIGITS)))
        done = (0, 0)  # the last range that was covered
        for end, found in self.automaton.iter(text):
            start = (end + 1) // DIGITS - self.phrase
            for first, at, own in found:
                if first >= doc_id:
                    break  # they are in order of their first documents
                lo = start - at
                hi = lo + len(own) // DIGITS
                if done[0] <= lo and hi <= done[1]:
                    continue
                if lo < 0 or not text.startswith(own, DIGITS * lo):
                    lo, hi = self._extended(text, start, own, at)
                    if hi - lo < self.window or (done[0] <= lo and hi <= done[1]):
                        continue
                edge[lo] += 1
                edge[hi] -= 1
                done = (min(lo, done[0]), max(hi, done[1])) if lo <= done[1] and done[0] <= hi else (lo, hi)
        return np.cumsum(edge[:-1]) > 0

    def _extended(self, text: str, start: int, own: str, at: int) -> tuple[int, int]:
        """The longest range of words around the phrase in which document and passage agree."""
        size = DIGITS
        left, most = 0, min(at, start)
        while left < most and text.startswith(own[(at - left - 1) * size : (at - left) * size], (start - left - 1) * size):
            left += 1
        right, most = self.phrase, min(len(own) // size - at, len(text) // size - start)
        while right < most and text.startswith(own[(at + right) * size : (at + right + 1) * size], (start + right) * size):
            right += 1
        return start - left, start + right


def deduplicate(df: DataFrame, window: int = WINDOW, phrase: int = PHRASE, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_words, n_removed, kept_sha256, and (keep_text) text: the words
    that are kept, joined by one space.

    A word is removed if a window that covers it equals a window of a document with a smaller id;
    windows are judged on the input. Words are runs of anything but ASCII white space. Null and
    empty texts have no words. Rows without an id are kept whole and make nothing else repeated;
    rows that repeat an id don't remove each other's words and give a row each. Other columns are
    ignored, whatever their names; ids are cast to long, so text ids must be numbers; an empty table
    gives an empty one.
    """
    spark = df.sparkSession
    bounded(spark)
    folder = shared_dir(spark)
    docs = pick(df, **{id_col: "long", text_col: "string"}).toDF("id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.unique(anchors((t.as_py() or "").encode().split(), window, phrase)[0])
                found.append(one)
                owner.append(np.full(len(one), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(owner))], names=["anchor", "id"])

    pairs = stage(docs.where("id IS NOT NULL").mapInArrow(scan, "anchor long, id long"), f"{folder}/pairs")
    # What is joined is written first: adaptive execution splits hot keys of plain sides.
    recurring = stage(pairs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), f"{folder}/recurring")
    own = stage(pairs.join(recurring, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), f"{folder}/anchors")
    drop(spark, f"{folder}/pairs", f"{folder}/recurring")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t, wanted in zip(*(batch.column(k) for k in range(3)), strict=True):
                i = i.as_py()
                for (anchor, passage), at in _passages(t.as_py().encode().split(), set(wanted.as_py()), window, phrase).items():
                    for column, value in zip(out, (anchor, _key(passage), i, at, passage.decode()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "key", "id", "at", "text"])

    found = docs.where("text IS NOT NULL").join(own, "id").select("id", "text", "anchors").mapInArrow(cut, "anchor long, key long, id long, at int, text string")
    held = stage(found, f"{folder}/passages", compression="zstd")
    shards = SHARDS * partitions(spark)
    sent = _needs(spark, held, folder, window, shards)
    shard = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(shards)).cast("int")  # rows without id aren't one task's
    rows = sent.unionByName(docs.select(shard.alias("shard"), F.lit(1).alias("kind"), "id", "text", F.lit(0).alias("at")))
    dealt = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "kind")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_shard, held = None, Shard(window, phrase)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for number, kind, i, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at_shard:
                    at_shard, held = number, Shard(window, phrase)
                if kind == 0:
                    held.add(i, text, at)
                    continue
                words = (text or "").encode().split()
                gone = held.removed(i, words)
                n = int(gone.sum())
                kept = b" ".join(words if not n else [words[k] for k in np.flatnonzero(~gone).tolist()])
                values = (i, len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[id_col, "n_words", "n_removed", "kept_sha256", text_col])
            yield made if keep_text else made.select(made.schema.names[:4])

    return dealt.mapInArrow(locate, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + f", `{text_col}` string" * keep_text)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, CAST(len(w) - 48 AS BIGINT))) AS i FROM d WHERE len(w) >= 50)),
start AS (SELECT g, min(doc_id) AS earliest FROM win WHERE doc_id IS NOT NULL GROUP BY g),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN start USING (g) WHERE earliest < doc_id),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS text
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM d) ANTI JOIN hit USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
