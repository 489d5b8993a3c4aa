"""URL filters: rules on host and path, else naive Bayes over host names cut into words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm.common import bounded, lower_ascii, pick, shared_dir, stage

#: (verdict, rule): a rule is a host, then the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# Names from which the classifier learns, besides the urls that rules judge and those
# that a caller labels.
BLOCKED = (
    "cheap-pills", "spam-farm", "online-casino-bonus", "free-porn-videos", "adult-sex-cams", "buy-viagra-online", "payday-loans-fast",
    "replica-watches-outlet", "poker-betting-tips", "warez-crack-download", "torrent-free-movies", "hot-singles-chat", "xxx-tube",
    "slots-jackpot-win", "weight-loss-miracle", "fake-passport-shop", "click-bait-farm", "link-farm-seo", "cheap-meds-pharmacy",
    "escort-girls", "bitcoin-doubler-profit", "malware-keygen-serial", "phishing-login-verify", "casino-spam", "pills-discount-store",
)
ALLOWED = (
    "city-library", "state-university", "daily-news", "history-museum", "public-health-journal", "garden-recipes", "travel-blog",
    "weather-report", "science-review", "open-source-docs", "school-district", "city-council", "music-magazine", "book-club",
    "local-history", "math-forum", "language-course", "research-institute", "art-gallery", "football-club", "kitchen-blog",
    "nature-park", "software-manual", "world-atlas", "family-doctor",
)
LONGEST = 20
#: Most words that unigrams() takes to the driver; it fails beyond that.
DRIVER_WORDS = 1_000_000
#: A fixed name counts as one url in so many that are learned from.
NAME_SHARE = 1000
#: Share of urls taken to be bad before any word is seen.
PRIOR = 0.3
SMOOTHING = 0.5

_RUNS = re.compile(r"[a-z]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: what follows, up
    to ?, # or the end. Both are empty without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule's host stands for
    itself and all its subdomains. Of equal rules the first wins."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases, F.lit(None)) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def counted(pages: DataFrame, least: int = 1, text_col: str = "html") -> DataFrame:
    """w, count of every word of all pages' visible text that occurs so often, as a written table."""
    text = F.lower(F.regexp_replace(F.col(text_col), r"<[^>]*>", " "))
    words = pick(pages, text_col).select(F.explode(F.regexp_extract_all(text, F.lit(rf"\b([a-z]{{2,{LONGEST}}})\b"), F.lit(1))).alias("w"))
    return stage(words.groupBy("w").count().where(F.col("count") >= least), f"{shared_dir(pages.sparkSession)}/unigrams")


def unigrams(pages: DataFrame, least: int = 1, text_col: str = "html") -> dict[str, int]:
    """The same on the driver, for small tables: fails if there are more than DRIVER_WORDS."""
    rows = counted(pages, least, text_col).limit(DRIVER_WORDS + 1).collect()
    if len(rows) > DRIVER_WORDS:
        raise ValueError("too many words for the driver; use counted()")
    return {r["w"]: r["count"] for r in rows}


@dataclass
class Segmenter:
    """Splits a run of letters into its likeliest words by Viterbi's algorithm over unigrams. An
    unknown word of n letters is ten times less likely with each letter."""

    counts: dict[str, int]
    memory: dict[str, list[str]] = field(default_factory=dict)
    total: int = 0  # of all words, if counts holds only some of them

    def __post_init__(self) -> None:
        self.total = self.total or max(1, sum(self.counts.values()))
        self.cost = {w: math.log(self.total / n) for w, n in self.counts.items()}
        self.unknown = [math.log(self.total) + n * math.log(10) for n in range(LONGEST + 1)]

    def split(self, run: str) -> list[str]:
        if run in self.memory:
            return self.memory[run]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            best.append(min((best[k][0] + self.cost.get(run[k:end], self.unknown[end - k]), k) for k in range(max(0, end - LONGEST), end)))
        words, end = [], len(run)
        while end:
            start = best[end][1]
            words.append(run[start:end])
            end = start
        if len(self.memory) > 100_000:
            self.memory.clear()
        self.memory[run] = words[::-1]
        return self.memory[run]

    def tokens(self, text: str) -> list[str]:
        return [w for run in _RUNS.findall(text.lower()) for w in self.split(run)]


def _substrings(run: str) -> set[str]:
    return {run[k : k + n] for n in range(2, LONGEST + 1) for k in range(len(run) - n + 1)}


def _cut(runs: DataFrame, counts: DataFrame, named: Counter, total: int, folder: str) -> DataFrame:
    """run, words (in order) of each distinct run, written. Only substrings of the runs are looked up
    among the counts, and each run is cut once, by the counts of its own substrings."""
    runs = stage(runs.distinct().withColumn("r", F.monotonically_increasing_id()), f"{folder}/runs")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[str] = []
        for batch in batches:
            for run, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _substrings(run)
                ids += [r] * len(own)
                found += own
                if len(ids) >= 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["r", "w"])
                    ids, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["r", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = []
            for run, seen in zip(texts, own, strict=True):
                known = Counter({x["w"]: x["count"] for x in seen or ()})
                known.update({w: n for w, n in named.items() if w in run})
                words.append(Segmenter(dict(known), total=total).split(run))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    met = runs.select("run", "r").mapInArrow(spread, "r long, w string").join(counts, "w")
    seen = met.groupBy("r").agg(F.collect_list(F.struct("w", "count")).alias("seen"))
    return stage(runs.join(seen, "r", "left").select("run", "seen").mapInArrow(split, "run string, words array<string>"), f"{folder}/cut")


def _odds(urls: DataFrame, cut: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """w, odds: multinomial naive Bayes' log odds of block against allow of each word that a url with
    a known class (urls: runs, known) or a fixed name (names: w, bad, good) has, written.

    Runs are counted by class before they are joined with their words, so a run that a third of
    all urls have is one row."""
    known = urls.where("known IS NOT NULL").select("known", F.explode("runs").alias("run"))
    per_run = stage(known.groupBy("run").agg(F.count_if(F.col("known") == "block").alias("bad"), F.count_if(F.col("known") == "allow").alias("good")), f"{folder}/classes")
    share = F.greatest(F.lit(1), F.floor(F.lit(urls.where("known IS NOT NULL").count() / NAME_SHARE)))
    words = per_run.join(cut, "run").select(F.explode("words").alias("w"), "bad", "good")
    words = words.unionByName(names.select("w", (F.col("bad") * share).alias("bad"), (F.col("good") * share).alias("good")))
    model = stage(words.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), f"{folder}/model")
    size = model.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("good")).first()
    bad, good = (F.lit((n or 0) + SMOOTHING * size[0]) for n in size[1:])
    return model.select("w", (F.log((F.col("bad") + SMOOTHING) / bad) - F.log((F.col("good") + SMOOTHING) / good)).alias("odds"))


def judge_urls(pages: DataFrame, counts: dict[str, int] | DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED, labels: DataFrame | None = None, held_out: int = 0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: id, host, path, rule (the longest that fits, else null), verdict (allow
    or block: the rule's, else the classifier's), words (of host and path, joined by one space),
    odds (log odds of block), guess (the classifier's verdict, with a rule too).

    Host names run words together; the segmenter cuts each run of letters of host and path by the
    unigram counts, to which the words of the fixed names are added. Naive Bayes learns from all
    urls that a rule judges, from labels (url, verdict: block or allow), and from the fixed names,
    and adds up the words' log odds; words that no class has seen tell nothing. With held_out, rows
    whose crc32(id as text) mod held_out is 0 aren't learned from, so that guess can be held against
    their rules' verdicts. Counts are a table of counted(), of any size, or a dict of few words.

    A url that is null or has no :// has an empty host and path and no words: the prior decides
    (allow). Null ids are kept, repeated rows give a row each (and are learned from each), other
    columns are ignored, whatever their names, an empty table gives an empty one.
    """
    spark = pages.sparkSession
    bounded(spark)
    names = [name.split("-") for name in (*blocked, *allowed)]
    if isinstance(counts, dict):
        counts = spark.createDataFrame(list(counts.items()), "w string, count long")
    size = counts.agg(F.sum("count")).first()[0] or 0
    named = Counter(w for name in names for w in name)
    strength = max(1, size // 10_000)
    named = Counter({w: n * strength for w, n in named.items()})
    total = size + sum(named.values())
    # What the fixed names' own substrings count: as many rows as the names' letters allow.
    few = spark.createDataFrame([(w,) for w in sorted({x for w in named for x in _substrings(w)})], "w string")
    known = Counter({r["w"]: r["count"] for r in counts.join(F.broadcast(few), "w", "left_semi").collect()})
    known.update(named)
    cutter = Segmenter(dict(known), total=total)
    seeds = [(w, int(x in blocked), int(x in allowed)) for x in (*blocked, *allowed) for w in cutter.tokens(x)]

    held = pick(pages, id_col, **{url_col: "string"}).toDF("id", "url")
    host, path = host_and_path(F.col("url"))
    parts = held.select("id", host.alias("host"), path.alias("path")).withColumn("r", ruling(F.col("host"), F.col("path"), rules))
    learned = F.coalesce(F.crc32(F.col("id").cast("string")) % held_out != 0, F.lit(True)) if held_out else F.lit(True)
    urls = parts.select("id", "host", "path", "r.rule", "r.verdict", F.when(learned, F.col("r.verdict")).alias("known"), F.lit(True).alias("asked"))
    if labels is not None:
        host, path = host_and_path(F.col("url"))
        more = pick(labels, url="string", verdict="string").where(F.col("verdict").isin("block", "allow"))
        none = F.lit(None)
        urls = urls.unionByName(more.select(none.cast(urls.schema["id"].dataType).alias("id"), host.alias("host"), path.alias("path"), none.cast("string").alias("rule"), none.cast("string").alias("verdict"), F.col("verdict").alias("known"), F.lit(False).alias("asked")))
    runs = F.array_remove(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z]+"), "")
    folder = shared_dir(spark)
    urls = stage(urls.withColumn("runs", runs).withColumn("n", F.monotonically_increasing_id()), f"{folder}/urls")
    cut = _cut(urls.select(F.explode("runs").alias("run")), counts, named, total, folder)
    odds = _odds(urls, cut, spark.createDataFrame(seeds, "w string, bad long, good long"), folder)
    scored = cut.select("run", F.explode("words").alias("w")).join(odds, "w").groupBy("run").agg(F.sum("odds").alias("odds"))
    scored = stage(cut.join(scored, "run", "left"), f"{folder}/scored")
    placed = urls.where("asked").select("n", F.posexplode("runs").alias("at", "run")).join(scored, "run")
    inorder = F.array_sort(F.collect_list(F.struct("at", "words")))
    worded = placed.groupBy("n").agg(F.flatten(F.transform(inorder, lambda x: x["words"])).alias("words"), F.sum("odds").alias("odds"))
    all_odds = F.lit(math.log(PRIOR / (1 - PRIOR))) + F.coalesce("odds", F.lit(0.0))
    guess = F.when(all_odds > 0, "block").otherwise("allow")
    met = urls.where("asked").join(worded, "n", "left")
    return met.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"), F.coalesce(F.array_join("words", " "), F.lit("")).alias("words"), all_odds.alias("odds"), guess.alias("guess"))
