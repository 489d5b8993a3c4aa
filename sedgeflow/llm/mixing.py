"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeflow.llm.common import hashed, n_words, named, partitions, place, shared_dir, stage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
#: Documents that one task orders, on average, and buckets whose sums one task adds up.
BUCKET_ROWS = 1024


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """source, n (rows), source_size, weight, target, from rows of source and size.

    Sources by code point, null last, weigh weights[0], weights[1], ..., again and again. They share
    budget times all words by weight; a target stops at `repeats` times its source's size and the
    rest is shared among the others. In order of the stop by weight, the sources that stop come
    first; the level (target by weight) of the others is the greatest that any cut gives.
    The windows here are over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("stop", (F.col("source_size") * repeats).cast("double"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(budget) - before) / others).withColumn("level", F.max("level").over(every))
    return per.select("source", "n", "source_size", "weight", F.least("stop", F.col("weight") * F.col("level")).alias("target"))


def _positions(units: DataFrame, targets: DataFrame, folder: str, spread: int) -> DataFrame:
    """units with target, source_size and start: the words before each in its source's shuffled order.

    The mark deals a source's units into ordered buckets. Running totals are sums within a bucket,
    of buckets within a group of buckets, and of groups within a source, so no task holds more of
    a source than one row for each million documents.
    """
    at = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    dealt = units.join(targets.select("s", "n", "source_size", "target"), "s").withColumn("bucket", F.floor(at * buckets / F.lit(1 << 32)))
    dealt = dealt.repartition(spread, "s", "bucket")  # else sums would be dealt by source alone
    earlier = (Window.unboundedPreceding, -1)
    sums = dealt.groupBy("s", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("words")).withColumn("grp", F.floor(F.col("bucket") / BUCKET_ROWS))
    sums = stage(sums, f"{folder}/buckets")
    groups = sums.groupBy("s", "grp").agg(F.sum("words").alias("words"))
    groups = groups.select("s", "grp", F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("grp").rowsBetween(*earlier)), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("words").over(Window.partitionBy("s", "grp").orderBy("bucket").rowsBetween(*earlier)), F.lit(0))
    base = sums.withColumn("near", near).join(groups, ["s", "grp"]).select("s", "bucket", (F.col("near") + F.col("far")).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("mark", "id", "h1", "h2").rowsBetween(*earlier)
    start = F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0))
    return dealt.withColumn("start", start).join(base, ["s", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("bucket", "base", "n")


def _copies(rows: DataFrame, repeats: int) -> DataFrame:
    """rows (with start, size, source_size, target) once for each copy: copy, at (the words of its
    source before it, over all passes), finish_time."""
    made = rows.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
    made = made.withColumn("at", F.col("start") + F.col("copy") * F.col("source_size"))
    return made.withColumn("finish_time", _finish(F.col("at") + F.col("size"), F.col("target")))


def _finish(words: Column, target: Column) -> Column:
    """Virtual finish time; 0 in a source without words."""
    return F.coalesce(F.try_divide(words.cast("double"), target), F.lit(0.0))


def _key(finish_time: Column, s: Column, at: Column) -> Column:
    """The place of a copy in the global order."""
    return F.struct(finish_time.alias("finish_time"), s.alias("s"), at.alias("at"))


def _cut(copies: DataFrame, budget: int, spread: int) -> tuple[float, str, int, int] | None:
    """Where the total budget ends in the global order of finish times: the (finish_time, s, at) of
    the copy in which it does, and how many of its words are still sent; None if it never ends.

    The copies are range-sorted; each range's words are summed, which gives the range where the
    budget ends, and only that range is summed row by row. A row for each range reaches the driver.
    """
    order = ("finish_time", "s", "at")
    key = _key(*map(F.col, order))
    worded = copies.where("size > 0").select(*order, "size")
    ranged = worded.repartitionByRange(spread, *order).withColumn("piece", F.spark_partition_id())
    ends = ranged.groupBy("piece").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("size").alias("words")).orderBy("piece")
    sent = 0
    for r in ends.collect():
        if sent + r["words"] > budget:
            low, high = (_key(*map(F.lit, k)) for k in (r["lo"], r["hi"]))
            piece = worded.where(F.col("finish_time").between(r["lo"][0], r["hi"][0]) & (key >= low) & (key <= high))
            total = piece.withColumn("end", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
            over = total.where(F.col("end") > budget - sent).orderBy("end").first()
            return over["finish_time"], over["s"], over["at"], budget - sent - (over["end"] - over["size"])
        sent += r["words"]
    return None


def _sent(end: tuple | None, finish_time: Column, s: Column, at: Column, size: Column) -> tuple[Column, Column]:
    """Whether a copy is sent whole, and how many of its words are sent, if _cut() gave `end`."""
    if end is None:
        return F.lit(True), size
    key, last = _key(finish_time, s, at), _key(*map(F.lit, end[:3]))
    whole = (key < last) | ((size == 0) & (key <= last))  # a copy without words goes as the one at its place does
    return whole, F.when(whole, size).when(key == last, F.lit(end[3])).otherwise(0)


def _scheduled(docs: DataFrame, weights: tuple[float, ...], budget: float, repeats: int, seed: str, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, tuple | None]:
    """A row for each row of docs: id, h1, h2, m (rows equal to it), source, s, size, source_size,
    target, start; and where the total budget ends."""
    spark = docs.sparkSession
    folder, spread = shared_dir(spark), partitions(spark)
    id_, text, source = (F.col(place(docs, c)) for c in (id_col, text_col, source_col))
    text = text.cast("string")
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    s = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # null is a source of its own
    rows = hashed(docs).select(id_.alias("id"), "h1", "h2", source.alias("source"), n_words(text).alias("size"), mark.alias("mark"))
    units = stage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")).withColumn("s", s), f"{folder}/units")
    targets = source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, budget, repeats)
    targets = stage(targets.withColumn("s", s), f"{folder}/targets")
    placed = stage(_positions(units, targets, folder, spread), f"{folder}/positions")
    every = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("start", F.col("start") + F.col("j") * F.col("size")).drop("j")
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    return every, _cut(_copies(every, repeats), int(min(budget, repeats) * words), spread)


def schedule(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row: id, source, size, source_size, target, start, finish_time (of the first
    copy), taken, copies.

    Each source's documents stand in an order shuffled by a hash of seed, id and text, the whole
    order `repeats` times over. Every copy is a row of its own with a virtual finish time: its
    source's words up to its end by the source's target. All copies are range-sorted by finish time
    and truncated at the total budget (`budget` times all words): those before it are sent whole,
    the one in which it ends in part. taken counts a document's words that are sent, of all its
    copies; copies those that are sent whole. A source misses its target by less than its document
    in service at virtual time 1; what such documents leave goes to the next ones in the order.

    Rows that are equal in all columns are placed as one run of copies, so neither they nor a source
    are ever one task's. Null texts have size 0; a null source is a source; null ids are ordered as
    empty ones; other columns may have any names; an empty table gives an empty one.
    """
    every, end = _scheduled(docs, weights, budget, repeats, seed, id_col, text_col, source_col)
    taken, copies = F.lit(0).cast("long"), F.lit(0)
    for k in range(repeats):
        at = F.col("start") + k * F.col("source_size")
        whole, sent = _sent(end, _finish(at + F.col("size"), F.col("target")), F.col("s"), at, F.col("size"))
        taken, copies = taken + sent, copies + whole.cast("int")
    first = _finish(F.col("start") + F.col("size"), F.col("target"))
    return every.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "start", first.alias("finish_time"), taken.alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The copies that schedule() sends whole, as rows with the columns of docs, range-sorted by
    their virtual finish times; the one copy in which the budget ends is left out.

    Of rows that are equal in all columns as many copies are sent as the queue sends of them
    together. Nulls, clashing names and empty tables are as in schedule()."""
    every, end = _scheduled(docs, weights, budget, repeats, seed, id_col, text_col, source_col)
    copies = _copies(every, repeats)
    whole, _ = _sent(end, F.col("finish_time"), F.col("s"), F.col("at"), F.col("size"))
    folder, spread = shared_dir(docs.sparkSession), partitions(docs.sparkSession)
    sent = stage(copies.where(whole).select("h1", "h2", "finish_time", "s", "at", "m"), f"{folder}/sent")
    own = hashed(docs)
    if not sent.where("m > 1").isEmpty():  # equal rows: one of them stands for all
        own = stage(own.repartition(spread, "h1", "h2").dropDuplicates(["h1", "h2"]), f"{folder}/rows")
    met = sent.drop("m").join(own, ["h1", "h2"])
    ordered = met.repartitionByRange(spread, "finish_time", "s", "at").sortWithinPartitions("finish_time", "s", "at")
    return named(ordered, docs)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank, CAST(source_size * 2 AS DOUBLE) AS stop FROM per),
cut AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
target AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(stop, weight * max(level) OVER ()) AS target FROM cut),
placed AS (
  SELECT row_number() OVER () AS r, doc_id, s, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source),
copies AS (
  SELECT *, start + k * source_size AS pos, CASE WHEN target = 0 THEN 0 ELSE CAST(start + k * source_size + size AS DOUBLE) / target END AS finish
  FROM placed, (VALUES (0), (1)) AS v(k)),
queue AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, s, pos, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent, floor(1.5::DOUBLE * (SELECT sum(size) FROM d)) AS budget FROM copies)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(sum(greatest(0, least(size, budget - sent))) AS BIGINT) AS taken
FROM queue GROUP BY r, doc_id, size, source_size, target
"""
