"""Benchmark decontamination: documents that hold word windows of test items. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm.common import lower_ascii, named, numbered, pick, place, shared_dir, split_words, stage

#: What stands between words: all of ASCII but digits and letters. Words of lower-cased text are runs of the rest.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word in text that keeps its case.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bits of a window's hash that a broadcast filter holds: at most 2^FILTER_BITS rows, whatever the benchmark.
FILTER_BITS = 20


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(text), OTHER)


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct window of the items: gram (its words), m (how many), h (their hash),
    items (the ids that hold it). An item of fewer words than a window is one window; one without
    words, or without an id, has none."""
    w = pick(benchmark, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), item_words(F.col(text_col)).alias("w"))
    m = F.least(F.size("w"), F.lit(window))
    each = w.where(F.size("w") > 0).withColumn("m", m).select("item", "m", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    grams = each.select("item", "m", F.slice("w", F.col("at"), F.col("m")).alias("gram"))
    return grams.groupBy("gram", "m").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("gram"))


def _low(h: Column, part: int) -> Column:
    return F.shiftright(h, FILTER_BITS * part).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def scan(docs: DataFrame, grams: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """A written table of id, key (hash of the text), at, m, h, words, n_words: for each document one
    row with at 0 and its number of words, and one for each window that may be an item's.

    Texts are read and cut into words once. Each window's hash is looked up by two times FILTER_BITS of
    its bits in broadcast sets of the items' bits, which are bounded by their type and not by the
    benchmark; only windows that pass both are written. What passes by chance is sorted out by hits().
    """
    lengths = sorted(r["m"] for r in grams.select("m").distinct().collect())  # at most `window` of them
    texts = pick(docs, id_col, **{text_col: "string"}).toDF("id", "text")
    # The generator keeps the words from being cut anew by each expression that reads them.
    cut = texts.select("id", F.xxhash64("text").alias("key"), F.explode(F.array(item_words(F.col("text")))).alias("w"))
    each = cut.select("id", "key", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    several = F.explode(F.when(F.col("at") > 0, F.array(*map(F.lit, lengths))).otherwise(F.array(F.lit(0)))) if len(lengths) > 1 else F.when(F.col("at") > 0, *map(F.lit, lengths or [1])).otherwise(0)
    each = each.withColumn("m", several).where((F.col("at") == 0) | (F.col("at") + F.col("m") <= F.size("w") + 1))
    each = each.withColumn("h", F.when(F.col("at") > 0, F.xxhash64(F.slice("w", F.greatest("at", F.lit(1)), F.col("m")))))
    for part in (0, 1):
        held = grams.select(_low(F.col("h"), part).alias(f"b{part}")).distinct().withColumn(f"in{part}", F.lit(True))
        each = each.withColumn(f"b{part}", _low(F.col("h"), part)).join(F.broadcast(held), f"b{part}", "left").where((F.col("at") == 0) | F.col(f"in{part}"))
    made = each.select("id", "key", "at", "m", "h", F.when(F.col("at") > 0, F.slice("w", F.greatest("at", F.lit(1)), F.col("m"))).alias("words"), F.when(F.col("at") == 0, F.size("w")).cast("long").alias("n_words"))
    return stage(made, f"{folder}/windows")


def hits(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """id, key, spans (distinct first words, from 1, and lengths, in order), items (distinct ids) of
    each document with a hit: scan()'s windows that are an item's word by word. Spark broadcasts the
    items' windows if their written size allows, else the few windows are shuffled to them."""
    met = windows.where("at > 0").select("id", "key", "at", "m", "h", "words").join(grams.select("h", "gram", "items"), "h").where(F.col("words") == F.col("gram"))
    return met.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("at", "m"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """scan()'s rows of the documents themselves, and hits(), both written."""
    folder = shared_dir(docs.sparkSession)
    grams = stage(item_windows(benchmark, window, item_col, item_text_col), f"{folder}/grams")
    windows = scan(docs, grams, folder, id_col, text_col)
    return windows.where("at = 0").select("id", "key", "n_words"), stage(hits(windows, grams), f"{folder}/hits")


def covered(spans: Column) -> Column:
    """Number of words in any of the spans, which are in order of their first words."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        last = x["at"] + x["m"] - 1
        new = F.greatest(last - F.greatest(x["at"] - 1, acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], last).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, zero, add)["n"].cast("long")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256 (of the ids, sorted as strings, joined by commas), contaminated.

    Null and empty texts have no words and no hit. Rows are told apart by id and text, so rows that
    repeat both get the same values, each in a row of its own; a null id is kept. Other columns are
    ignored, whatever their names. An empty benchmark hits nothing; an empty table gives an empty one.
    """
    base, found = _found(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    found = found.withColumnsRenamed({"id": "i", "key": "k"})
    both = base.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    names = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, with its columns, without what the benchmark hits: whole documents, or (remove="spans")
    the hit words and what stands between them.

    Documents with hits are found as by report() and written; Spark broadcasts them to the texts if
    their written size allows, so that no text is shuffled. Null and empty texts stay, as do rows
    without an id unless their text is hit; repeated rows stay or go together; other columns may
    have any names; an empty benchmark removes nothing; an empty table gives an empty one."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = _found(docs, benchmark, window, id_col, text_col, item_col, item_text_col)[1]
    held = numbered(docs)
    id_, text = (F.col(place(docs, c)) for c in (id_col, text_col))
    same = id_.eqNullSafe(F.col("id")) & (F.xxhash64(text.cast("string")) == F.col("key"))
    if remove == "documents":
        return named(held.join(found.select("id", "key"), same, "left_anti"), docs)
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["m"] - 1)))
    # Pieces in turn: what stands before the first word (perhaps nothing), a word, what follows it, ...
    words = F.regexp_extract_all(text, F.lit(f"({CASED_WORD})"), F.lit(1))
    gaps = F.split(text, CASED_WORD)
    at = F.sequence(F.lit(1), F.size(words))
    hit = F.array_distinct(inside)
    kept = F.transform(
        at,
        lambda i: F.concat(
            F.when(F.array_contains(hit, i), F.lit("")).otherwise(F.element_at(words, i)),
            F.when(F.array_contains(hit, i) & F.array_contains(hit, i + 1), F.lit("")).otherwise(F.element_at(gaps, i + 1)),
        ),
    )
    cleaned = F.concat(F.element_at(gaps, F.lit(1)), F.array_join(kept, ""))
    return named(held.join(found, same, "left").withColumn(place(docs, text_col), F.when(F.col("spans").isNull(), text).otherwise(cleaned)), docs)


SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
gram AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
scan AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM doc), (SELECT DISTINCT m FROM gram)
  WHERE i + m - 1 <= len(w)),
hit AS (SELECT doc_id, s.m, i, item_id FROM scan s JOIN gram USING (g) WHERE gram.m = s.m),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
