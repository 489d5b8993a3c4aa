"""Near-duplicates by similarity: SimHash in bit-sliced blocks with a wide radius, whole shingle sets decide.

Texts of a similarity of 0.8 differ in about ten of 64 SimHash bits, so no keys of a few bits bring them
together: MinHash bands do. Within a group of candidates fingerprints are compared as in simhash, bit
plane by bit plane, with a radius that similar texts don't reach, and the exact sets of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm import simhash
from sedgeflow.llm.common import bounded, hashed, partitions, place, shared_dir, stage
from sedgeflow.llm.components import components

#: Words of a shingle, and the least Jaccard similarity, 4 / 5, of near-duplicates.
SHINGLE, SIMILARITY = 5, (4, 5)
SEED = 42
#: A pair at exactly 0.8 shares no band of 6 minima with a chance of (1 - 0.8^6)^64 = 4e-9.
BANDS, MINIMA = 64, 6
#: Differing bits up to which two texts are compared by their sets. Similar ones differ in a bit with a
#: chance of 0.15 (up to 0.2 if they are short): over 26 of 64 are met once in 100,000 pairs or less.
RADIUS = 26
#: Shingles whose occurrences are looked up at once.
LOOKED_UP = 250_000
#: Shingles of a group that one task holds; a group of more is dealt out in pairs of parts.
GROUP_SHINGLES = 2_000_000

_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 32, BANDS * MINIMA, np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * MINIMA, np.uint32)
_MIX = _rng.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending. A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    parts = [words[i:] for i in range(min(shingle, len(words)))] or [[b""]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*parts, strict=False)), np.uint64, len(parts[-1])))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: equal where all of the band's minima are."""
    least = np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    low = found.astype(np.uint32)
    for lo in range(0, len(low), 512):
        np.minimum(least, (low[lo : lo + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least.reshape(BANDS, MINIMA).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of their hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(found), 16384):
        counts += np.unpackbits(found[lo : lo + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(found)).tolist())


def _sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (of the text), h1, h2 (of the row), n (shingles), bands of each row that has an id."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], np.empty((batch.num_rows, BANDS), np.uint64)
            for k, text in enumerate(batch.column(4)):
                found = shingles(text.as_py())
                n.append(len(found))
                keys[k] = bands(found)
            held = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), held], names=["id", "h", "h1", "h2", "n", "bands"])

    rows = _texts(df, id_col, text_col)
    return rows.mapInArrow(run, "id long, h binary, h1 long, h2 long, n long, bands array<long>")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, h1, h2, text of each row that has an id."""
    id_, text = F.col(place(df, id_col)).cast("long"), F.col(place(df, text_col)).cast("string")
    return hashed(df).where(id_.isNotNull()).select(id_.alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("h"), "h1", "h2", text.alias("text"))


def forest(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(i, j) of a spanning forest of the similar pairs of ascending arrays: simhash.forest over their
    fingerprints; of those within RADIUS the common elements are counted, all at once."""
    num, den = SIMILARITY
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)

    def confirm(i: int, js: np.ndarray) -> np.ndarray:
        out = np.zeros(len(js), bool)
        # Sets of too unlike sizes can't be similar.
        left = np.flatnonzero(np.minimum(sizes[js], sizes[i]) * den >= np.maximum(sizes[js], sizes[i]) * num)
        while len(left):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[js[left]]), LOOKED_UP)))
            own, left = left[:n], left[n:]
            lens = sizes[js[own]]
            last = np.cumsum(lens)
            held = every[np.repeat(ends[js[own]] - last, lens) + np.arange(last[-1])]
            at = np.minimum(np.searchsorted(sets[i], held), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][at] == held).astype(np.int64), last - lens)
            out[own] = common * (num + den) >= num * (sizes[i] + lens)
        return out

    yield from simhash.forest(np.fromiter(map(fingerprint, sets), np.uint64, len(sets)), RADIUS, confirm=confirm)


def _verified(dealt: DataFrame) -> DataFrame:
    """a, b: similar nodes of rows (grp, part, node, text) that lie together and ascend by all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            pairs = [(nodes[i], nodes[j]) for i, j in forest(sets)]
            nodes.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for group, part, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if now != (group, part):
                    if nodes:
                        yield out()
                    now = (group, part)
                if not nodes or nodes[-1] != node:  # rows may repeat both id and text
                    nodes.append(node)
                    sets.append(shingles(text.as_py()))
        if nodes:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """df, with its columns, with one row of each group of near-duplicates: that of the smallest id,
    of texts that repeat it, of the least hash, of rows that repeat both, of the least hash of all
    columns. Near-duplicates are texts whose sets of 5-word shingles have a Jaccard similarity of 0.8
    or more, and all that are reached over such pairs.

    Equal texts are one node before anything is compared. Nodes that share a band are candidates;
    those that reach each other over bands meet in one group, where fingerprints and then the whole
    sets are compared. A group with more than group_shingles is dealt into parts and each pair of
    parts meets in a task of its own, so every pair is still compared; a spanning forest of the
    similar pairs is returned, never all pairs. Texts without words, null ones too, are equal to
    each other. Rows without an id stay; other columns may have any names; an empty table gives an
    empty one.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    rows = stage(_sketches(df, id_col, text_col).withColumn("node", F.monotonically_increasing_id()), f"{folder}/sketches")
    least = F.min(F.struct("id", "h1", "h2", "node", "n")).alias("s")
    nodes = stage(rows.groupBy("h").agg(least).select("h", "s.*"), f"{folder}/nodes")
    keyed = rows.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), f"{folder}/shared")
    met = stage(keyed.join(shared, "key").where("node != least").select("node", "least").distinct(), f"{folder}/met")
    near = components(met, f"{folder}/groups")
    near = stage(near.union(near.select("component", "component").distinct()).toDF("node", "grp"), f"{folder}/members")

    sizes = stage(near.join(nodes, "node").groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(group_shingles / 2)).cast("int").alias("parts")), f"{folder}/sizes")
    parts = F.when(F.col("parts") <= 2, F.lit(1)).otherwise(F.col("parts"))
    # A node's text is that of the row with its hashes.
    own = near.join(sizes.select("grp", parts.alias("parts")), "grp").join(nodes.select("node", "id", "h1", "h2"), "node").toDF("node", "grp", "parts", "i", "r1", "r2")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.least(t, part) * F.col("parts") + F.greatest(t, part))
    same = (F.col("id") == F.col("i")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))
    held = _texts(df, id_col, text_col).join(own, same).select("grp", F.explode(pairs).alias("part"), "node", "text")
    dealt = held.repartition(partitions(spark), "grp", "part").sortWithinPartitions("grp", "part", "node")
    similar = components(stage(_verified(dealt), f"{folder}/similar"), f"{folder}/components")

    first = nodes.join(similar, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min(F.struct("id", "h", "h1", "h2")).alias("s"))
    first = stage(first.select("s.h1", "s.h2"), f"{folder}/first")
    return simhash.first_rows(df, first, id_col, rows)
