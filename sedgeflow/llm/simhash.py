"""SimHash near-duplicates: fingerprints compared in bit-sliced blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm.common import bounded, hashed, named, numbered, partitions, pick, place, shared_dir, stage
from sedgeflow.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints whose bit planes stand together in one block.
BLOCK = 2048
#: Fingerprints of a key that one task compares; a key of more is dealt out in pairs of parts.
KEY_ROWS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    parts = [words[i:] for i in range(min(shingle, len(words)))]
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*parts, strict=False)), np.dtype("<u8"), len(parts[-1]))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(found), 16384):
        bits = np.unpackbits(found[lo : lo + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(found)).tolist())


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed 64-bit) of each row; null and empty texts have 0."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "fp"])

    return pick(df, **{id_col: "long", text_col: "string"}).mapInArrow(run, "id long, fp long")


class Block:
    """Up to some thousand fingerprints as 64 bit planes: plane k has bit k of all of them.

    near() compares one fingerprint with all at once: the planes in which they differ are added to
    carry-save counters of one bit each (ones, twos), so each plane costs a few operations on whole
    planes; what overflows past the radius leaves the set, and when none is left the block is
    abandoned, for unrelated fingerprints after a few planes."""

    def __init__(self, values: np.ndarray, radius: int):
        self.n, self.radius = len(values), radius
        self.all = (1 << self.n) - 1
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.packbits(bits.T.copy(), axis=1, bitorder="little")
        self.planes = [int.from_bytes(row.tobytes(), "little") for row in packed]

    def near(self, value: int, alive: int) -> int:
        """Which of those in `alive` are within the radius, as a bit set."""
        levels = [0] * self.radius.bit_length()
        limit = self.radius + 1
        exact = limit & (limit - 1) == 0
        full = self.all
        for k, plane in enumerate(self.planes):
            carry = (full ^ plane if value >> k & 1 else plane) & alive
            for i, level in enumerate(levels):
                if not carry:
                    break
                levels[i], carry = level ^ carry, level & carry
            over = carry if exact else carry | self._above(levels, full)
            if over:
                alive &= ~over
                if not alive:
                    return 0
        return alive

    def _above(self, levels: list[int], full: int) -> int:
        """Where the counters exceed a radius that is not one less than a power of two."""
        greater, equal = 0, full
        for i in range(len(levels) - 1, -1, -1):
            if self.radius >> i & 1:
                equal &= levels[i]
            else:
                greater |= equal & levels[i]
                equal &= ~levels[i]
        return greater


def forest(values: np.ndarray, radius: int = RADIUS, block: int = BLOCK, confirm: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """(i, j) of a spanning forest of the links among fingerprints: a search from each unreached one,
    every step against the blocks of those not reached yet. The blocks are packed anew when half of
    their places are reached, so a tight group costs little more than its size.

    confirm(i, js) says which of those within the radius are linked; by default all are."""
    values = np.ascontiguousarray(values, dtype="<u8")
    reached = np.zeros(len(values), bool)
    numbers = values.tolist()

    def packed() -> list[list]:
        left = np.flatnonzero(~reached)
        cuts = [left[i : i + block] for i in range(0, len(left), block)]
        return [[own, b := Block(values[own], radius), b.all] for own in cuts]

    blocks, held, left = packed(), len(values), len(values)
    for root in range(len(values)):
        if reached[root]:
            continue
        todo = [root]
        reached[root] = True
        left -= 1
        while todo and left:
            at = todo.pop()
            if left < held // 2:
                blocks, held = packed(), left
            for entry in blocks:
                own, planes, alive = entry
                if not alive or not (met := planes.near(numbers[at], alive)):
                    continue
                places = np.flatnonzero(np.unpackbits(np.frombuffer(met.to_bytes((planes.n + 7) // 8, "little"), np.uint8), bitorder="little"))
                gone = reached[own[places]]
                new = places[~gone]
                if confirm is not None and len(new):
                    linked = confirm(at, own[new])
                    met = _bits(np.concatenate([places[gone], new[linked]]), planes.n)
                    new = new[linked]
                entry[2] = alive & ~met
                for j in own[new].tolist():
                    reached[j] = True
                    left -= 1
                    todo.append(j)
                    yield at, j


def _bits(places: np.ndarray, n: int) -> int:
    """A bit set of some of n places."""
    flags = np.zeros(n, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of rows with equal first columns (all but the last two), from sorted batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [np.asarray(c) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        keys = held[:columns]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
            yield tuple(c[lo:hi] for c in held)
        if len(cuts):
            held = [c[cuts[-1] :] for c in held]
    if held is not None and len(held[0]):
        yield tuple(held)


def _keys(fp: Column, radius: int) -> Column:
    """Two fingerprints within the radius agree in one of radius + 1 parts of their bits, and in one
    of radius + 1 parts of the rest: (radius + 1)^2 keys of about 28 bits (for 3), one of which they
    share."""
    parts = radius + 1

    def cuts(bits: list[int]) -> list[list[int]]:
        return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]

    made = []
    for own in cuts(list(range(64))):
        for rest in cuts([b for b in range(64) if b not in own]):
            mask = sum(1 << b for b in own + rest)
            signed = mask - (1 << 64) if mask >> 63 else mask
            made.append(F.struct(F.lit(len(made)).cast("long").alias("k"), fp.bitwiseAND(F.lit(signed)).alias("v")))
    return F.array(*made)


def links(nodes: DataFrame, radius: int = RADIUS, key_rows: int = KEY_ROWS, folder: str | None = None) -> DataFrame:
    """a, b: links of distinct fingerprints (columns fp, node) that join all that reach each other.

    The rows of a key are compared in one task, unless they are more than key_rows: then they are
    dealt into parts and each pair of parts meets in a task of its own, so every link is still met.
    Of all links in a key a spanning forest is returned, never all pairs.
    """
    spark = nodes.sparkSession
    keyed = nodes.select("fp", "node", F.explode(_keys(F.col("fp"), radius)).alias("x")).select(F.col("x.k").alias("k"), F.col("x.v").alias("v"), "fp", "node")
    counts = stage(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{folder or shared_dir(spark)}/keys")
    sized = keyed.join(counts, ["k", "v"])  # plain sides: adaptive execution can split a hot key
    parts = F.ceil(F.col("n") / F.lit(key_rows / 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.when(F.col("n") <= key_rows, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda t: F.least(t, own) * parts + F.greatest(t, own)))
    dealt = sized.select("k", "v", F.explode(pairs).alias("p"), "fp", "node").repartition(partitions(spark), "k", "v", "p").sortWithinPartitions("k", "v", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a.clear()
            b.clear()
            return made

        for _, _, _, fp, node in _groups(batches, 3):
            for i, j in forest(fp.view(np.uint64), radius):
                a.append(int(node[i]))
                b.append(int(node[j]))
            if len(a) >= 65536:
                yield out()
        if a:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, fp (signed), component_id: the smallest id that is reachable over
    links of fingerprints that differ in at most `radius` bits.

    Equal fingerprints are one node, named by its smallest id, before anything is compared. Null and
    empty texts have fingerprint 0, which links like any other. Rows without an id get no component
    of their own: they take that of their fingerprint, null if no row there has an id. Repeated rows
    give a row each; other columns are ignored; an empty table gives an empty one.
    """
    folder = shared_dir(df.sparkSession)
    fps = stage(fingerprints(df, shingle, id_col, text_col), f"{folder}/fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("id").alias("node")).where("node IS NOT NULL"), f"{folder}/nodes")
    parts = components(links(nodes, radius, folder=folder), folder)
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """df, with its columns, with one row of each component: that of the smallest id, of texts that
    repeat it, that of the least fingerprint and then of the least hash, of rows that repeat id and
    text, that of the least hash of all columns. Rows without an id stay; null and empty texts are
    equal to each other; other columns may have any names; an empty table gives an empty one.

    Nodes are numbered by themselves, so unlike texts under one id are components of their own.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    id_, text = F.col(place(df, id_col)).cast("long"), F.col(place(df, text_col)).cast("string")
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(4)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made.view(np.int64))], names=["id", "h", "h1", "h2", "fp"])

    rows = hashed(df).where(id_.isNotNull()).select(id_.alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("h"), "h1", "h2", text.alias("text"))
    fps = stage(rows.mapInArrow(run, "id long, h string, h1 long, h2 long, fp long"), f"{folder}/fingerprints")
    best = F.min(F.struct("id", "fp", "h", "h1", "h2")).alias("s")
    nodes = stage(fps.groupBy("fp").agg(best).withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    parts = components(links(nodes, radius, folder=folder), folder)
    first = nodes.join(parts, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("s").alias("s"))
    return first_rows(df, stage(first.select("s.h1", "s.h2"), f"{folder}/first"), id_col, fps)


def first_rows(df: DataFrame, first: DataFrame, id_col: str, all_rows: DataFrame) -> DataFrame:
    """The rows of df that first (h1, h2; see hashed) names, each once, and those without an id.

    all_rows has h1, h2 of every row with an id. Only if rows are equal in all columns are the rows
    aggregated; else the join is all, which shuffles no text where first is small enough to be
    broadcast by its written size."""
    id_ = F.col(place(df, id_col)).cast("long")
    kept = hashed(df).where(id_.isNotNull()).join(first.toDF("r1", "r2"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left_semi")
    if not all_rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["h1", "h2"])
    return named(kept, df).union(named(numbered(df).where(id_.isNull()), df))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
