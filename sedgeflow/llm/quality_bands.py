"""Quality rules: base counts, and bands of zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm.common import bounded, numbered, pick, place, shared_dir, stage

#: A length class for each: (bytes from which it holds, least ratio, greatest ratio) at zstandard level 3.
Bands = tuple[tuple[int, float, float], ...]
#: Bands of classes of which too few labelled texts are known, wide enough for any prose.
#: A short text carries the frame's own bytes and has little to repeat, so its band is wider.
BANDS: Bands = ((0, 0.40, 2.00), (128, 0.34, 1.10), (256, 0.30, 0.92), (512, 0.28, 0.82), (1024, 0.26, 0.74), (2048, 0.24, 0.70), (8192, 0.20, 0.68))
#: Bytes of a chunk; a last one of less than half joins the one before it.
CHUNK = 4096
#: Greatest share of a document's bytes in chunks outside their band.
BAD_SHARE = 0.25
LEVEL = 3
#: Least texts of a class, share of good texts left out at each end, and the room beyond them.
LEAST_TEXTS, TAIL, ROOM = 50, 0.002, 0.03
#: Bins of ratios, to a unit of ratio, in which ranks are looked for.
BINS = 4096

_SYMBOLS = "#*$%&|<>"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_share double, kept boolean"


def repeated(ids: np.ndarray, window: int) -> int:
    """Words in windows that occur twice or more, the first included. Windows get exact class
    numbers by pairing: of 2 words, of 4, of 8 (and what is left over)."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    have, size = ids.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        have = have[: len(have) - step] * (int(have.max()) + 1) + have[step:]
        have = np.unique(have, return_inverse=True)[1].astype(np.int64)
        size += step
    twice = np.bincount(have)[have] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[: n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def band(n: int, bands: Bands = BANDS) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if n >= least)


def chunks(data: bytes, size: int = CHUNK) -> list[bytes]:
    cuts = list(range(0, len(data), size))
    if len(cuts) > 1 and len(data) - cuts[-1] < size // 2:
        cuts.pop()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def ratios(data: bytes, compressor: zstandard.ZstdCompressor, bands: Bands = BANDS) -> tuple[float, float]:
    """The whole text's ratio, and the share of its bytes in chunks outside their band."""
    whole = len(compressor.compress(data)) / len(data)
    if len(data) < CHUNK + CHUNK // 2:
        low, high = band(len(data), bands)
        return whole, float(not low <= whole <= high)
    bad = 0
    for c in chunks(data):
        low, high = band(len(c), bands)
        bad += len(c) * (not low <= len(compressor.compress(c)) / len(c) <= high)
    return whole, bad / len(data)


def base(data: bytes) -> tuple[int, int, bool]:
    """n_words, n_repeat_words, base_failed."""
    found = data.split()  # bytes split at ASCII white space only
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    n_repeat = repeated(ids, 8)
    return len(found), n_repeat, len(found) < 20 or 100 * n_repeat > 30 * len(found)


def judge(text: str | None, compressor: zstandard.ZstdCompressor, bands: Bands = BANDS) -> tuple:
    """The values of COUNTS for one text."""
    text = text or ""
    data = text.encode()
    n_words, n_repeat, failed = base(data)
    ratio, bad = ratios(data, compressor, bands) if data else (None, 0.0)
    kept = not failed
    if kept:
        low, high = band(len(data), bands)
        kept = low <= ratio <= high and bad <= BAD_SHARE
    return (
        n_words,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        duplicate_lines(text),
        n_repeat,
        failed,
        ratio,
        bad,
        kept,
    )


def learn(docs: DataFrame, labels: DataFrame) -> Bands:
    """BANDS, fitted to all labelled texts of quality 1 outside the held-out fold (crc32 of the id's text
    mod 5 is 0): for each length class of LEAST_TEXTS such texts or more, all but a share TAIL of
    their ratios at either end lie inside, and ROOM is left beyond that. Equal texts stand once, with
    their greatest label, as do ids that are labelled twice. Texts that the base rules reject, null and
    empty ones don't count; without labels the bands are BANDS.

    Every text outside the fold is measured where it lies, and its measures meet the labels: no text is
    shuffled."""
    spark = docs.sparkSession
    bounded(spark)
    fold = "doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            made = [(i, len(d), len(compressor.compress(d)) / len(d), hashlib.md5(d).digest()) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not base(d)[2]]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n", "ratio", "h"])

    texts = pick(docs, doc_id="long", text="binary").where(fold).where("length(text) > 0")
    measured = texts.mapInArrow(run, "doc_id long, n long, ratio double, h binary")
    ids = pick(labels, doc_id="long", quality="int").toDF("doc_id", "label").where(fold).where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    once = measured.join(ids, "doc_id").groupBy("h").agg(F.first("n").alias("n"), F.first("ratio").alias("ratio"), F.max("label").alias("label"))
    return fitted(stage(once.where("label = 1").select("n", "ratio"), f"{shared_dir(spark)}/good"))


def fitted(seen: DataFrame) -> Bands:
    """Bands of good texts' n (bytes) and ratio, by numpy's linear quantiles of all of them. Counts by bin say
    which bins hold the ranks; only the values of those reach the driver."""
    of = F.lit(0)
    for k, (least, _, _) in enumerate(BANDS):
        of = F.when(F.col("n") >= least, k).otherwise(of)
    held = seen.select(of.alias("k"), "ratio", F.floor(F.col("ratio") * BINS).alias("bin"))
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in held.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("c")).collect():
        bins.setdefault(r["k"], []).append((r["bin"], r["c"]))
    sizes = {k: sum(c for _, c in x) for k, x in bins.items()}
    wanted: dict[tuple[int, int], tuple[int, int]] = {}  # (class, rank): bin, ranks before it
    for k, n in sizes.items():
        if n < LEAST_TEXTS:
            continue
        for q in (TAIL, 1 - TAIL):
            low, _ = divmod(q * (n - 1), 1)
            for rank in (int(low), min(int(low) + 1, n - 1)):
                before = 0
                for b, c in sorted(bins[k]):
                    if rank < before + c:
                        wanted[k, rank] = (b, before)
                        break
                    before += c
    values: dict[tuple[int, int], list[tuple[float, int]]] = {}
    if wanted:
        some = seen.sparkSession.createDataFrame(sorted({(k, b) for (k, _), (b, _) in wanted.items()}), "k int, bin long")
        for r in held.join(F.broadcast(some), ["k", "bin"]).groupBy("k", "bin", "ratio").agg(F.count(F.lit(1)).alias("c")).collect():
            values.setdefault((r["k"], r["bin"]), []).append((r["ratio"], r["c"]))

    def at(k: int, rank: int) -> float:
        b, before = wanted[k, rank]
        for v, c in sorted(values[k, b]):
            before += c
            if rank < before:
                return v
        raise AssertionError("the counts don't agree")

    def quantile(k: int, q: float) -> float:
        low, part = divmod(q * (sizes[k] - 1), 1)
        a, b = at(k, int(low)), at(k, min(int(low) + 1, sizes[k] - 1))
        return a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)

    return tuple((least, quantile(k, TAIL) * (1 - ROOM), quantile(k, 1 - TAIL) * (1 + ROOM)) if sizes.get(k, 0) >= LEAST_TEXTS else (least, low, high) for k, (least, low, high) in enumerate(BANDS))


def quality(df: DataFrame, bands: Bands = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id and COUNTS.

    kept is false if base_failed (fewer than 20 words, or over 30 % of them in 8-word windows that
    occur twice or more), if the whole text's ratio of compressed to raw bytes is outside the band
    for its length (below: repetitive; above: incompressible), or if over BAD_SHARE of its bytes
    lie in chunks outside their band. Long documents are so judged by parts too: one repeated or
    random part among prose counts by its size.

    Null and empty texts have no words, a null ratio and kept false. Repeated rows give a row each;
    a null id is kept; other columns are ignored, whatever their names; an empty table gives an
    empty one.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = [id_col, *(c.split()[0] for c in COUNTS.split(", "))]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            made = [judge(t.as_py(), compressor, bands) for t in batch.column(1)]
            cols = list(zip(*made, strict=True)) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=names)

    held = pick(df, id_col, **{text_col: "string"})
    kind = held.schema[id_col].dataType.simpleString()
    return held.mapInArrow(run, f"`{id_col}` {kind}, {COUNTS}")


def keep(df: DataFrame, bands: Bands = BANDS, text_col: str = "text") -> DataFrame:
    """The rows of df, with its columns, that quality() keeps. The verdict rides with its row: nothing
    is joined. Null and empty texts go; rows without an id and repeated rows stay or go by their
    text; other columns may have any names; an empty table gives an empty one."""
    bounded(df.sparkSession)
    held = numbered(df)
    at = int(place(df, text_col)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), compressor, bands)[-1] for t in batch.column(at)], pa.bool_()))

    return held.mapInArrow(run, held.schema).toDF(*df.columns)
