"""Token ids in binary files: independent zstandard frames with a trailing seek table.

A file holds, in this order:

- one zstandard frame for each document: its ids as unsigned 32-bit little-endian integers;
- a skippable frame (0x184D2A5D) with the documents' ids: a count as unsigned 64-bit integer, then
  for each a byte (0: null) and the id as signed 64-bit integer;
- a skippable frame (0x184D2A5E) with the seek table of zstandard's seekable format: for each of
  the frames before it the compressed size, the decompressed size (0 for the skippable one) and
  the lowest 32 bits of XXH64 of the decompressed bytes, then the number of frames, a descriptor
  byte (0x80: there are checksums) and 0x8F92EAB1.

Any zstandard tool decompresses the whole; a reader of one document reads the two tables from the
end of the file and that document's frame, no other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeflow.llm import bpe
from sedgeflow.llm.common import Store, bounded, partitions, pick, qualified, shared_dir, stage
from sedgeflow.llm.token_counts import balanced, sizes

# Fixed values of the zstandard formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
LEVEL = 3

_ID = struct.Struct("<Bq")
_ENTRY = struct.Struct("<III")


class Writer:
    """Chunks of one file; what it holds in memory is its tables (25 bytes a document)."""

    def __init__(self) -> None:
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.index, self.seek = bytearray(), bytearray()
        self.count = self.tokens = 0

    def document(self, doc_id: int | None, ids: bytes) -> bytes:
        frame = self.compressor.compress(ids)
        self.seek += _ENTRY.pack(len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.index += _ID.pack(doc_id is not None, doc_id or 0)
        self.count += 1
        self.tokens += len(ids) // 4
        return frame

    def tables(self) -> bytes:
        index = struct.pack("<Q", self.count) + self.index
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = bytes(self.seek) + _ENTRY.pack(len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        footer = struct.pack("<IBI", self.count + 1, CHECKSUMS, SEEKABLE)
        return index + struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file) -> None:
        self.file = file
        self.decompressor = zstandard.ZstdDecompressor()
        end = file.seek(0, 2)
        file.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        file.seek(end - 9 - 12 * frames)
        entries = list(_ENTRY.iter_unpack(file.read(12 * frames)))
        self.frames: list[tuple[int, int, int, int]] = []
        at = 0
        for packed, size, check in entries:
            self.frames.append((at, packed, size, check))
            at += packed
        place, packed, _, _ = self.frames.pop()
        file.seek(place + 8)
        table = file.read(packed - 8)
        self.doc_ids = [x if held else None for held, x in _ID.iter_unpack(table[8:])]

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document, checked."""
        at, packed, size, check = self.frames[k]
        self.file.seek(at)
        data = self.decompressor.decompress(self.file.read(packed), max_output_size=max(size, 1))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def find(self, doc_id: int | None) -> Iterator[bytes]:
        """The ids of each document of that id; only their frames are read."""
        return (self.ids(k) for k, x in enumerate(self.doc_ids) if x == doc_id)


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", order: str = "id") -> DataFrame:
    """Writes folder/part-NNNNN.tokens.zst, in ascending order of ids over all files (null first),
    and returns the written list of files: file, part, n_docs, n_tokens.

    The rows are range-partitioned by id and by how the text starts, so a task holds no more than its
    range and rows without an id are many tasks'; rows of one id stand in order of their texts. With
    order "given" the rows are written as they lie, partition after partition: a mix that was
    range-sorted stays in its order, and nothing is shuffled. end_id, if any, is appended to each
    document. Null texts count as empty; repeated rows are written each; ids are cast to long. A
    file appears whole or not at all, under a name that a retried task uses again. An empty table
    writes no file. Other columns are ignored, whatever their names.
    """
    if order not in ("id", "given"):
        raise ValueError("order is id or given")
    spark = df.sparkSession
    bounded(spark)
    folder = qualified(spark, folder)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = bpe.encoder(tokenizer)
        writer, part = Writer(), TaskContext.get().partitionId()
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def frames() -> Iterable[bytes]:
            batch = first
            while batch is not None:
                for group in balanced(sizes(batch.column(1)).to_pylist()):
                    for i, ids in zip(batch.column(0)[group].to_pylist(), enc.encode(batch.column(1)[group].to_pylist()), strict=True):
                        yield writer.document(i, ids + end)
                batch = next(batches, None)
            yield writer.tables()

        name = f"part-{part:05d}.tokens.zst"
        Store(folder).write(name, frames())
        yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [writer.count], "n_tokens": [writer.tokens]})

    held = pick(df, **{id_col: "long", text_col: "string"}).toDF("id", "text")
    if order == "id":
        held = held.repartitionByRange(partitions(spark), F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    return stage(held.mapInArrow(run, "file string, part long, n_docs long, n_tokens long"), f"{folder}/files")


def read(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document of the files that write() listed, from their bytes alone: id,
    start (ids of all documents before it), n_tokens, ids_crc32 (of the ids' bytes), file, frame.

    Each task reads whole files, frame by frame; the only thing that is gathered is a row for each
    file, whose running total gives the files' starts.
    """
    folder = qualified(files.sparkSession, folder)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("file", before.alias("base")).repartition(partitions(files.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Store(folder).open(name) as f:
                    reader, start = Reader(f), base
                    for lo in range(0, len(reader.doc_ids), 4096):
                        out: dict[str, list] = {id_col: [], "start": [], "n_tokens": [], "ids_crc32": [], "file": [], "frame": []}
                        for k in range(lo, min(lo + 4096, len(reader.doc_ids))):
                            ids = reader.ids(k)
                            for c, v in zip(out, (reader.doc_ids[k], start, len(ids) // 4, zlib.crc32(ids), name, k), strict=True):
                                out[c].append(v)
                            start += len(ids) // 4
                        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return listed.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, file string, frame long")


def round_trip(df: DataFrame, tokenizer: str, folder: str | None = None, order: str = "id") -> DataFrame:
    """Writes the files to a folder (by default a fresh one below spark.checkpoint.dir) and reads
    every document back; rows, nulls, repeats and empty tables as in write()."""
    folder = folder or shared_dir(df.sparkSession)
    return read(write(df, folder, tokenizer, order=order), folder)
