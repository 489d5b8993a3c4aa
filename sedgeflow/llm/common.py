"""What the corpus operators share: input columns, shared folders, files, chunks of Arrow."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

#: Most bytes of text that one Arrow batch carries to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **typed: str) -> DataFrame:
    """The first column of each exact name (else the first that differs in case only), cast if a
    type is given. Other columns, with whatever names, can't clash with what an operator adds."""
    wanted = {**{n: None for n in names}, **typed}
    held = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    lower = [c.lower() for c in df.columns]
    out = []
    for name, kind in wanted.items():
        at = df.columns.index(name) if name in df.columns else lower.index(name.lower())
        col = F.col(f"_{at}")
        out.append((col.cast(kind) if kind else col).alias(name))
    return held.select(*out)


def place(df: DataFrame, name: str) -> str:
    """The column of numbered(df) that pick() takes for a name."""
    lower = [c.lower() for c in df.columns]
    return f"_{df.columns.index(name) if name in df.columns else lower.index(name.lower())}"


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, ...: whatever they were called, what an operator adds can't
    clash with them. named() gives them their names back."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def named(held: DataFrame, like: DataFrame) -> DataFrame:
    return held.select(*[f"_{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def hashed(df: DataFrame) -> DataFrame:
    """numbered(df) with two hashes, h1 and h2, of all columns: rows that agree in both are taken to
    be equal. They are made by a generator, as the optimizer would follow an expression of so many
    columns through every renaming of each."""
    held = numbered(df)
    cols = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c) for c, t in held.dtypes]
    both = F.struct(F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(0x5EED), *cols).alias("h2"))
    return held.select("*", F.explode(F.array(both)).alias("h")).select(*held.columns, "h.h1", "h.h2")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that very long texts don't meet in one (a longer text
    comes alone). Plans read the setting when they run, so it stays; a lower one of the caller's too."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sedgeflow-")
        spark.sparkContext.setCheckpointDir(top)
    path = qualified(spark, f"{top.rstrip('/')}/sedgeflow-{uuid.uuid4().hex}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """df as a written table: what follows doesn't depend on any executor's memory or disk.

    Spark drops the shuffle files of a written query when its plan is garbage; asking for that here
    keeps disks from holding all of a long job's shuffles. Nothing but disk use depends on it."""
    df.write.mode("errorifexists").parquet(path, compression=compression)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes staged tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions; it grows with the cluster and the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_words(text: Column, other: str) -> Column:
    """The pieces of a text between runs of `other`; null has none. Java takes several times as long
    to find runs of a negated class as to split at a class of ASCII characters."""
    return F.coalesce(F.array_remove(F.split(text, other), ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return split_words(text, f"[{SPACES}]+")


def n_words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(F.length(trimmed) > 0, F.regexp_count(trimmed, F.lit(f"[{SPACES}]+")) + 1).otherwise(0).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z only: no rule of any language or case folding beyond ASCII."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, folder: str) -> DataFrame:
    """A written table of text, label: the texts of at most train_rows labelled ids outside the
    held-out fold (crc32 of the id's text mod 5 is 0), the first by a hash of the id. Equal texts
    stand once, with their greatest label, as do ids that are labelled twice."""
    ids = pick(labels, **{"doc_id": "long", label: "int"}).toDF("doc_id", "label").where("doc_id IS NOT NULL AND label IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.md5(F.col("doc_id").cast("string")))
    # The first by hash are below this share of its range, but for chance; so no task sends more than its share.
    share = min(1.0, (1.1 * train_rows + 100) / max(1, ids.count()))
    low = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") < F.lit(int(share * (1 << 32)))
    chosen = ids.where(low).orderBy("h", "doc_id").limit(train_rows).drop("h")
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")  # at most train_rows rows
    return stage(texts.groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label"), f"{folder}/labelled")


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


#: Schemes that pyarrow knows by another name than Hadoop does.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfss": "abfss"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with a scheme, as Spark resolves it: against fs.defaultFS without one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


class Store:
    """Files in a folder that all executors share, named as qualified() does: a mount that all of
    them have (file:) by its path, any other through pyarrow's file systems."""

    def __init__(self, folder: str):
        scheme, colon, rest = folder.partition(":")
        if not colon:
            raise ValueError(f"{folder} names no file system; see qualified()")
        if scheme == "file":
            self.local, self.folder = True, "/" + rest.lstrip("/")
            return
        from pyarrow import fs

        self.local = False
        self.fs, self.folder = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")

    def write(self, name: str, chunks: Iterator[bytes]) -> None:
        """The whole file or none: a retried task replaces what it wrote before."""
        target, part = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.folder, exist_ok=True)
            with open(part, "wb") as f:
                for c in chunks:
                    f.write(c)
            os.replace(part, target)
        else:
            self.fs.create_dir(self.folder, recursive=True)
            with self.fs.open_output_stream(part) as f:
                for c in chunks:
                    f.write(c)
            self.fs.move(part, target)

    def open(self, name: str):
        """A seekable file."""
        target = f"{self.folder}/{name}"
        return open(target, "rb") if self.local else self.fs.open_input_file(target)
