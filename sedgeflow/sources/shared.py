"""Folders that the driver and all executors share, and small files in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, deleted when the session ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sedgeflow-")
    path = f"{top.rstrip('/')}/table-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)
    return path


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as listings and rows' own file names have it."""
    fs, at = _fs(spark, path)
    return fs.makeQualified(at).toString()


def size(spark: SparkSession, path: str) -> int:
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at).getLen()


def streamed_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, read by the driver in small pieces."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """The whole text or nothing: written beside and renamed over what is there, in one step, so that a
    reader finds the old text or the new one. Without replace the rename itself fails if another
    writer was first."""
    fs, at = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(at), how)
    except Exception as e:
        fs.delete(part, False)
        if replace:
            raise
        raise FileExistsError(path) from e


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; False if the target was there already (then the source is removed)."""
    fs, at = _fs(spark, source)
    _, to = _fs(spark, target)
    if fs.exists(to) or not fs.rename(at, to):
        fs.delete(at, True)
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden and unfinished ones; none if there is no folder."""
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if not n.startswith((".", "_")) and not n.endswith(".part"))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder."""
    fs, at = _fs(spark, path)
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        f = it.next()
        found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)
