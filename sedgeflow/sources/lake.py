"""A versioned table: immutable Parquet folders and one log file for each version.

A version is a list of folders. Appending adds one. Merging and deleting write anew only the folders
that hold rows they change, with one new folder; compaction writes all anew. The log entry of the next
version is renamed into place without replacing, so of two writers one fails. Old versions stay
readable with their own columns and layout.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeflow.sources.shared import list_files, list_names, read_text, write_text


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        """The greatest that the log lists; every one before it is there, as each follows another."""
        names = [n for n in list_names(self.spark, f"{self.path}/log") if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:010d}.json"

    def log(self, version: int | None = None) -> dict:
        at = self.version() if version is None else version
        return json.loads(read_text(self.spark, self._entry(at))) if at else {"version": 0, "folders": [], "schema": None, "partitions": []}

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.log(version)
        if not entry["folders"]:
            raise ValueError("no rows were ever written")
        out = self._folders(entry, entry["folders"])
        if entry.get("lowest"):
            keys, by = entry["lowest"]
            row = F.min_by(F.struct(*out.columns), F.col(by)).alias("r")
            out = out.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("r.*")
        return out

    def _folders(self, entry: dict, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f).select(*schema.names) for f in folders]
        return reduce(DataFrame.unionByName, parts)

    def _commit(self, operation: str, before: dict, folders: list[str], schema: T.StructType, partitions: list[str], lowest=None) -> int:
        n = before["version"] + 1
        entry = {"version": n, "operation": operation, "at": int(time.time() * 1e6), "folders": folders, "schema": json.loads(schema.json()), "partitions": partitions, "lowest": lowest}
        specs = before.get("specs", {}) | {f: partitions for f in folders if f not in before["folders"]}
        entry["specs"] = {f: specs.get(f, partitions) for f in folders}
        write_text(self.spark, self._entry(n), json.dumps(entry), replace=False)
        return n

    def _write(self, rows: DataFrame, partitions: list[str]) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(folder)
        return folder

    def append(self, rows: DataFrame, lowest: tuple[list[str], str] | None = None) -> int:
        """New columns join the schema; rows of before have null there. With lowest (keys, column), of
        rows that share the keys the one with the least column is what reads give."""
        before = self.log()
        schema = T.StructType.fromJson(before["schema"]) if before["schema"] else T.StructType()
        known = {f.name: f.dataType for f in schema}
        for f in rows.schema:
            if known.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} has another type")
        merged = T.StructType([*schema, *[T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in schema.names]])
        how = list(lowest) if lowest else before.get("lowest")
        return self._commit("append", before, [*before["folders"], self._write(rows, before["partitions"])], merged, before["partitions"], how)

    def _touched(self, entry: dict, condition) -> list[str]:
        """The folders of which condition(rows) leaves any row; one scan, a row for each folder."""
        if entry.get("lowest"):
            return entry["folders"]  # a row that wins may stand in any of them
        hit = [condition(self._folders(entry, [f])).limit(1).select(F.lit(k).alias("k")) for k, f in enumerate(entry["folders"])]
        return [entry["folders"][r["k"]] for r in reduce(DataFrame.union, hit).collect()] if hit else []

    def _replace(self, operation: str, before: dict, touched: list[str], rows: DataFrame) -> int:
        kept = [f for f in before["folders"] if f not in touched]
        return self._commit(operation, before, [*kept, self._write(rows, before["partitions"])], rows.schema, before["partitions"])

    def merge(self, changes: DataFrame, keys: list[str]) -> int:
        """Updates rows of the same keys and inserts the others. Only folders with such rows are written
        anew; of each key the change stands before the row, by one aggregation. Keys must not repeat
        among the changes."""
        before = self.log()
        if not before["folders"]:
            return self.append(changes)
        if not changes.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("changes repeat a key")
        touched = self._touched(before, lambda rows: rows.join(changes.select(*keys), keys, "left_semi"))
        old = self.read(before["version"]) if before.get("lowest") else self._folders(before, touched)
        both = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        cols = [c for c in both.columns if c != "_new"]
        last = both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*cols), "_new").alias("r"))
        return self._replace("merge", before, touched, last.select("r.*"))

    def delete(self, condition: Column) -> int:
        """Only folders with such rows are written anew."""
        before = self.log()
        gone = F.coalesce(condition, F.lit(False))
        touched = self._touched(before, lambda rows: rows.where(gone))
        rows = self.read(before["version"]) if before.get("lowest") else self._folders(before, touched)
        return self._replace("delete", before, touched, rows.where(~gone))

    def repartition_spec(self, columns: list[str], rewrite: bool = True) -> int:
        """Another partitioning for what is written from now on; with rewrite the rows are laid out anew."""
        before = self.log()
        if not rewrite:
            return self._commit("partition", before, before["folders"], T.StructType.fromJson(before["schema"]), columns, before.get("lowest"))
        rows = self.read(before["version"])
        return self._commit("partition", before, [self._write(rows, columns)], rows.schema, columns)

    def compact(self, files: int | None = None, file_bytes: int = 128 << 20) -> int:
        """The same rows in files of about file_bytes, or in at most `files` files. Rows are dealt by a
        shuffle, so that what computes them isn't narrowed to so few tasks."""
        before = self.log()
        size = sum(n for f in before["folders"] for p, n in list_files(self.spark, f) if p.endswith(".parquet"))
        n = files or max(1, -(-size // file_bytes))
        rows = self.read(before["version"]).repartition(n)
        return self._commit("compact", before, [self._write(rows, before["partitions"])], rows.schema, before["partitions"])

    def spec_counts(self, version: int | None = None) -> DataFrame:
        """spec (the partition columns, comma-joined), files, rows: what each partitioning holds."""
        entry = self.log(version)
        by: dict[str, list[str]] = {}
        for f in entry["folders"]:
            by.setdefault(",".join(entry["specs"][f]), []).append(f)
        rows = [(spec, sum(p.endswith(".parquet") for f in folders for p, _ in list_files(self.spark, f)), self._folders(entry, folders).count()) for spec, folders in sorted(by.items())]
        return self.spark.createDataFrame(rows, "spec string, files long, rows long")

    def history(self) -> DataFrame:
        rows = [self.log(v) for v in range(1, self.version() + 1)]
        return self.spark.createDataFrame([(r["version"], r["operation"], r["at"], len(r["folders"])) for r in rows], "version int, operation string, at long, folders int")

    def files(self, version: int | None = None) -> DataFrame:
        found = [(f, p, n) for f in self.log(version)["folders"] for p, n in list_files(self.spark, f) if p.endswith(".parquet")]
        return self.spark.createDataFrame(found, "folder string, file string, bytes long")
