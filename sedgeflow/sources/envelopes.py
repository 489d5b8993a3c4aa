"""Event envelopes and change logs: JSON lines, snapshot manifests, bounded capture, sync."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeflow.functions.contract import APPS, CHANGE, ENVELOPE, EVENT
from sedgeflow.functions.time import aware
from sedgeflow.sources.shared import exists, qualified, read_text, size, streamed_sha256, write_text

CORRUPT = "_corrupt_record"
#: An envelope whose event is still text.
RAW = T.StructType([*[f for f in ENVELOPE if f.name != "event"], T.StructField("event", T.StringType()), T.StructField(CORRUPT, T.StringType())])


def read_events(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Envelopes with an explicit schema: seq, source, accepted_at, event, event_json (its own text, in
    which the contract looks for unknown fields) and _corrupt_record (lines that aren't envelopes,
    and events with values of other types)."""
    held = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    return parsed(held.withColumnRenamed("event", "event_json"))


def parsed(held: DataFrame) -> DataFrame:
    """event from event_json."""
    inner = T.StructType([*EVENT, T.StructField(CORRUPT, T.StringType())])
    held = held.withColumn("event", F.from_json("event_json", inner, {"columnNameOfCorruptRecord": CORRUPT}))
    corrupt = F.coalesce(CORRUPT, f"event.{CORRUPT}") if CORRUPT in held.columns else F.col(f"event.{CORRUPT}")
    return held.withColumn(CORRUPT, corrupt).withColumn("event", F.col("event").dropFields(CORRUPT)).select("seq", "source", "accepted_at", "event", "event_json", CORRUPT)


def read_changes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(CHANGE).json(paths)


def stream_events(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """New files of a folder, as read_events() reads them; a Kafka topic is kafka_events()."""
    held = spark.readStream.schema(RAW).option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files).json(folder)
    return parsed(held.withColumnRenamed("event", "event_json"))


def kafka_events(spark: SparkSession, servers: str, topic: str, start: int | None = None, partition: int = 0, records: int = 100_000) -> DataFrame:
    """The same from one ordered partition of a topic: from a fixed offset, which must still be there, or
    from the earliest. Needs Spark's Kafka connector, which isn't bundled with Spark."""
    first = "earliest" if start is None else json.dumps({topic: {str(partition): start}})
    options = {"kafka.bootstrap.servers": servers, "assign": json.dumps({topic: [partition]}), "startingOffsets": first, "failOnDataLoss": "true", "maxOffsetsPerTrigger": str(records)}
    rows = spark.readStream.format("kafka").options(**options).load()
    held = rows.select(F.from_json(F.col("value").cast("string"), RAW, {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return parsed(held.withColumnRenamed("event", "event_json"))


def to_kafka(rows: DataFrame, servers: str, topic: str, key: str = "event_id") -> None:
    """A batch of rows (in foreachBatch) to a topic as JSON, keyed; needs the same connector."""
    rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def raw_change(row: Column) -> Column:
    """A change envelope's body: the image after it, or before it for deletes, by op."""
    return F.when(row["op"] == "d", row["before"]).otherwise(row["after"])


# --- snapshots ------------------------------------------------------------------------------


class SnapshotError(ValueError):
    pass


#: Bytes up to which an executor reads a file whole to hash it; longer ones are streamed.
WHOLE_BYTES = 32 << 20


def digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file's bytes: executors hash the files, the driver streams those of more than
    WHOLE_BYTES through a fixed buffer. No file's text reaches the driver."""
    held = {p: qualified(spark, p) for p in paths}
    found, whole = {}, []
    for at in set(held.values()):
        if 0 < size(spark, at) <= WHOLE_BYTES:
            whole.append(at)
        else:  # a scan leaves empty files out
            found[at] = streamed_sha256(spark, at)
    if whole:
        tasks = spark.read.format("binaryFile").load(whole).select("path", F.sha2("content", 256).alias("h"))
        found |= {r["path"]: r["h"] for r in tasks.collect()}  # a row for each file
    return {p: found[at] for p, at in held.items()}


def write_snapshot(spark: SparkSession, path: str, kind: str, source: str, batches: list[dict]) -> str:
    """A manifest named by its content: a list of batches {batch_id, path, sha256, valid,
    quarantined, oldest}. Returns its path."""
    body = json.dumps({"schema": 1, "kind": kind, "source": source, "batches": sorted(batches, key=lambda b: b["batch_id"])}, sort_keys=True)
    at = f"{path}/{hashlib.sha256(body.encode()).hexdigest()}.json"
    if not exists(spark, at):
        write_text(spark, at, body, replace=False)
    return at


def resolve_snapshot(spark: SparkSession, path: str, kind: str, source: str, now: datetime | None = None, days: int = 30) -> tuple[list[str], dict]:
    """The files of a snapshot, after every check: name and content agree, schema, kind and source
    are as asked, no batch repeats or has quarantined rows, no file changed, and (source real)
    nothing is older than `days`."""
    body = read_text(spark, path)
    if hashlib.sha256(body.encode()).hexdigest() != path.rsplit("/", 1)[-1].removesuffix(".json"):
        raise SnapshotError("the manifest's name isn't its content's")
    meta = json.loads(body)
    if (meta.get("schema"), meta.get("kind"), meta.get("source")) != (1, kind, source):
        raise SnapshotError("another schema, kind or source")
    ids = [b["batch_id"] for b in meta["batches"]]
    if len(set(ids)) != len(ids):
        raise SnapshotError("a batch repeats")
    if any(b["quarantined"] for b in meta["batches"]):
        raise SnapshotError("a batch has quarantined rows")
    if source == "real":
        now = aware(now or datetime.now(timezone.utc))
        if any((now - aware(datetime.fromisoformat(b["oldest"]))).days >= days for b in meta["batches"] if b.get("oldest")):
            raise SnapshotError("a batch has expired")
    found = digests(spark, [b["path"] for b in meta["batches"]])
    for b in meta["batches"]:
        if found.get(b["path"]) != b["sha256"]:
            raise SnapshotError(f"{b['path']} has changed")
    return [b["path"] for b in meta["batches"]], meta


# --- capture and sync -----------------------------------------------------------------------


def bounded_capture(rows: DataFrame, ends: dict[int, int], per_partition: int) -> DataFrame:
    """The next rows of each partition of a log, at most per_partition each and none past its fixed
    end. `ends` has one entry for each partition."""
    limit = F.lit(None).cast("long")
    for p, end in ends.items():
        limit = F.when(F.col("kafka_partition") == p, F.lit(end)).otherwise(limit)
    first = rows.groupBy("kafka_partition").agg(F.min("kafka_offset").alias("_first"))
    held = rows.join(F.broadcast(first), "kafka_partition")  # a row for each partition of the topic
    return held.where((F.col("kafka_offset") < limit) & (F.col("kafka_offset") < F.col("_first") + per_partition)).drop("_first")


def contiguity(rows: DataFrame) -> DataFrame:
    """kafka_partition, starts, ends, n, contiguous for each partition of a captured batch."""
    per = rows.groupBy("kafka_partition").agg(F.min("kafka_offset").alias("starts"), (F.max("kafka_offset") + 1).alias("ends"), F.countDistinct("kafka_offset").alias("n"))
    return per.withColumn("contiguous", F.col("ends") - F.col("starts") == F.col("n"))


class Sync:
    """Archive, then publish: pages of a collector are written as files before the cursor moves, and
    a page that comes again must be the same."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def cursor(self) -> int:
        at = f"{self.folder}/cursor.json"
        return json.loads(read_text(self.spark, at))["seq"] if exists(self.spark, at) else 0

    def once(self, fetch, publish, limit: int = 500) -> int:
        """fetch(after, limit) gives envelopes; publish(path) takes the archived page. Returns how
        many were new."""
        after = self.cursor()
        page = fetch(after, limit)
        if not page:
            return 0
        seqs = [r["seq"] for r in page]
        if seqs != sorted(set(seqs)) or seqs[0] <= after:
            raise ValueError("the page's numbers don't rise from the cursor")
        body = "".join(json.dumps(r, sort_keys=True) + "\n" for r in page)
        at = f"{self.folder}/page-{seqs[0]:012d}.jsonl"
        if exists(self.spark, at):
            if read_text(self.spark, at) != body:
                raise ValueError("the archived page differs")
        else:
            write_text(self.spark, at, body, replace=False)
        publish(at)
        write_text(self.spark, f"{self.folder}/cursor.json", json.dumps({"seq": seqs[-1]}))
        return len(page)


# --- writing --------------------------------------------------------------------------------


def write_facts(facts: DataFrame, path: str, quarantined: int, columns: tuple[str, ...] = ("source", "business_date")) -> str:
    """Parquet by source and business date, so that both filters prune folders. Quarantined rows
    forbid it. Rows are dealt by the same columns and a hash, so a day has few files and no day is
    one task."""
    if quarantined:
        raise ValueError(f"{quarantined} quarantined rows")
    spread = F.pmod(F.xxhash64("event_id"), F.lit(8))
    facts.repartition(*columns, spread).write.mode("errorifexists").partitionBy(*columns).parquet(path)
    return path


def register(spark: SparkSession, table: str, path: str, expected: int) -> int:
    """A catalog table over written Parquet, with its partitions, read back and counted."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} USING PARQUET LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(table)):
        spark.sql(f"MSCK REPAIR TABLE {table}")
    n = spark.table(table).count()
    if n != expected:
        raise ValueError(f"{table} has {n} rows, not {expected}")
    return n


def verify(spark: SparkSession, table: str, path: str, columns: dict[str, str], partitions: tuple[str, ...]) -> None:
    """Raises unless the catalog's table is an external one over this path with these columns."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if said.get("Type") != "EXTERNAL" or not said.get("Location", "").rstrip("/").endswith(path.split(":")[-1].rstrip("/").lstrip("/")):
        raise ValueError(f"{table} is another table: {said.get('Type')}, {said.get('Location')}")
    found = {c.name: c for c in spark.catalog.listColumns(table)}
    if {n: c.dataType for n, c in found.items()} != columns or {n for n, c in found.items() if c.isPartition} != set(partitions):
        raise ValueError(f"{table} has other columns or partitions")


def unregister(spark: SparkSession, table: str) -> None:
    """Takes an external table out of the catalog; its files stay."""
    if spark.catalog.tableExists(table):
        if "EXTERNAL" not in {r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}:
            raise ValueError(f"{table} owns its files")
        spark.sql(f"DROP TABLE {table}")


#: Fixed value: the namespace of name-based UUIDs of URLs (RFC 9562, section 6.6).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID of version 5: SHA-1 of the namespace's bytes and the name's."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def log_events(records: DataFrame, app: str = APPS[1], prefix: str = "request/") -> DataFrame:
    """Completion log lines (request_id, character_id, success, elapsed_ms, at) as events, whose ids are
    the name-based UUIDs of prefix and request."""
    return records.where("request_id IS NOT NULL AND success IS NOT NULL").select(
        F.lit(1).cast("long").alias("schema_version"), uuid5(F.concat(F.lit(prefix), F.col("request_id"))).alias("event_id"), F.lit(app).alias("app"),
        F.lit("request_complete").alias("event_type"), F.col("at").alias("occurred_at"), "request_id", "character_id", "success", "elapsed_ms",
    )
