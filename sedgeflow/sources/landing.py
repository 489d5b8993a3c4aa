"""Landing a partitioned log: capture within fixed bounds, land, acknowledge; each phase may come again.

Rows have partition (string), offset (long) and value (string). The journal is a folder of small files:
pending.json names the captured batch that isn't acknowledged yet, landed.json the snapshot that was
read back, state.json what is acknowledged. A batch's name is a hash of its manifest.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeflow.sources.shared import exists, move, read_text, remove, write_text


class LandingError(ValueError):
    pass


def shares(starts: dict[str, int], ends: dict[str, int], budget: int) -> dict[str, int]:
    """Where each partition's capture ends: in turn, each may take an equal part of what is left of the
    budget, so that later partitions aren't starved; one that has less leaves the rest to those behind."""
    out, left = {}, budget
    for k, p in enumerate(sorted(starts)):
        fair = max(1, left // (len(starts) - k)) if left else 0
        take = min(ends[p] - starts[p], fair)
        out[p] = starts[p] + take
        left -= take
    return out


class Landing:
    def __init__(self, spark: SparkSession, folder: str, target: str):
        self.spark, self.folder, self.target = spark, folder, target

    def _load(self, name: str) -> dict:
        at = f"{self.folder}/{name}.json"
        return json.loads(read_text(self.spark, at)) if exists(self.spark, at) else {}

    def _save(self, name: str, value: dict) -> None:
        write_text(self.spark, f"{self.folder}/{name}.json", json.dumps(value, sort_keys=True))

    def state(self) -> dict:
        return self._load("state")

    def capture(self, rows: DataFrame, bounds: dict[str, tuple[int, int]], max_records: int = 10_000, max_bytes: int = 32 << 20) -> str | None:
        """Archives the next rows of each partition (bounds: first offset that is still there, end) and
        returns the batch's name, or None if there are none. A pending batch is returned as it is."""
        pending = self._load("pending")
        if pending:
            return pending["batch"]
        state = self.state()
        offsets = state.get("offsets", {})
        if offsets and set(offsets) != set(bounds):
            raise LandingError("the log has other partitions")
        starts = {p: offsets.get(p, 0) for p in bounds}
        for p, (first, end) in bounds.items():
            if not first <= starts[p] <= end:
                raise LandingError(f"{p}: rows were removed, or the log was cut")
        ends = shares(starts, {p: end for p, (_, end) in bounds.items()}, max_records)
        if ends == starts:
            return None
        inside = F.lit(False)
        for p in starts:
            inside |= (F.col("partition") == p) & (F.col("offset") >= starts[p]) & (F.col("offset") < ends[p])
        held = rows.where(inside).select("partition", "offset", "value")
        per = held.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("k"), F.sum(F.octet_length("value")).alias("bytes"), F.sum(F.xxhash64("partition", "offset", "value").cast("decimal(38,0)")).cast("string").alias("mark"))
        found = {r["partition"]: r for r in per.collect()}  # a row for each partition
        for p in starts:
            n = ends[p] - starts[p]
            if n and (p not in found or (found[p]["n"], found[p]["k"]) != (n, n)):
                raise LandingError(f"{p}: offsets are missing or repeat")
        if sum(r["bytes"] or 0 for r in found.values()) > max_bytes:
            raise LandingError("the batch is over its byte budget; take fewer records")
        manifest = {"starts": starts, "ends": ends, "parent": state.get("snapshot"), "marks": {p: r["mark"] for p, r in found.items()}}
        batch = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
        held.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        self._save(f"manifest-{batch}", manifest)
        self._save("pending", {"batch": batch})
        return batch

    def land(self) -> dict:
        """Copies the pending batch beside its place, reads the copy back, renames it and names the
        snapshot of all batches by its content. Again, it changes nothing."""
        batch = self._load("pending").get("batch")
        if not batch:
            raise LandingError("nothing is pending")
        manifest, state = self._load(f"manifest-{batch}"), self.state()
        if state.get("batch") != batch and manifest["parent"] != state.get("snapshot"):
            raise LandingError("the batch follows another snapshot")
        at, staged = f"{self.target}/batches/{batch}", f"{self.target}/batches/.{batch}"
        if not exists(self.spark, at):
            remove(self.spark, staged)
            self.spark.read.parquet(f"{self.folder}/batches/{batch}").write.parquet(staged)
            copy = self.spark.read.parquet(staged).groupBy("partition").agg(F.sum(F.xxhash64("partition", "offset", "value").cast("decimal(38,0)")).cast("string").alias("mark"))
            if {r["partition"]: r["mark"] for r in copy.collect()} != manifest["marks"]:
                raise LandingError("what was landed differs")
            move(self.spark, staged, at)
        batches = [b for b in state.get("batches", []) if b != batch] + [batch]
        snapshot = hashlib.sha256(json.dumps([batches, manifest["ends"]], sort_keys=True).encode()).hexdigest()
        receipt = {"batch": batch, "batches": batches, "offsets": manifest["ends"], "snapshot": snapshot}
        write_text(self.spark, f"{self.target}/snapshots/{snapshot}.json", json.dumps(receipt, sort_keys=True))
        self._save("landed", receipt)
        return receipt

    def acknowledge(self, commit) -> dict:
        """commit(offsets) tells the log; then the journal moves on. Only what land() read back is
        acknowledged."""
        batch = self._load("pending").get("batch")
        receipt = self._load("landed")
        if not batch or receipt.get("batch") != batch:
            raise LandingError("the pending batch hasn't landed")
        commit(receipt["offsets"])
        self._save("state", receipt)
        remove(self.spark, f"{self.folder}/pending.json")
        return receipt

    def read(self, snapshot: str | None = None) -> DataFrame:
        """The rows of a snapshot, or of the acknowledged one."""
        receipt = json.loads(read_text(self.spark, f"{self.target}/snapshots/{snapshot or self.state()['snapshot']}.json"))
        return self.spark.read.parquet(*[f"{self.target}/batches/{b}" for b in receipt["batches"]])
