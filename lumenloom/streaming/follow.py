"""Following a growing rollout log: compaction and summaries as Structured Streaming.

A checkpoint batch is a new file (a file is read once, so appended lines of an
old one would be missed). Each micro-batch is merged into a compacted table by
latest-wins. The table is divided into buckets of its keys; a batch rewrites only
the buckets it touches, and a small manifest, written after them, names each
bucket's folder, so a lost executor or a restarted query repeats a batch without
harm. Files are reached through Hadoop's file system.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenloom.operators.logs import latest_wins
from lumenloom.sources import files
from lumenloom.sources.readers import parse_checkpoints

#: Buckets of a compacted table.
BUCKETS = 64
_MANIFEST = "manifest-"


class CompactedTable:
    """A table of the latest row per key in a shared folder; rows with a null key aren't kept."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets

    def _manifests(self) -> list[int]:
        return sorted(int(n.removeprefix(_MANIFEST).removesuffix(".json")) for n in files.names(self.spark, self.folder) if n.startswith(_MANIFEST) and n.endswith(".json"))

    def state(self) -> tuple[int, dict[str, str]]:
        """The number of the last batch, -1 for none, and each bucket's folder."""
        known = self._manifests()
        return (known[-1], json.loads(files.read_text(self.spark, f"{self.folder}/{_MANIFEST}{known[-1]}.json"))) if known else (-1, {})

    def read(self) -> DataFrame | None:
        """The current rows; None before the first batch."""
        _, where = self.state()
        return self.spark.read.parquet(*sorted(where.values())) if where else None

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a batch; merging the same batch again changes nothing. Older folders are removed, those of the batch before excepted."""
        last, where = self.state()
        if batch_id <= last:  # the batch was merged and only its commit was lost
            return
        numbered = batch.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = sorted(str(r["_bucket"]) for r in numbered.select("_bucket").distinct().collect())
        if not touched:
            return
        old = [where[b] for b in touched if b in where]
        rows = numbered
        if old:
            before = self.spark.read.parquet(*old)
            rows = numbered.unionByName(before.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))
        version = f"{self.folder}/v{batch_id}"
        latest_wins(rows, ["_bucket", *self.keys], self.order).write.mode("overwrite").partitionBy("_bucket").parquet(version)
        written = {n.removeprefix("_bucket=") for n in files.names(self.spark, version) if n.startswith("_bucket=")}
        now = {**{b: f for b, f in where.items() if b not in touched}, **{b: f"{version}/_bucket={b}" for b in written}}
        files.put_text(self.spark, f"{self.folder}/{_MANIFEST}{batch_id}.json", json.dumps(now))
        kept = {*now.values(), *where.values()}
        for name in files.names(self.spark, self.folder):
            if name.startswith(_MANIFEST) and name not in (f"{_MANIFEST}{last}.json", f"{_MANIFEST}{batch_id}.json"):
                files.remove(self.spark, f"{self.folder}/{name}")
            elif name.startswith("v"):
                for part in files.names(self.spark, f"{self.folder}/{name}"):
                    if part.startswith("_bucket=") and f"{self.folder}/{name}/{part}" not in kept:
                        files.remove(self.spark, f"{self.folder}/{name}/{part}")


def _lines(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """A stream of a folder's checkpoint records, unreadable lines left out."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    return parse_checkpoints(stream.select("value", F.col("_metadata.file_modification_time").alias("file_time")))


def _start(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def follow_log(spark: SparkSession, source: str, table: CompactedTable, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, files_per_batch: int = 100, seconds: int | None = None) -> StreamingQuery:
    """Follows a folder of checkpoint files into a compacted table; `then` gets the table's rows after each batch.

    With `seconds` it keeps polling, else it takes what is there and ends. Unreadable lines are left out.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)
        rows = table.read()
        if then is not None and rows is not None:
            then(rows, batch_id)

    return _start(_lines(spark, source, files_per_batch).where("job_key is not null"), merge, checkpoint, seconds)


def follow_completed_keys(spark: SparkSession, source: str, table: CompactedTable, checkpoint: str, files_per_batch: int = 100, seconds: int | None = None) -> StreamingQuery:
    """Keeps every job key once, with the time it was last written, in a compacted table keyed by job_key and ordered by `at`.

    All keys are remembered however late their rows come; no watermark drops any.
    """
    keys = _lines(spark, source, files_per_batch).where("job_key is not null").select("job_key", F.timestamp_seconds("written_at").alias("at"))
    return _start(keys, table.upsert, checkpoint, seconds)
