"""Streams that keep a table of newest rows, count late rows, and join snapshot headers with their details."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.streaming.odds import DELAY, bucketed

#: Partitions of a merged table, each rewritten only by batches that touch it.
PARTS = 16
KEYS = ("race_id", "horse_number", "bucket")
#: A detail comes within so long before or after its snapshot's header.
APART = "10 minutes"


def updates(snapshots: DataFrame, delay: str = DELAY) -> DataFrame:
    """(race_id, horse_number, bucket, day, newest) of fetched snapshots: the newest of each key and day. As a stream, what a
    batch changed, with ``update`` mode; a day's state goes once the watermark has passed the day, and later rows of it are dropped."""
    rows = bucketed(snapshots.where("status = 'fetched'"))
    rows = rows.withWatermark("snapshot_at", delay) if snapshots.isStreaming else rows
    newest = F.max(F.struct("snapshot_at", "snapshot_id", "odds")).alias("newest")
    return rows.groupBy(*KEYS, F.window("snapshot_at", "1 day").alias("day")).agg(newest).select(*KEYS, F.col("day.start").alias("day"), "newest")


class MergedTable:
    """Newest rows by key under a folder that all executors share, in versions: ``batch=B/part=P`` holds part P as batch B left it.

    A batch writes only the parts that its rows touch, from each part's newest version of an
    earlier batch, so that the same batch again writes the same again, and readers see either
    version of a part, never half of one. Versions that no replay needs any more are removed.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts
        jvm = spark._jvm.org.apache.hadoop.fs  # type: ignore[union-attr]
        self._of = lambda p: jvm.Path(p)
        self._fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, list[int]]:
        """Batches by part, oldest first; a batch that didn't end isn't one."""
        found: dict[int, list[int]] = {}
        for status in self._fs.globStatus(self._of(f"{self.path}/batch=*/_SUCCESS")) or []:
            folder = status.getPath().getParent()
            batch = int(folder.getName().split("=")[1])
            for part in self._fs.listStatus(folder):
                name = part.getPath().getName()
                if name.startswith("part="):
                    found.setdefault(int(name.split("=")[1]), []).append(batch)
        return {part: sorted(batches) for part, batches in found.items()}

    def read(self, parts: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The newest rows of the parts, as of the batches before ``before``; None while there are none."""
        paths = []
        for part, batches in self.versions().items():
            known = [b for b in batches if before is None or b < before]
            if known and (parts is None or part in parts):
                paths.append(f"{self.path}/batch={known[-1]}/part={part}")
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in (KEYS, newest) rows; what ``foreachBatch`` calls."""
        new = batch.select(*KEYS, "newest").withColumn("part", F.pmod(F.xxhash64("race_id"), F.lit(self.parts)).cast("int"))
        new = new.persist()  # read twice; what is lost is computed again
        try:
            touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts``
            old = self.read(touched, before=batch_id) if touched else None
            both = new if old is None else new.unionByName(old.withColumn("part", F.pmod(F.xxhash64("race_id"), F.lit(self.parts)).cast("int")))
            if touched:
                kept = both.groupBy(*KEYS, "part").agg(F.max("newest").alias("newest"))
                kept.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch={batch_id}")
        finally:
            new.unpersist()
        for part, batches in self.versions().items():
            for stale in [b for b in batches if b < batch_id][:-1]:
                self._fs.delete(self._of(f"{self.path}/batch={stale}/part={part}"), True)


@dataclass(frozen=True)
class Progress:
    """Of one batch: rows read, rows in state after it, and rows that came too late."""

    batch: int
    rows: int
    state: int
    late: int


def run(writer, checkpoint: str) -> list[Progress]:
    """Runs a stream's writer over all that is there now, in as many batches as the source deals out."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    of = lambda p, name: sum(o[name] for o in p.get("stateOperators", []))
    plain = [json.loads(p.json) for p in query.recentProgress]
    return [Progress(p["batchId"], p["numInputRows"], of(p, "numRowsTotal"), of(p, "numRowsDroppedByWatermark")) for p in plain]


def merge_stream(snapshots: DataFrame, folder: str, delay: str = DELAY, parts: int = PARTS) -> tuple[MergedTable, list[Progress]]:
    """Keeps the newest odds by race, horse and bucket under ``folder`` from a stream of snapshots; late rows are dropped and counted."""
    table = MergedTable(snapshots.sparkSession, f"{folder}/table", parts)
    writer = updates(snapshots, delay).writeStream.outputMode("update").foreachBatch(table.merge)
    return table, run(writer, f"{folder}/checkpoint")


def joined(headers: DataFrame, details: DataFrame, delay: str = DELAY) -> DataFrame:
    """Details with their snapshot's header (snapshot_id), at most ``APART`` apart in time. Headers have snapshot_at, details detail_at.

    As streams, each side waits for the other as long as the watermarks let a partner come;
    then what has none, such as a detail of a snapshot that failed, is dropped from the state.
    """
    if headers.isStreaming:
        headers, details = headers.withWatermark("snapshot_at", delay), details.withWatermark("detail_at", delay)
    details = details.withColumnRenamed("snapshot_id", "__of")
    span = F.expr(f"INTERVAL {APART}")
    near = (F.col("detail_at") >= F.col("snapshot_at") - span) & (F.col("detail_at") <= F.col("snapshot_at") + span)
    return headers.join(details, (F.col("snapshot_id") == F.col("__of")) & near).drop("__of")


def join_stream(headers: DataFrame, details: DataFrame, folder: str, delay: str = DELAY) -> tuple[DataFrame, list[Progress]]:
    """The rows that the joined streams gave, written under ``folder``."""
    stream = joined(headers, details, delay)
    done = run(stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), f"{folder}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), done
