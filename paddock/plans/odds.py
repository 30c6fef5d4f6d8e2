"""Queries of pre-race odds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import asof
from paddock.plans.registry import query
from paddock.sources.adapter import Tables
from paddock.sources.scratch import folder
from paddock.streaming import merge
from paddock.streaming import odds as o

M = "date_diff('second', snapshot_at, post_time_at) / 60.0::DOUBLE"
BUCKET = "CASE WHEN m IS NULL THEN 'unknown' WHEN m < 0 THEN 'post_time' " + " ".join(f"WHEN m >= {low} THEN '{name}'" for name, low, _ in o.BUCKETS) + " END"
Z = ("z", f"SELECT *, {BUCKET} AS bucket FROM (SELECT *, {M} AS m FROM (SELECT * REPLACE (date_trunc('second', snapshot_at) AS snapshot_at) FROM snapshots))")


def snapshots(t: Tables) -> DataFrame:
    """Snapshots with whole seconds, as the source states them."""
    return t.snapshots.withColumn("snapshot_at", F.date_trunc("second", "snapshot_at").cast("timestamp_ntz"))


@query("SELECT race_id, CASE WHEN track_id <> 3 THEN date + to_minutes(CAST(post_time_min AS BIGINT)) END AS post_time_at FROM race")
def post_time_at(t: Tables) -> DataFrame:
    clock = F.concat_ws(":", F.floor(F.col("post_time_min") / 60).cast("string"), F.lpad((F.col("post_time_min") % 60).cast("string"), 2, "0"))
    text = F.when(F.col("track_id") == 3, "soon").otherwise(clock)
    return t.race.select("race_id", o.post_time_at(F.col("date"), text).cast("timestamp_ntz").alias("post_time_at"))


@query("SELECT snapshot_id, round(m, 6) AS minutes FROM z", Z)
def minutes_to_post(t: Tables) -> DataFrame:
    return snapshots(t).select("snapshot_id", F.round(o.minutes_to_post(F.col("post_time_at"), F.col("snapshot_at")), 6).alias("minutes"))


@query("SELECT snapshot_id, bucket FROM z", Z)
def time_bucket(t: Tables) -> DataFrame:
    return o.bucketed(snapshots(t)).select("snapshot_id", "bucket")


@query("SELECT race_id, bet_type, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(odds) > 0 THEN 'fetched' ELSE 'no_odds' END AS state FROM snapshots GROUP BY 1, 2")
def snap_status(t: Tables) -> DataFrame:
    one = t.snapshots.groupBy("race_id", "bet_type").agg(F.collect_list("odds").alias("odds"), F.max(F.when(F.col("status") == "failed", "error")).alias("error"))
    return one.select("race_id", "bet_type", o.snapshot_status(F.col("odds"), F.col("error")).alias("state"))


@query("SELECT snapshot_id FROM z WHERE m >= 0", Z)
def unstarted(t: Tables) -> DataFrame:
    return snapshots(t).where(F.col("post_time_at") >= F.col("snapshot_at")).select("snapshot_id")


DUE = "SELECT unnest([" + ", ".join(f"{{'bucket': '{b}', 'lo': {0.0 if b == 'pre_0_2' else m}::DOUBLE, 'hi': {m + 5.0}::DOUBLE}}" for b, m in o.TARGETS.items()) + "]) AS w"


@query(f"SELECT race_id, w.bucket AS bucket, min(snapshot_at) AS tick FROM (SELECT r.race_id, snapshot_at, date_diff('second', snapshot_at, r.post) / 60.0::DOUBLE AS m FROM (SELECT DISTINCT snapshot_at FROM z) JOIN (SELECT DISTINCT race_id, post_time_at AS post FROM z) r ON r.post >= snapshot_at AND r.post <= snapshot_at + INTERVAL 3 HOURS) JOIN ({DUE}) d ON m >= w.lo AND m <= w.hi GROUP BY 1, 2", Z)
def due_schedule(t: Tables) -> DataFrame:
    s = snapshots(t)
    return o.due(s.select(F.col("snapshot_at").alias("tick")).distinct(), s.select("race_id", "post_time_at").distinct(), 300)


@query("SELECT race_id, bet_type, bucket, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY race_id, bet_type, bucket ORDER BY snapshot_at, snapshot_id) AS n FROM z) WHERE n = 1", Z)
def once_per_bucket(t: Tables) -> DataFrame:
    return o.once_per_bucket(snapshots(t)).select("race_id", "bet_type", "bucket", "snapshot_id")


LATEST = "SELECT race_id, {keys}, snapshot_id, round(odds, 6) AS odds FROM (SELECT *, row_number() OVER (PARTITION BY race_id, {keys} ORDER BY snapshot_at DESC, snapshot_id DESC) AS n FROM z WHERE status = 'fetched') WHERE n = 1"


@query(LATEST.format(keys="bet_type"), Z)
def latest_odds(t: Tables) -> DataFrame:
    df = o.latest(snapshots(t), ["race_id", "bet_type"])
    return df.select("race_id", "bet_type", "snapshot_id", F.round("odds", 6).alias("odds"))


@query("SELECT p.race_id, p.horse_number, CAST(row_number() OVER (PARTITION BY p.race_id ORDER BY pred_top3 DESC, p.horse_number) AS INT) AS pred_rank, round(pred_top3 * odds, 6) AS expected_value FROM predictions p LEFT JOIN newest n ON n.race_id = p.race_id AND n.horse_number = p.horse_number", Z, ("newest", LATEST.format(keys="horse_number").replace("SELECT race_id,", "SELECT lpad(race_id, 12, '0') AS race_id,", 1).replace("round(odds, 6) AS odds", "odds")))
def live_join(t: Tables) -> DataFrame:
    newest = o.latest(snapshots(t), ["race_id", "horse_number"]).withColumn("race_id", F.lpad("race_id", 12, "0"))
    return o.live_join(t.predictions, newest).select("race_id", "horse_number", "pred_rank", F.round("expected_value", 6).alias("expected_value"))


ASKS = ("asks", "SELECT snapshot_id AS ask_id, race_id, horse_number, snapshot_at - to_minutes(CAST(snapshot_id % 3 AS INT)) AS asked_at FROM z WHERE horse_number % 4 > 0")


@query("""SELECT ask_id, snapshot_id, round(odds, 6) AS odds, date_diff('second', snapshot_at, asked_at) AS age_seconds FROM (SELECT a.ask_id, a.asked_at, z.snapshot_id, z.odds, z.snapshot_at, row_number() OVER (PARTITION BY a.ask_id ORDER BY z.snapshot_at DESC NULLS LAST, z.snapshot_id DESC) AS n
FROM asks a LEFT JOIN z ON z.race_id = a.race_id AND z.horse_number = a.horse_number AND z.status = 'fetched' AND z.snapshot_at <= a.asked_at) WHERE n = 1""", Z, ASKS)
def odds_as_of(t: Tables) -> DataFrame:
    """For each time of asking the newest fetched odds of the runner that aren't later."""
    df = snapshots(t)
    asks = df.where("horse_number % 4 > 0").select(F.col("snapshot_id").alias("ask_id"), "race_id", "horse_number", F.expr("snapshot_at - make_interval(0, 0, 0, 0, 0, CAST(snapshot_id % 3 AS INT), 0)").alias("asked_at"))
    found = asof.as_of(asks, df.where("status = 'fetched'"), ["race_id", "horse_number"], "asked_at", "snapshot_at", "snapshot_id", ["snapshot_id", "odds"])
    return found.select("ask_id", "snapshot_id", F.round("odds", 6).alias("odds"), F.timestamp_diff("SECOND", "snapshot_at", "asked_at").alias("age_seconds"))


def as_stream(t: Tables) -> DataFrame:
    """The snapshots as a stream: the events table read file by file, through the adapter's own view."""
    spark = t.spark
    files = spark.read.parquet(f"{t.sf_dir}/events.parquet")
    live = Tables(spark, t.sf_dir)
    live._held["events"] = spark.readStream.schema(files.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parq*")
    return live.snapshots.withColumn("snapshot_at", F.date_trunc("second", "snapshot_at"))


def _folder(t: Tables) -> str:
    return f"{folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _run(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    return o.drain(stream, _folder(t), mode)


@query(LATEST.format(keys="horse_number, bucket"), Z)
def stream_bucket_odds(t: Tables) -> DataFrame:
    """Newest odds of each race, horse and bucket, merged batch by batch into the parts that a batch touches."""
    table, _ = merge.merge_stream(as_stream(t), _folder(t))
    return table.read().select("race_id", "horse_number", "bucket", "newest.snapshot_id", F.round("newest.odds", 6).alias("odds"))


def in_files(t: Tables, df: DataFrame, *parts: str) -> DataFrame:
    """A stream of ``df`` in batches, one file each: the rows of each condition."""
    at = f"{folder(t.spark)}/files-{uuid.uuid4().hex}"
    df = df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(at)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


#: The ids' remainders by 3 come in a batch each. Spark judges lateness by the watermark that the batch before had, so
#: in the third batch those rows are late whose day ended a day before the newest time of the first batch.
ON_TIME = ("f", """SELECT * FROM (SELECT *, (SELECT max(snapshot_at) FROM z WHERE snapshot_id % 3 = 0 AND status = 'fetched') - INTERVAL 1 DAY AS mark FROM z WHERE status = 'fetched')
WHERE snapshot_id % 3 < 2 OR date_trunc('day', snapshot_at) + INTERVAL 1 DAY > mark""")


@query(LATEST.format(keys="horse_number, bucket").replace("FROM z", "FROM f"), Z, ON_TIME)
def stream_late_merge(t: Tables) -> DataFrame:
    """The same in three batches with a moving watermark: rows of days that have gone by are dropped."""
    table, _ = merge.merge_stream(in_files(t, snapshots(t), *[f"snapshot_id % 3 = {k}" for k in range(3)]), _folder(t))
    return table.read().select("race_id", "horse_number", "bucket", "newest.snapshot_id", F.round("newest.odds", 6).alias("odds"))


DETAIL_MINUTES = "CAST(snapshot_id % 20 AS INT) - 5"


@query(f"SELECT snapshot_id, race_id, bet_type, horse_number, round(odds, 6) AS odds FROM z WHERE status = 'fetched' AND abs({DETAIL_MINUTES}) <= 10", Z)
def stream_snapshot_join(t: Tables) -> DataFrame:
    """Headers of all snapshots joined with the details of fetched ones, as two streams; details too far from their header find none."""
    df = snapshots(t)
    detail_at = F.expr(f"snapshot_at + make_interval(0, 0, 0, 0, 0, {DETAIL_MINUTES}, 0)").alias("detail_at")
    details = df.where("status = 'fetched'").select("snapshot_id", detail_at, "horse_number", "odds")
    headers = df.select("snapshot_id", "race_id", "bet_type", "snapshot_at")
    one_file = lambda x: in_files(t, x, "true")
    out, _ = merge.join_stream(one_file(headers), one_file(details), _folder(t))
    return out.select("snapshot_id", "race_id", "bet_type", "horse_number", F.round("odds", 6).alias("odds"))


@query("SELECT bucket, count(DISTINCT (race_id, bet_type)) AS collected FROM z GROUP BY 1", Z)
def stream_late(t: Tables) -> DataFrame:
    """Snapshots after the post fall in post_time; one is collected per race, type and bucket."""
    out = _run(t, o.once_per_bucket(as_stream(t)), "append")
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("collected"))
