"""Pre-race odds snapshots, as batch tables and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets by minutes to the post, and the minute at which each is collected.
BUCKETS = [("over_120", 120.0, None), ("pre_60_120", 60.0, 120.0), ("pre_30_60", 30.0, 60.0), ("pre_15_30", 15.0, 30.0), ("pre_5_15", 5.0, 15.0), ("pre_2_5", 2.0, 5.0), ("pre_0_2", 0.0, 2.0)]
TARGETS = {"over_120": 120.0, "pre_60_120": 60.0, "pre_30_60": 30.0, "pre_15_30": 15.0, "pre_5_15": 5.0, "pre_2_5": 2.0, "pre_0_2": 0.5}
#: Longer than any race's snapshots last, so that a bucket is collected once only.
DELAY = "1 day"


def post_time_at(day: Column, clock: Column) -> Column:
    """A date and 'HH:MM' as a timestamp; null for text that isn't a time."""
    return F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.when(clock.rlike("^[0-9]{1,2}:[0-9]{2}$"), F.lpad(clock, 5, "0"))), F.lit("yyyy-MM-dd HH:mm"))


def minutes_to_post(post: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", now, post) / F.lit(60.0)


def time_bucket(minutes: Column) -> Column:
    out = F.when(minutes.isNull(), "unknown").when(minutes < 0, "post_time")
    for name, low, _ in BUCKETS:
        out = out.when(minutes >= low, name)
    return out


def snapshot_status(odds: Column, error: Column) -> Column:
    """failed, fetched if any of the odds is known, else no_odds."""
    return F.when(error.isNotNull(), "failed").when(F.exists(odds, lambda o: o.isNotNull()), "fetched").otherwise("no_odds")


def due(ticks: DataFrame, races: DataFrame, poll_seconds: float) -> DataFrame:
    """(race_id, bucket, tick): the first tick that falls in the bucket's window, be it on the day before.

    Windows are made once for each distinct post, whatever number of races has it. A window's
    first tick is the first one from its beginning on in the hour in which it begins, or else
    the first of an hour after: both are sums over an hour's ticks, so no window meets more
    than one row an hour, and races only meet the ticks that were found.
    """
    span = max(poll_seconds / 60.0, 0.5)
    windows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(0.0 if b == "pre_0_2" else m).alias("lo"), F.lit(m + span).alias("hi")) for b, m in TARGETS.items()])
    hour = lambda micros: F.floor(micros / 3_600_000_000)
    post, tick = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("post_time_at", "tick"))
    # Minutes to the post are whole seconds, so a tick up to a second before a window counts.
    began = (post - F.col("w.hi") * 60_000_000).cast("long") - 999_999
    posts = races.select("post_time_at").distinct().withColumn("w", F.explode(windows)).select("post_time_at", "w", began.alias("__at"), hour((post - F.col("w.lo") * 60_000_000).cast("long") + 999_999).alias("__end"))
    asked = posts.select(hour(F.col("__at")).alias("__hour"), "__at", F.lit(None).cast(ticks.schema["tick"].dataType).alias("tick"), "post_time_at", "w")
    given = ticks.where("tick IS NOT NULL").select(hour(tick).alias("__hour"), tick.alias("__at"), "tick", *[F.lit(None).cast(posts.schema[c].dataType).alias(c) for c in ("post_time_at", "w")])
    onward = Window.partitionBy("__hour").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = asked.unionByName(given).withColumn("tick", F.min("tick").over(onward)).where("w IS NOT NULL").select("post_time_at", "w", "tick")
    later = posts.withColumn("__hour", F.explode(F.sequence(hour(F.col("__at")), F.col("__end")))).where(F.col("__hour") > hour(F.col("__at")))
    later = later.join(given.groupBy("__hour").agg(F.min("tick").alias("tick")), "__hour").select("post_time_at", "w", "tick")
    first = same.unionByName(later).groupBy("post_time_at", "w").agg(F.min("tick").alias("tick"))
    first = first.withColumn("m", minutes_to_post(F.col("post_time_at"), F.col("tick"))).where("m >= w.lo AND m <= w.hi")
    return races.join(first.select("post_time_at", F.col("w.bucket").alias("bucket"), "tick"), "post_time_at").groupBy("race_id", "bucket").agg(F.min("tick").alias("tick"))


def bucketed(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("bucket", time_bucket(minutes_to_post(F.col("post_time_at"), F.col("snapshot_at"))))


def once_per_bucket(snapshots: DataFrame) -> DataFrame:
    """The first snapshot of each race, type and bucket; a stream gives them as they come."""
    keys = ["race_id", "bet_type", "bucket"]
    if snapshots.isStreaming:
        return bucketed(snapshots).withWatermark("snapshot_at", DELAY).dropDuplicatesWithinWatermark(keys)
    first = Window.partitionBy(*keys).orderBy("snapshot_at", "snapshot_id")
    return bucketed(snapshots).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def latest(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The newest fetched snapshot of each key; of equal times the larger id. One aggregation, merged before the shuffle."""
    newest = F.struct("snapshot_at", "snapshot_id", "odds")
    best = snapshots.where("status = 'fetched'").groupBy(*keys).agg(F.max(newest).alias("__b"))
    return best.select(*keys, "__b.snapshot_at", "__b.snapshot_id", "__b.odds")


def stream_latest(snapshots: DataFrame) -> DataFrame:
    """Latest odds of each race, horse and bucket, kept as state; late rows beyond the watermark are dropped."""
    return latest(bucketed(snapshots).withWatermark("snapshot_at", DELAY), ["race_id", "horse_number", "bucket"])


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives what it wrote; state and result stay in ``folder``, which all executors share."""
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").option("path", out).start()
    else:
        run = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def live_join(scored: DataFrame, latest_odds: DataFrame) -> DataFrame:
    """Scored rows with their latest odds where there are any, rank in race and expected value."""
    rank = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("pred_top3"), "horse_number"))
    df = scored.join(latest_odds, ["race_id", "horse_number"], "left")
    return df.withColumns({"pred_rank": rank, "expected_value": F.col("pred_top3") * F.col("odds")}).orderBy("date", "race_id", "pred_rank")
