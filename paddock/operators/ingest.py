"""All-or-nothing acceptance, upserts and the pedigree queue, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accept(races: DataFrame, reasons: DataFrame, key: str = "race_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): races without any reason, and (key, reasons) of the others."""
    bad = reasons.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return races.join(bad, key, "left_anti"), bad


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins on the keys: an update replaces the base row, among updates the largest ``seq``."""
    last = updates.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("__n = 1").drop("__n", seq)
    return base.join(last, keys, "left_anti").unionByName(last)


def merge_names(base: DataFrame, new: DataFrame, new_first: bool, status: Column) -> DataFrame:
    """Horses of both sides; of two names the new or the old one counts first. New rows get ``status``."""
    fresh = new.where("horse_id <> ''").groupBy("horse_id").agg(F.max("horse_name").alias("new_name"))
    old, add = F.col("horse_name"), F.col("new_name")
    name = F.coalesce(add, old) if new_first else F.coalesce(old, add)
    both = base.join(fresh, "horse_id", "full")
    return both.select("horse_id", name.alias("horse_name"), F.coalesce("pedigree_fetch_status", status).alias("pedigree_fetch_status"))


def with_pedigree(base: DataFrame, fetched: DataFrame) -> DataFrame:
    """Pedigree columns and status overwritten where ``fetched`` has the horse; a fetched name counts first."""
    update = fetched.select("horse_id", *[F.col(c).alias(f"__{c}") for c in ("horse_name", "sire_id", "dam_id", "broodmare_sire_id", "pedigree_fetch_status")])
    joined = base.join(update, "horse_id", "left")
    hit = F.col("__pedigree_fetch_status").isNotNull()
    take = lambda c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("horse_id", F.coalesce("__horse_name", "horse_name").alias("horse_name"), *[take(c) for c in ("sire_id", "dam_id", "broodmare_sire_id", "pedigree_fetch_status")])


def pedigree_queue(horses: DataFrame, runners: DataFrame, limit: int, failed_too: bool = False) -> DataFrame:
    """The next horses to fetch, those with most runner rows first."""
    states = ["pending", "failed"] if failed_too else ["pending"]
    n = runners.groupBy("horse_id").agg(F.count(F.lit(1)).alias("runner_rows"))
    waiting = horses.where(F.col("pedigree_fetch_status").isin(states)).join(n, "horse_id", "left").withColumn("runner_rows", F.coalesce("runner_rows", F.lit(0)))
    return waiting.orderBy(F.desc("runner_rows"), "horse_id").limit(limit).select("horse_id", "horse_name", "runner_rows")


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Appends headers of all snapshots and the detail rows of fetched ones, under a key made of race, type and time; headers lie by day."""
    keyed = snapshots.withColumn("snapshot_key", F.xxhash64("race_id", "bet_type", "snapshot_at"))
    keyed.select("snapshot_id", "snapshot_key", "race_id", "bet_type", "snapshot_at", "status", F.to_date("snapshot_at").alias("day")).write.mode("append").partitionBy("day").parquet(f"{path}/header")
    keyed.where("status = 'fetched'").select("snapshot_id", "snapshot_key", "horse_number", "odds").write.mode("append").parquet(f"{path}/detail")
