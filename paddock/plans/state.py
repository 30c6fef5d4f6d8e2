"""Queries of upserts and state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import ingest
from paddock.plans.registry import query
from paddock.sources.adapter import Tables
from paddock.sources.scratch import folder


@query(
    "SELECT race_id, horse_number, odds FROM (SELECT *, row_number() OVER (PARTITION BY race_id, horse_number ORDER BY seq DESC) AS n FROM both_sides) WHERE n = 1",
    ("both_sides", "SELECT race_id, horse_number, odds, -1 AS seq FROM win_odds UNION ALL SELECT race_id, horse_number, round(odds + 1, 6), horse_number FROM win_odds WHERE horse_number < 3 UNION ALL SELECT race_id, horse_number, round(odds + 2, 6), horse_number + 100 FROM win_odds WHERE horse_number < 2"),
)
def upsert(t: Tables) -> DataFrame:
    w = t.win_odds
    one = w.where("horse_number < 3").withColumns({"odds": F.round(F.col("odds") + 1, 6), "seq": F.col("horse_number")})
    two = w.where("horse_number < 2").withColumns({"odds": F.round(F.col("odds") + 2, 6), "seq": F.col("horse_number") + 100})
    return ingest.upsert(w, one.union(two), ["race_id", "horse_number"], "seq")


OLD = "SELECT horse_id, CASE WHEN CAST(horse_id AS INT) % 4 = 0 THEN NULL ELSE horse_name END AS horse_name, pedigree_fetch_status FROM horse WHERE CAST(horse_id AS INT) % 3 <> 0"
SEEN = "SELECT horse_id, max(name) AS new_name FROM (SELECT horse_id, CASE WHEN age = 4 THEN NULL ELSE concat('run', trainer_id) END AS name FROM runner_raw) WHERE horse_id <> '' GROUP BY horse_id"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    number = F.col("horse_id").cast("int")
    old = t.horse.where(number % 3 != 0).select("horse_id", F.when(number % 4 == 0, None).otherwise(F.col("horse_name")).alias("horse_name"), "pedigree_fetch_status")
    return old, t.runner_raw.select("horse_id", F.when(F.col("age") == 4, None).otherwise(F.concat(F.lit("run"), "trainer_id")).alias("horse_name"))


@query("SELECT coalesce(o.horse_id, s.horse_id) AS horse_id, coalesce(new_name, horse_name) AS horse_name, coalesce(pedigree_fetch_status, 'pending') AS pedigree_fetch_status FROM old_side o FULL JOIN seen s ON o.horse_id = s.horse_id", ("old_side", OLD), ("seen", SEEN))
def horse_pending(t: Tables) -> DataFrame:
    return ingest.merge_names(*_sides(t), True, F.lit("pending"))


@query("SELECT coalesce(o.horse_id, s.horse_id) AS horse_id, coalesce(horse_name, new_name) AS horse_name, coalesce(pedigree_fetch_status, 'pending') AS pedigree_fetch_status FROM old_side o FULL JOIN seen s ON o.horse_id = s.horse_id", ("old_side", OLD), ("seen", SEEN))
def horse_backfill(t: Tables) -> DataFrame:
    return ingest.merge_names(*_sides(t), False, F.lit("pending"))


@query("SELECT horse_id, horse_name, CASE WHEN hit THEN concat('s', horse_id) ELSE sire_id END AS sire_id, CASE WHEN hit THEN NULL ELSE dam_id END AS dam_id, CASE WHEN hit THEN 'b' ELSE broodmare_sire_id END AS broodmare_sire_id, CASE WHEN hit THEN 'fetched' ELSE pedigree_fetch_status END AS pedigree_fetch_status FROM (SELECT *, pedigree_fetch_status = 'pending' AS hit FROM horse)")
def pedigree_update(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    fetched = t.horse.where("pedigree_fetch_status = 'pending'").select("horse_id", none.alias("horse_name"), F.concat(F.lit("s"), "horse_id").alias("sire_id"), none.alias("dam_id"), F.lit("b").alias("broodmare_sire_id"), F.lit("fetched").alias("pedigree_fetch_status"))
    return ingest.with_pedigree(t.horse, fetched)


@query("SELECT h.horse_id, horse_name, coalesce(n, 0) AS runner_rows FROM horse h LEFT JOIN (SELECT horse_id, count(*) AS n FROM runner GROUP BY 1) r ON h.horse_id = r.horse_id WHERE pedigree_fetch_status IN ('pending', 'failed') ORDER BY runner_rows DESC, h.horse_id LIMIT 50")
def pedigree_queue(t: Tables) -> DataFrame:
    return ingest.pedigree_queue(t.horse, t.runner, 50, failed_too=True)


@query("SELECT race_id, bet_type, CAST(snapshot_at AS DATE) AS day, count(*) AS snapshots, count(DISTINCT (race_id, bet_type, snapshot_at)) AS snapshot_keys, count(*) FILTER (status = 'fetched') AS detail_rows, round(sum(CASE WHEN status = 'fetched' THEN odds END), 6) AS odds FROM snapshots GROUP BY 1, 2, 3")
def snapshot_append(t: Tables) -> DataFrame:
    """Snapshots appended to a stored table in two writes, headers of all and details of the fetched ones, read back by day."""
    at = f"{folder(t.spark)}/snapshots-{uuid.uuid4().hex}"
    early = F.pmod("snapshot_id", F.lit(2)) == 0
    for part in (t.snapshots.where(early), t.snapshots.where(~early)):
        ingest.append_snapshots(part, at)
    header, detail = (t.spark.read.parquet(f"{at}/{name}") for name in ("header", "detail"))
    both = header.join(detail, ["snapshot_id", "snapshot_key"], "left")
    return both.groupBy("race_id", "bet_type", F.to_date("snapshot_at").alias("day")).agg(
        F.count(F.lit(1)).alias("snapshots"), F.countDistinct("snapshot_key").alias("snapshot_keys"), F.count("horse_number").alias("detail_rows"), F.round(F.sum("odds"), 6).alias("odds")
    )


@query("SELECT race_id FROM race WHERE race_id NOT IN (SELECT race_id FROM runner WHERE horse_number = 4)")
def new_ids(t: Tables) -> DataFrame:
    return t.race.select("race_id").join(t.runner.where("horse_number = 4"), "race_id", "left_anti")
