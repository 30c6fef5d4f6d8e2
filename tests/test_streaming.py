"""Streams leave their state and results in the shared folder."""

import datetime as dt
import os
import random

import paddock.plans  # noqa: F401
from paddock.plans.registry import QUERIES
from paddock.sources.scratch import folder
from paddock.streaming import merge, odds

DATA = "/root/testdata/sf0.001"


def test_streams_write_to_the_shared_folder(spark):
    top = folder(spark).removeprefix("file:")
    for name in ("stream_bucket_odds", "stream_late"):
        before = {t.name for t in spark.catalog.listTables()}, set(os.listdir(top))
        rows = QUERIES[name](spark, DATA).count()
        new = [d for d in set(os.listdir(top)) - before[1] if d.startswith("stream-")]
        assert rows > 0 and len(new) == 1 and {"checkpoint"} < set(os.listdir(f"{top}/{new[0]}"))
        assert {t.name for t in spark.catalog.listTables()} == before[0]


SCHEMA = "snapshot_id long, race_id string, horse_number int, bet_type string, status string, snapshot_at timestamp, post_time_at timestamp, odds double"
START = dt.datetime(2024, 5, 1)


def snapshot(i, race, hours, odds, status="fetched", horse=1):
    return i, race, horse, "win", status, START + dt.timedelta(hours=hours), START + dt.timedelta(hours=hours + 3), odds


def files(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def contents(table):
    return sorted((r.race_id, r.horse_number, r.newest.snapshot_id, r.newest.odds) for r in table.read().collect())


def test_a_stream_is_merged_into_touched_parts_and_late_rows_are_dropped(spark, tmp_path):
    first = [snapshot(1, "a", 1, 2.0), snapshot(2, "a", 2, 2.5), snapshot(3, "b", 1, 3.0), snapshot(4, "a", 3, None, "failed"), snapshot(5, "c", 100, 9.0)]
    second = [snapshot(6, "a", 5, 7.0), snapshot(7, "c", 99, 8.0), snapshot(8, "c", 101, 9.5), snapshot(9, "d", 90, 4.0)]  # the first is of a day gone by
    middle = [snapshot(10, "c", 98, 8.0), snapshot(11, "b", 3, 3.5)]  # lateness is judged by the watermark of the batch before, so here nothing is late yet
    table, progress = merge.merge_stream(files(spark, str(tmp_path / "in"), first, middle, second), str(tmp_path / "out"), "1 day", 4)
    assert contents(table) == [("a", 1, 2, 2.5), ("b", 1, 11, 3.5), ("c", 1, 8, 9.5), ("d", 1, 9, 4.0)]
    assert [p.rows for p in progress if p.rows] == [5, 2, 4] and [p.late for p in progress if p.rows] == [0, 0, 1]
    states = [p.state for p in progress]
    assert max(states) == 3 and states[-1] == 2  # the first day's keys are gone, c and d stay


def test_a_replayed_batch_changes_nothing_and_untouched_parts_stay(spark, tmp_path):
    table = merge.MergedTable(spark, str(tmp_path), 4)
    batch = lambda rows: merge.updates(spark.createDataFrame(rows, SCHEMA))
    races = [f"r{i}" for i in range(12)]
    one = batch([snapshot(i, r, 1, float(i)) for i, r in enumerate(races)])
    two = batch([snapshot(100, "r0", 2, 50.0), snapshot(101, "r1", 0, 60.0)])
    table.merge(one, 0)
    before = table.versions()
    table.merge(two, 1)
    want = contents(table)
    touched = {part for part, batches in table.versions().items() if batches[-1] == 1}
    assert set(before) == {0, 1, 2, 3} and 0 < len(touched) < 4 and all(table.versions()[p] == [0] for p in set(before) - touched)
    table.merge(two, 1)
    assert contents(table) == want and dict((r, s) for r, _, s, _ in want)["r0"] == 100 and dict((r, s) for r, _, s, _ in want)["r1"] == 1
    table.merge(batch([snapshot(200, "r0", 9, 1.0)]), 2)
    assert max(map(len, table.versions().values())) == 2  # the one before stays for a replay
    table.merge(one.where("false"), 3)
    assert dict((r, s) for r, _, s, _ in contents(table))["r0"] == 200


def test_headers_and_details_join_in_time_and_waiting_ones_are_dropped(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    headers = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(5)), (9, "z", at(60 * 72))], "snapshot_id long, race_id string, snapshot_at timestamp")
    details = spark.createDataFrame([(1, at(4), 2.0), (1, at(30), 3.0), (2, at(5), 4.0), (3, at(6), 5.0), (9, at(60 * 72), 6.0)], "snapshot_id long, detail_at timestamp, odds double")
    for name, df in (("h", headers), ("d", details)):
        for k in range(2):
            df.where("snapshot_id < 9" if k == 0 else "snapshot_id = 9").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out, progress = merge.join_stream(read(headers, "h"), read(details, "d"), str(tmp_path / "o"), "1 hour")
    rows = lambda df: sorted((r.snapshot_id, r.race_id, r.odds) for r in df.collect())
    assert rows(out) == rows(merge.joined(headers, details)) == [(1, "a", 2.0), (2, "b", 4.0), (9, "z", 6.0)]
    assert progress[-1].state < max(p.state for p in progress)


def test_windows_before_midnight_are_met_on_the_day_before(spark):
    post = dt.datetime(2024, 5, 2, 0, 30)
    ticks = [post - dt.timedelta(minutes=m) for m in (123, 121, 61, 30, 14, 5, 1)]
    rows = odds.due(spark.createDataFrame([(x,) for x in ticks], "tick timestamp"), spark.createDataFrame([("a", post), ("b", None)], "race_id string, post_time_at timestamp"), 300).collect()
    got = {r.bucket: int((post - r.tick).total_seconds() / 60) for r in rows}
    assert got == {"over_120": 123, "pre_60_120": 61, "pre_30_60": 30, "pre_5_15": 5, "pre_2_5": 5, "pre_0_2": 5} and {r.race_id for r in rows} == {"a"}


def test_due_meets_ticks_once_for_all_races_of_a_post(spark):
    dice, noon = random.Random(3), dt.datetime(2024, 1, 2, 0, 40)
    ticks = sorted({noon + dt.timedelta(seconds=dice.randint(-12_000, 3_000), microseconds=dice.choice([0, 0, 400_000])) for _ in range(90)})
    posts = {f"r{i}": noon + dt.timedelta(minutes=7 * (i % 5)) for i in range(40)}
    ticks_df, races = spark.createDataFrame([(x,) for x in ticks], "tick timestamp"), spark.createDataFrame([*posts.items()], "race_id string, post_time_at timestamp")
    want = {}
    for race, post in posts.items():
        for bucket, minute in odds.TARGETS.items():
            low = 0.0 if bucket == "pre_0_2" else minute
            if met := [x for x in ticks if low <= int((post - x).total_seconds()) / 60 <= minute + 5]:
                want[race, bucket] = min(met)
    due = odds.due(ticks_df, races, 300)
    assert {(r.race_id, r.bucket): r.tick for r in due.collect()} == want
    assert "Aggregate [post_time_at" in due._jdf.queryExecution().optimizedPlan().toString()  # windows of distinct posts
