"""History against a plain day-by-day account, and small cases."""

import datetime as dt
from collections import defaultdict

from paddock.operators import coverage, history, relative, rules, splits
from paddock.sources import pages

DAY = [dt.date(2024, 1, d) for d in range(1, 6)]


def test_same_day_rows_never_see_each_other(spark):
    rows = [("h", DAY[0], "r1", 1, 1), ("h", DAY[0], "r2", 1, 0), ("h", DAY[1], "r3", 1, 1), ("h", DAY[4], "r4", 1, 0), (None, DAY[1], "r3", 2, 1), (None, DAY[4], "r4", 2, 0)]
    df = spark.createDataFrame(rows, "horse_id string, date date, race_id string, horse_number int, target_top3 int")
    got = {(r.horse_id, r.race_id): r for r in history.recent_before(history.cumulative_before(df, "x", ["horse_id"]), "x", "horse_id", 2, {"top3": "target_top3"}).collect()}
    assert [got["h", f"r{i}"].x_past_starts for i in (1, 2, 3, 4)] == [0, 0, 2, 3]
    assert [got["h", f"r{i}"].x_past_top3 for i in (1, 2, 3, 4)] == [0, 0, 1, 2]
    assert got[None, "r3"].x_past_starts == 0 and got[None, "r4"].x_past_starts == 1
    assert got["h", "r3"].x_recent2_top3_rate == 0.5 and got["h", "r2"].x_recent2_top3_rate is None


def test_relative_ranks_put_nulls_at_minus_one(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate((None, 2.0, 2.0, 5.0))], "race_id string, horse_number int, v double")
    got = {r.horse_number: r for r in relative.relative(df, {"v": True}).collect()}
    assert [got[i].race_v_rank for i in range(4)] == [1, 2.5, 2.5, 4]
    assert [got[i].race_v_diff for i in range(4)] == [None, -1, -1, 2]


def test_walk_split():
    assert splits.fold_starts(10, 4, 0.5) == [(5, 6), (6, 7), (7, 8), (8, None)]
    assert splits.ratio_cut(10, 0.2) == 8 and splits.ratio_cut(2, 0.99) == 1


def test_rule_keys_are_checked():
    assert rules.load_rule({"pred_min": 0.3, "exclude_track_ids": [1]}, {"pred_min": 0.4}).pred_min == 0.4
    try:
        rules.load_rule({"nope": 1})
    except ValueError:
        return
    raise AssertionError


def test_projection_runs_over_all_rows(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 3), ("d", 0)], "horse_id string, runner_rows long")
    got = {r.horse_id: (r["rank"], r.running) for r in coverage.projection(df).collect()}
    assert got == {"b": (1, 5), "a": (2, 8), "c": (3, 11), "d": (4, 11)}


def test_pages(spark):
    table = "<table><tr><th>No</th><th>Name</th></tr><tr><td>1</td><td>x</td></tr></table>"
    pedigree = "<table>" + "".join(f"<tr><td>a{i}</td><td>b{i}</td></tr>" for i in range(32)) + "</table>"
    df = spark.createDataFrame([(1, table), (2, pedigree), (3, "<p>none</p>"), (4, None)], "page_id long, html string")
    rows = {(r.page_id, r["row"]): r.cells for r in pages.html_rows(df).collect()}
    assert rows[1, 0] == {"No": "1", "Name": "x"} and (3, None) in rows and (4, None) in rows
    got = {r.page_id: r for r in pages.html_pedigree(df).collect()}
    assert (got[2].sire, got[2].dam, got[2].broodmare_sire, got[2].status) == ("a0", "a16", "b16", "fetched") and got[1].status == "failed"


def test_counts_by_key_equal_a_plain_account(spark):
    rows = [(f"h{i % 3}", DAY[(i * i) % 5], f"r{i}", i, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "horse_id string, date date, race_id string, horse_number int, target_top3 int")
    seen = defaultdict(list)
    for h, d, *_, hit in rows:
        seen[h].append((d, hit))
    for r in history.cumulative_before(df, "x", ["horse_id"]).collect():
        before = [hit for d, hit in seen[r.horse_id] if d < r.date]
        assert (r.x_past_starts, r.x_past_top3) == (len(before), sum(before))
