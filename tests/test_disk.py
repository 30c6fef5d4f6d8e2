"""What queries leave on disk: shuffle files, rows shuffled more than once, rows made for sums alone."""

import datetime as dt
import re
import time

from pyspark.sql import functions as F

from paddock.operators import cube
from paddock.operators import history as h
from paddock.operators import portfolio as p
from paddock.plans.datasets import rows
from paddock.plans.rules import scored_once
from paddock.sources.adapter import Tables
from paddock.sources.scratch import saved

DATA = "/root/testdata/sf0.001"


def shuffle_files(spark) -> set:
    """The shuffle files that the block manager has now."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = saved(spark.range(1000).withColumn("k", F.col("id") % 7).repartition("k"))
    assert df.count() == 1000
    until = time.time() + 20
    while (left := {b for b in shuffle_files(spark) - before if "data" in b or "index" in b}) and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 2  # the count's own


def test_lineitem_is_dealt_once(spark):
    for df in (rows(Tables(spark, DATA)), Tables(spark, DATA).predictions):
        assert len(re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", plan(df))) == 1
    t = Tables(spark, DATA)
    assert scored_once(t) is scored_once(t)


def test_portfolios_by_masks_equal_a_row_for_each_bet_and_portfolio(spark):
    bets = [(f"r{i % 7}", i % 3, "x", f"s{i % 5}", str(i), 100.0, i % 2, 2.0 + i, (i % 2) * (2.0 + i) * 100) for i in range(60)]
    df = spark.createDataFrame(bets, "race_id string, fold int, bet_type string, strategy string, selection_key string, stake double, hit int, odds double, payout double")
    members = {"one": ["s0"], "two": ["s0", "s3"], "all": ["s0", "s1", "s2", "s3", "s4"], "none": ["gone"]}
    show = lambda out: {r.portfolio: tuple(round(v, 6) for v in r[1:]) for r in out.select("portfolio", "races", "selections", "hits", "roi_pct", "min_fold_roi_pct", "buy_rate_pct", "hit_pct").collect()}
    assert show(p.portfolio_summary(df, 7, members)) == show(p.bet_summary(p.in_portfolios(df, members), 7, "portfolio"))
    assert "Generate" not in plan(p.portfolio_summary(df, 7, members))


def racing(spark):
    day = [dt.date(2024, 1, d) for d in range(1, 9)]
    made = [(f"r{i % 20}", i, None if i % 11 == 0 else f"h{i % 4}", f"j{i % 3}", day[(i * 5) % 8], i % 3, 1000 + i % 5, i % 2, 1 + i % 6) for i in range(120)]
    return spark.createDataFrame(made, "race_id string, horse_number int, horse_id string, jockey_id string, date date, track_id int, distance int, target_top3 int, finish int")


def test_histories_of_several_ids_equal_one_after_the_other(spark):
    df = racing(spark)
    steps = [
        {"lead": "horse_id", "specs": [h.spec("horse", means={"finish": "finish"}), h.spec("horse_track", "track_id")], "recents": [(3, {"top3": "target_top3", "finish": "finish"})], "last": True},
        {"lead": "jockey_id", "specs": [], "recents": [(5, {"finish": "finish"})]},
        {"lead": "horse_id", "specs": [h.spec("known")], "missing": h.missing_key(["horse_id"])},
    ]
    want = df
    for step in steps:
        want = h.history_before(want, **step, source=df)
    got = h.histories(h.numbered(df), steps)
    assert sorted(got.columns) == sorted(want.columns) and got.count() == 120
    assert got.select(*want.columns).exceptAll(want).count() == want.exceptAll(got.select(*want.columns)).count() == 0


def test_last_rows_go_no_further_than_their_window(spark):
    df = racing(spark)
    days = h.last_rows(df, "horse_id", [(3, {"finish": "finish"})], True, "horse")
    assert [kind for _, kind in days.dtypes if "array" in kind] == []
    joined = plan(h.history_before(df, "horse_id", [h.spec("horse")], [(3, {"finish": "finish"})]))
    assert not [x for x in joined.split("\n") if "Exchange" in x and "__tail" in x]


def test_races_of_rules_are_counted_where_a_race_lies(spark):
    dims = cube.grid([0.1, 0.2], [(1.0, 3.0), (2.0, 9.0)], [(None, None)])
    df = spark.createDataFrame([(f"r{i % 9}", 0.05 * (i % 6), 1.0 + i % 5, 1200, 1 + i % 3, 0, 1 + i % 4, 0.5) for i in range(90)], "race_id string, pred_top3 double, place_odds_mid double, distance int, track_id int, surface_id int, pred_rank int, expected_value_mid double")
    found = cube.races_of(df, dims, spark.range(cube.size_of(dims)).withColumnRenamed("id", "rule"))
    got = {r.rule: r.races for r in found.collect()}
    flat = [r.asDict() for r in df.collect()]
    for i, (pred, low, high) in enumerate((a, *b) for a in (0.1, 0.2) for b in ((1.0, 3.0), (2.0, 9.0))):
        at = i * (cube.size_of(dims) // 4)  # all tracks, surfaces and ranks
        assert got.get(at, 0) == len({r["race_id"] for r in flat if r["pred_top3"] >= pred and low <= r["place_odds_mid"] < high})
    assert not re.search(r"Exchange hashpartitioning\(rule#\d+L?, race_id", plan(found))
