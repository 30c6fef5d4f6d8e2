"""Point-in-time joins against a loop over all facts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import asof

START = dt.datetime(2024, 5, 1)


def newest(facts, key, at):
    own = [(when, tie, odds) for k, when, tie, odds in facts if k == key and None not in key and when is not None and at is not None and when <= at]
    return max(own, key=lambda x: (x[0], x[1]), default=(None, None, None))


@pytest.mark.parametrize("block", [1, 600, 3600, 10**7])
def test_newest_fact_not_after_each_row(spark, block):
    rng = random.Random(3)
    time = lambda: None if rng.random() < 0.02 else START + dt.timedelta(seconds=60 * rng.randrange(3000))
    key = lambda: ("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([1, 2, None]))
    facts = [(key(), time(), i % 7 * 100 + i, None if rng.random() < 0.1 else i / 2) for i in range(400)]
    rows = [(i, *key(), time()) for i in range(400)] + [(5, "hot", 1, START)] * 2
    f = spark.createDataFrame([(*k, w, t, o) for k, w, t, o in facts], "race string, horse int, snapshot_at timestamp, snapshot_id int, odds double")
    r = spark.createDataFrame(rows, "id int, race string, horse int, asked_at timestamp").withColumn("kind", F.lit("own"))
    got = asof.as_of(r, f, ["race", "horse"], "asked_at", "snapshot_at", "snapshot_id", ["snapshot_id", "odds"], block)
    assert got.columns == [*r.columns, "snapshot_at", "snapshot_id", "odds"]
    want = sorted(map(repr, ((i, a, h, at, *newest(facts, (a, h), at)) for i, a, h, at in rows)))
    assert sorted(map(repr, ((x.id, x.race, x.horse, x.asked_at, x.snapshot_at, x.snapshot_id, x.odds) for x in got.collect()))) == want
    assert got.where("snapshot_at > asked_at").count() == 0


def test_later_facts_change_nothing(spark):
    f = spark.createDataFrame([("a", START, 1, 2.0)], "race string, snapshot_at timestamp, snapshot_id int, odds double")
    late = spark.createDataFrame([("a", START + dt.timedelta(seconds=61), 9, 99.0)], f.schema)
    r = spark.createDataFrame([("a", START + dt.timedelta(seconds=60)), ("a", START - dt.timedelta(seconds=1))], "race string, asked_at timestamp")
    join = lambda facts: sorted(map(repr, asof.as_of(r, facts, ["race"], "asked_at", "snapshot_at", "snapshot_id", ["odds"]).collect()))
    assert join(f) == join(f.union(late)) and asof.as_of(r, f.where("false"), ["race"], "asked_at", "snapshot_at", "snapshot_id", ["odds"]).where("odds IS NULL").count() == 2
