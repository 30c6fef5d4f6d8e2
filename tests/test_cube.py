"""Rule search over cells against plain loops and the walk over rules."""

import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import cube, search

NAMES = "race_id string, fold int, target_top3 int, pred_top3 double, place_odds_min double, place_odds_mid double, place_odds_max double, distance int, track_id int, surface_id int, pred_rank int, expected_value_mid double"


def some_rows(n=1500):
    dice, rows = random.Random(6), []
    none = lambda x: None if dice.random() < 0.03 else x
    for i in range(n):
        p, o = dice.choice([0.3, 0.32, 0.35, 0.41, 0.6, dice.random()]), dice.choice([2.0, 2.5, 3.0, 3.3, 5.0, 6.5, 9.99])
        rows.append((f"r{i // 6}", i // 6 % 3, none(dice.randint(0, 1)), none(p), o - 0.5, none(o), o + 0.5, none(dice.choice([1000, 1200, 1400, 1700, 1800, 2200, 2400])), none(dice.randint(1, 10)), none(dice.randint(0, 2)), dice.randint(1, 9), none(p * o)))
    return rows


def fields_of(dims, number):
    out = {}
    for d in reversed(dims):
        number, i = divmod(number, len(d.options))
        out |= d.options[i]
    return out


def takes(rule, r):
    fold, hit, p, low, o, high, distance, track, surface, rank, ev = r[1:]
    some, none = cube.TRACKS[rule["track_label"]]
    ok = p is not None and p >= rule["pred_min"] and o is not None and rule["odds_min"] <= o < rule["odds_max"]
    ok = ok and (rule["distance_min"] is None or distance is not None and distance >= rule["distance_min"]) and (rule["distance_max"] is None or distance is not None and distance < rule["distance_max"])
    ok = ok and (some is None or track in some) and (none is None or track not in none) and (rule["surface_id"] is None or surface == rule["surface_id"])
    return ok and (rule["pred_rank_max"] is None or rank <= rule["pred_rank_max"]) and (rule["ev_mid_min"] is None or ev is not None and ev >= rule["ev_mid_min"])


def test_grids_have_all_rules(spark):
    assert {k: cube.size_of(cube.grid(*v)) for k, v in cube.PROFILES.items()} == {"place": 315_000, "win": 169_344}


def test_sums_equal_loops_over_all_rules(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, NAMES)
    dims = cube.grid(*cube.PROFILES["place"])
    got = {(r.rule, r.fold): (r.selections, r.hits, r.paid_min, r.paid_mid, r.paid_max) for r in cube.rule_sums(df, dims).collect()}
    dice = random.Random(1)
    numbers = {*dice.sample(range(cube.size_of(dims)), 150), *dice.sample(sorted({n for n, _ in got}), 150)}
    for number in numbers:
        rule = fields_of(dims, number)
        for fold in range(3):
            own = [r for r in rows if r[1] == fold and takes(rule, r)]
            money = lambda k: sum(round(r[k] * 1_000_000) for r in own if r[2] == 1)  # noqa: E731, B023
            want = (len(own), sum(r[2] or 0 for r in own), money(4), money(5), money(6)) if own else None
            assert got.get((number, fold)) == want, rule


def test_search_equals_the_walk_over_rules(spark):
    df = spark.createDataFrame(some_rows(3000), NAMES).where("target_top3 IS NOT NULL")
    preds, odds, distances = (0.3, 0.35, 0.4), ((2.0, 3.0), (2.5, 6.0), (3.0, 10.0)), ((None, None), (1400, 2200), (2200, None))
    dims = cube.grid(preds, odds, distances, (None, 4), (None, 1.2))
    names = {tuple(v.items()): k for k, v in enumerate(fields_of(dims, n) for n in range(cube.size_of(dims)))}
    rules = []
    for fields, number in names.items():
        f = dict(fields)
        some, none = cube.TRACKS[f.pop("track_label")]
        rules.append(search.Rule(str(number), include_track_ids=some, exclude_track_ids=none, **f))
    gates = {"min_selections": 30, "min_fold_selections": 5, "min_fold_return": 50.0, "buy_rate": (0.01, 99.0)}
    want = search.rule_search(df, rules, **gates).collect()
    got = cube.search(df, dims, **gates, top=None).collect()
    keys = ("races", "selections", "hits", "return_mid_pct", "min_fold_return_mid_pct", "max_fold_return_mid_pct", "min_fold_selections", "buy_rate_pct")
    plain = lambda rows: {int(r.rule): pytest.approx(tuple(r[k] for k in keys), abs=1e-5) for r in rows}
    assert len(want) > 50 and {int(r.rule): tuple(r[k] for k in keys) for r in got} == plain(want)
    top = cube.search(df, dims, **gates | {"buy_rate": (None, None)}, top=7).collect()
    assert [r.return_mid_pct for r in top] == sorted((r.return_mid_pct for r in got), reverse=True)[:7] or len(got) < 7
    assert all(r.rule_key.startswith(f"pred>={r.pred_min:.2f}|odds=[{r.odds_min:.1f},") for r in top)
    assert cube.search(df.where("false"), dims).count() == 0


def test_rows_without_a_fold_are_in_no_rule(spark):
    df = spark.createDataFrame(some_rows(60), NAMES).withColumn("fold", F.lit(None).cast("int"))
    assert cube.search(df, cube.grid((0.3,), ((2.0, 10.0),), ((None, None),)), 1, 1).count() == 0
