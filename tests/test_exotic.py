"""Consensus and searches on small tables, against plain accounts."""

import random
from dataclasses import replace
from types import SimpleNamespace

from paddock.operators import portfolio, search
from paddock.plans import exotic
from paddock.plans.registry import ORACLE_SQL, QUERIES

COLUMNS = "race_id string, horse_number int, date string, fold int, track_id int, surface_id int, distance int, target_top3 int, pred_top3 double, pred_top3_secondary double, place_odds_min double, place_odds_mid double, place_odds_max double"


def test_consensus_has_every_runner_that_both_sets_have(spark):
    rows = [("a", n, "2024-01-01", 1, 5, 0, 2000, n % 2, 0.9 - n / 20, 0.8 - n / 20, 2.0, 3.0, 4.0) for n in range(1, 18)]
    df = spark.createDataFrame(rows, COLUMNS)
    both = exotic.both(SimpleNamespace(predictions=df)).collect()
    assert sorted((r.horse_number, round(r.pred_top3_mean, 6)) for r in both) == [(n, round(0.85 - n / 20, 6)) for n in range(1, 18)]
    second = df.where("horse_number % 3 <> 0").union(df.where("horse_number = 1").replace("a", "b", "race_id"))
    assert sorted(r.horse_number for r in portfolio.consensus(df.drop("pred_top3_secondary"), second).collect()) == [n for n in range(1, 18) if n % 3]


def test_whole_grids_are_searched_and_equal_plain_loops(spark):
    grids = {"wide": search.wide_rules(), "trio": search.trio_rules(), "cons": search.consensus_rules()}
    assert {k: len({r.name for r in v}) for k, v in grids.items()} == {"wide": 53_472, "trio": 33_168, "cons": 85_176}
    assert all(len({replace(r, name="") for r in v}) == len(v) for v in grids.values())
    assert {r.mode for r in grids["cons"]} == {"union", "intersection", "average"}
    assert {f"{k}_search_all" for k in grids} <= QUERIES.keys() - ORACLE_SQL.keys()
    dice = random.Random(5)
    names = ["race_id", "fold", "target_top3", "pred_top3", "pred_top3_secondary", "place_odds_mid", "distance", "track_id", "surface_id", "pred_rank", "max_rank", "min_pred", "expected_value_mid"]
    rows = []
    for i in range(300):
        score, odds = dice.random() * 0.6, dice.choice([3.5, 4.5, 12.0, 30.0, 60.0])
        rows.append((f"r{i // 6}", i // 6 % 2, i % 2, score, dice.random(), odds, dice.choice([1200, 1800, 2400]), dice.randint(1, 10), i % 2, dice.randint(1, 20), dice.randint(2, 12), dice.random() * 0.5, score * odds))
    df = spark.createDataFrame(rows, names)
    rules = [*grids["wide"][::2500], *grids["wide"][-12:], *grids["trio"][::2500], *grids["trio"][-200::40], *grids["cons"][::4000], *grids["cons"][-3000::900]]
    got = {(r.rule, r.fold): (r.races, r.selections, r.hits, round(r.paid, 6)) for r in search.eval_rules(df, rules).collect()}
    want = {}
    for rule in rules:
        for fold in (0, 1):
            own = [d for d in (dict(zip(names, row)) for row in rows) if d["fold"] == fold and takes(rule, d)]
            if own:
                want[rule.name, fold] = (len({d["race_id"] for d in own}), len(own), sum(d["target_top3"] for d in own), round(sum(d["target_top3"] * d["place_odds_mid"] for d in own), 6))
    assert want and got == want


def takes(r, d):
    least = [(d["pred_top3"], r.pred_min), (d["place_odds_mid"], r.odds_min), (d["distance"], r.distance_min), (d["expected_value_mid"], r.ev_mid_min), (d["min_pred"], r.min_pred_min)]
    most = [(d["pred_rank"], r.pred_rank_max), (d["max_rank"], r.max_rank_max)]
    a, b = d["pred_top3"], d["pred_top3_secondary"]
    scores = {None: lambda: True, "union": lambda: a >= r.base_pred_min or b >= r.secondary_pred_min, "intersection": lambda: a >= r.base_pred_min and b >= r.secondary_pred_min, "average": lambda: (a + b) / 2 >= r.avg_pred_min}
    return (
        all(v >= x for v, x in least if x is not None) and all(v <= x for v, x in most if x is not None) and d["place_odds_mid"] < r.odds_max and (r.distance_max is None or d["distance"] < r.distance_max)
        and (r.surface_id is None or d["surface_id"] == r.surface_id) and (r.include_track_ids is None or d["track_id"] in r.include_track_ids) and (r.exclude_track_ids is None or d["track_id"] not in r.exclude_track_ids) and scores[r.mode]()
    )


def test_all_named_consensus_rules_are_judged():
    assert len({q.name for q in exotic.CONSENSUS}) == 14 and {q.mode for q in exotic.CONSENSUS} == {"union", "intersection", "average"}
