"""Queries of rule evaluation."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import base
from paddock.operators import rules as r
from paddock.operators.rules import Rule
from paddock.operators.search import candidate_rules
from paddock.operators.search import rule_search as searched
from paddock.operators.splits import split_ratio
from paddock.plans.datasets import BASE
from paddock.plans.registry import query
from paddock.sources.adapter import Tables
from paddock.sources.scratch import kept, saved

PCTS = ("hit_pct", "return_min_pct", "return_mid_pct", "return_max_pct")
SUMS = "count(DISTINCT race_id) AS races, count(*) AS selections, CAST(coalesce(sum(target_top3), 0) AS BIGINT) AS hits, round(100.0 * sum(target_top3) / nullif(count(*), 0), 6) AS hit_pct, " + ", ".join(f"round(100.0::DOUBLE * sum(target_top3 * place_odds_{k}) / nullif(count(*), 0), 6) AS return_{k}_pct" for k in ("min", "mid", "max"))
S = ("s", "SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY pred_top3 DESC, horse_number) AS pred_rank, pred_top3 * place_odds_min AS expected_value_min, pred_top3 * place_odds_mid AS expected_value_mid FROM predictions")

# The named tiers.
TIERS = [
    Rule("high_return", 0.45, 3.0, 6.0, 1800, 2200),
    Rule("middle_turf", 0.35, 3.0, 5.0, 1800, 2200, surface_id=0),
    Rule("volume_tracks", 0.35, 3.0, 5.0, 1800, 2200, include_track_ids=(4, 5, 6, 8, 9)),
    Rule("high_return_no_horse_id", 0.45, 3.0, 6.0, 1800, 2200, exclude_track_ids=(3, 7, 10)),
]
GRID = r.grid([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6], [(1.0, 1.5), (1.5, 2.0), (2.0, 3.0), (3.0, 5.0), (5.0, 10.0), (10.0, 1000.0)])


def scored(t: Tables) -> DataFrame:
    return r.enriched(t.predictions)


def scored_once(t: Tables) -> DataFrame:
    """``scored`` with finish, win odds and horse, stored for queries that read it more than once."""
    return t.once("scored", lambda: saved(r.enriched(t.predicted)))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def condition(rule: Rule) -> str:
    """The rule as SQL text."""
    parts = [f"{c} {op} {v}" for c, op, v in (("pred_top3", ">=", rule.pred_min), ("place_odds_mid", ">=", rule.odds_min), ("place_odds_mid", "<", rule.odds_max), ("distance", ">=", rule.distance_min), ("distance", "<", rule.distance_max), ("surface_id", "=", rule.surface_id), ("pred_rank", "<=", rule.pred_rank_max), ("expected_value_mid", ">=", rule.ev_mid_min), ("max_rank", "<=", rule.max_rank_max), ("min_pred", ">=", rule.min_pred_min)) if v is not None]
    if rule.include_track_ids:
        parts.append(f"track_id IN {rule.include_track_ids}")
    if rule.exclude_track_ids:
        parts.append(f"NOT coalesce(track_id IN {rule.exclude_track_ids}, FALSE)")
    a, b = f"pred_top3 >= {rule.base_pred_min}", f"pred_top3_secondary >= {rule.secondary_pred_min}"
    parts += {None: [], "intersection": [f"({a} AND {b})"], "union": [f"({a} OR {b})"], "average": [f"(pred_top3 + pred_top3_secondary) / 2 >= {rule.avg_pred_min}"]}[rule.mode]
    return " AND ".join(parts) or "TRUE"


def taken(rules: list[Rule], source: str = "s") -> str:
    return " UNION ALL ".join(f"SELECT '{x.name}' AS rule, * FROM {source} WHERE {condition(x)}" for x in rules)


FIXED = Rule("fixed", 0.34, 1.5, 6.0, 1200, None, exclude_track_ids=(3, 7, 10), pred_rank_max=5, ev_mid_min=0.8)


@query(f"SELECT {SUMS} FROM s WHERE pred_top3 >= 0.4", S)
def sel_summary(t: Tables) -> DataFrame:
    return rounded(r.summary(scored(t).where("pred_top3 >= 0.4")))


#: The last fifth of the race days, without the day before it begins.
CUT = "SELECT d FROM (SELECT date AS d, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM base)) WHERE i = greatest(1, least(n - 1, CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT)))"
TESTED = ("tested", f"SELECT *, (place_odds_min + place_odds_max) / 2 AS place_odds_mid FROM base WHERE date >= ({CUT})")
BASELINES = ("popularity", "place_odds_min", "place_odds_mid")


@query(" UNION ALL ".join(f"SELECT '{c}' AS score, CAST(k AS INT) AS k, {SUMS} FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY {c}, horse_number) AS n FROM tested WHERE {c} IS NOT NULL) JOIN (SELECT unnest([1, 2, 3]) AS k) ON n <= k GROUP BY 2" for c in BASELINES), ("base", BASE), TESTED)
def base_topk(t: Tables) -> DataFrame:
    """The favourites by popularity and by odds, in the test period."""
    df = base.quoted_rows(t.quoted, t.race, t.horse).withColumn("place_odds_mid", (F.col("place_odds_min") + F.col("place_odds_max")) / 2)
    tested = kept(split_ratio(df, 0.2).where("part = 'test'"))
    return reduce(DataFrame.unionByName, [rounded(r.summary(r.top_k(tested, c, [1, 2, 3], ascending=True), "k")).withColumn("score", F.lit(c)) for c in BASELINES])


@query(" UNION ALL ".join(f"SELECT '{c}' AS score, CAST(k AS INT) AS k, {SUMS} FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY {c} DESC, horse_number) AS n FROM s WHERE {c} IS NOT NULL) JOIN (SELECT unnest([1, 2, 3]) AS k) ON n <= k GROUP BY 2" for c in ("pred_top3", "expected_value_min", "expected_value_mid")), S)
def strat_topk(t: Tables) -> DataFrame:
    parts = [rounded(r.summary(r.top_k(scored(t), c, [1, 2, 3]), "k")).withColumn("score", F.lit(c)) for c in ("pred_top3", "expected_value_min", "expected_value_mid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT threshold, {SUMS} FROM s JOIN (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6])::DOUBLE AS threshold) ON pred_top3 >= threshold GROUP BY 1", S)
def thr_report(t: Tables) -> DataFrame:
    return rounded(r.summary(r.above(scored(t), "pred_top3", [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]), "threshold"))


@query(f"SELECT CASE WHEN place_odds_mid < 1.5 THEN '0-1.5' WHEN place_odds_mid < 2 THEN '1.5-2' WHEN place_odds_mid < 3 THEN '2-3' WHEN place_odds_mid < 5 THEN '3-5' WHEN place_odds_mid < 10 THEN '5-10' ELSE '10-1000' END AS band, {SUMS} FROM s WHERE place_odds_mid >= 0 AND place_odds_mid < 1000 GROUP BY 1", S)
def band_report(t: Tables) -> DataFrame:
    return rounded(r.summary(r.banded(scored(t), "place_odds_mid", [0, 1.5, 2.0, 3.0, 5.0, 10.0, 1000.0]), "band"))


@query(f"SELECT race_id, horse_number, CAST(pred_rank AS INT) AS pred_rank FROM s WHERE {condition(FIXED)}", S)
def fixed_rule(t: Tables) -> DataFrame:
    return scored(t).where(r.predicate(FIXED)).select("race_id", "horse_number", "pred_rank")


@query("SELECT race_id, horse_number, CAST(pred_rank AS INT) AS pred_rank FROM s", S)
def race_rank(t: Tables) -> DataFrame:
    return t.predictions.select("race_id", "horse_number", r.race_rank().alias("pred_rank"))


@query(f"SELECT * FROM (SELECT rule, {SUMS} FROM taken GROUP BY 1) WHERE selections >= 20", S, ("taken", taken(GRID)))
def rule_grid(t: Tables) -> DataFrame:
    return rounded(r.summary(r.applied(scored(t), GRID), "rule")).where("selections >= 20").orderBy(F.desc("return_mid_pct"), F.desc("selections"))


BAND = "CASE WHEN distance < 1400 THEN 'under1400' WHEN distance < 1800 THEN '1400_1799' WHEN distance < 2200 THEN '1800_2199' ELSE '2200plus' END"
CONDS = {"track_id": "CAST(track_id AS VARCHAR)", "surface_id": "CAST(surface_id AS VARCHAR)", "distance_band": BAND, "race_size_band": "CASE WHEN race_size < 10 THEN 'small' WHEN race_size < 14 THEN 'medium' WHEN race_size < 19 THEN 'large' END"}


@query(" UNION ALL ".join(f"SELECT rule, '{n}' AS condition, {c} AS value, {SUMS} FROM taken GROUP BY 1, 3" for n, c in CONDS.items()), S, ("taken", taken(GRID)))
def rule_condition(t: Tables) -> DataFrame:
    from paddock.operators.history import distance_band

    conditions = {"track_id": F.col("track_id"), "surface_id": F.col("surface_id"), "distance_band": distance_band(F.col("distance")), "race_size_band": r.size_band(F.col("race_size"))}
    return rounded(r.broken_down(r.applied(scored(t), GRID), conditions, "rule"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS condition, {c} AS value, {SUMS} FROM s WHERE {condition(FIXED)} GROUP BY 2" for n, c in {"fold": "CAST(fold AS VARCHAR)", "month": "strftime(date, '%Y-%m')", "track": "CAST(track_id AS VARCHAR)", "surface": "CAST(surface_id AS VARCHAR)"}.items()), S)
def rule_breakdown(t: Tables) -> DataFrame:
    conditions = {"fold": F.col("fold"), "month": F.date_format("date", "yyyy-MM"), "track": F.col("track_id"), "surface": F.col("surface_id")}
    return rounded(r.broken_down(scored(t).where(r.predicate(FIXED)), conditions))


STABLE = "SELECT rule, count(*) AS folds, CAST(sum(selections) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, round(sum(ret * selections) / sum(selections), 6) AS return_mid_pct, round(min(ret), 6) AS min_fold_return_mid_pct, round(max(ret), 6) AS max_fold_return_mid_pct, min(selections) AS min_fold_selections, count(*) = 4 AS all_folds FROM per_fold GROUP BY 1"
PER_FOLD = ("per_fold", "SELECT rule, fold, count(*) AS selections, sum(target_top3) AS hits, 100.0::DOUBLE * sum(target_top3 * place_odds_mid) / count(*) AS ret FROM taken GROUP BY 1, 2")


@query(STABLE, S, ("taken", taken(GRID)), PER_FOLD)
def rule_stability(t: Tables) -> DataFrame:
    return rounded(r.stability(r.summary(r.applied(scored(t), GRID), "rule", "fold"), 4, "rule"))


@query(STABLE, S, ("taken", taken(TIERS)), PER_FOLD)
def tiers(t: Tables) -> DataFrame:
    return rounded(r.stability(r.summary(r.applied(scored(t), TIERS), "rule", "fold"), 4, "rule"))


@query("SELECT rule, race_id, date, horse_number, round(pred_top3, 6) AS pred_top3 FROM taken", S, ("taken", taken(TIERS)))
def tier_export(t: Tables) -> DataFrame:
    df = r.applied(scored(t), TIERS).orderBy("date", "race_id", "rule", F.desc("pred_top3"), "place_odds_mid")
    return rounded(df.select("rule", "race_id", "date", "horse_number", "pred_top3"))


@query(f"SELECT fold, {SUMS} FROM s WHERE {condition(FIXED)} GROUP BY GROUPING SETS ((fold), ())", S)
def fixed_rule_wf(t: Tables) -> DataFrame:
    df = scored(t).where(r.predicate(FIXED))
    return rounded(r.summary(df, "fold").unionByName(r.summary(df).withColumn("fold", F.lit(None).cast("int"))))


@query(f"SELECT race_id, horse_number FROM s WHERE {condition(replace(FIXED, ev_mid_min=1.0))} AND place_odds_mid IS NOT NULL", S)
def buy_rule_live(t: Tables) -> DataFrame:
    rule = r.load_rule({"pred_min": 0.34, "odds_min": 1.5, "odds_max": 6.0, "distance_min": 1200, "exclude_track_ids": [3, 7, 10], "pred_rank_max": 5}, {"ev_mid_min": 1.0})
    return scored(t).where("place_odds_mid IS NOT NULL").where(r.predicate(rule)).select("race_id", "horse_number")


SAMPLE_RULES = [x for i, x in enumerate(candidate_rules()) if i % 997 == 0]


@query("SELECT rule, races, selections, hits, return_mid_pct, min_fold_return_mid_pct FROM (SELECT rule, count(*) AS folds, CAST(sum(races) AS BIGINT) AS races, CAST(sum(selections) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, round(100.0 * sum(paid) / sum(selections), 6) AS return_mid_pct, round(min(100.0 * paid / selections), 6) AS min_fold_return_mid_pct, min(selections) AS least FROM (SELECT rule, fold, count(DISTINCT race_id) AS races, count(*) AS selections, sum(target_top3) AS hits, sum(target_top3 * place_odds_mid) AS paid FROM taken GROUP BY 1, 2) GROUP BY 1) WHERE folds = 4 AND selections >= 10 AND least >= 1", S, ("taken", taken(SAMPLE_RULES)))
def rule_search(t: Tables) -> DataFrame:
    """The search over a list that a SQL text can hold; ``rule_search_all`` runs the whole grid."""
    df = searched(scored_once(t), SAMPLE_RULES, min_selections=10, min_fold_selections=1)
    return rounded(df.select("rule", "races", "selections", "hits", "return_mid_pct", "min_fold_return_mid_pct"))


@query()
def rule_search_all(t: Tables) -> DataFrame:
    return rounded(searched(scored_once(t), candidate_rules(), min_selections=20, min_fold_selections=2)).limit(20)
