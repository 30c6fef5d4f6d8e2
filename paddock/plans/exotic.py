"""Queries of pairs, triples, consensus and portfolios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import exotic as x
from paddock.operators import portfolio as p
from paddock.operators import rules as r
from paddock.operators.rules import Rule
from paddock.operators.search import consensus_rules, trio_rules, wide_rules
from paddock.operators.search import rule_search as searched
from paddock.plans.registry import query
from paddock.plans.rules import STABLE, SUMS, TIERS, PER_FOLD, S, condition, rounded, scored, scored_once, taken
from paddock.sources.adapter import Tables
from paddock.sources.scratch import freed, saved

PAIR = ("pair", "SELECT o.*, a.date, a.fold, a.track_id, a.surface_id, a.distance, least(a.target_top3, b.target_top3) AS target_top3, a.pred_top3 * b.pred_top3 AS score, least(a.pred_top3, b.pred_top3) AS min_pred, greatest(a.pred_rank, b.pred_rank) AS max_rank, (odds_min + odds_max) / 2 AS place_odds_mid FROM wide_odds o JOIN s a ON a.race_id = o.race_id AND a.horse_number = horse_number_1 JOIN s b ON b.race_id = o.race_id AND b.horse_number = horse_number_2")
PAIRS = ("pairs", "SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score DESC, horse_number_1, horse_number_2) AS score_rank FROM pair")
TRIPLE = ("triple", "SELECT o.*, a.date, a.fold, a.track_id, a.surface_id, a.distance, least(a.target_top3, b.target_top3, c.target_top3) AS target_top3, a.pred_top3 * b.pred_top3 * c.pred_top3 AS score, least(a.pred_top3, b.pred_top3, c.pred_top3) AS min_pred, greatest(a.pred_rank, b.pred_rank, c.pred_rank) AS max_rank, odds AS place_odds_mid FROM trio_odds o JOIN s a ON a.race_id = o.race_id AND a.horse_number = horse_number_1 JOIN s b ON b.race_id = o.race_id AND b.horse_number = horse_number_2 JOIN s c ON c.race_id = o.race_id AND c.horse_number = horse_number_3")
TRIPLES = ("triples", "SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score DESC, horse_number_1, horse_number_2, horse_number_3) AS score_rank FROM triple")
SHOWN = "round(score, 6) AS score, round(min_pred, 6) AS min_pred, CAST(max_rank AS INT) AS max_rank, target_top3"


def pairs(t: Tables) -> DataFrame:
    return x.wide_pairs(scored_once(t), t.wide_odds)


def triples(t: Tables) -> DataFrame:
    return x.trio_combos(scored_once(t), t.trio_odds)


@query(f"SELECT race_id, horse_number_1, horse_number_2, {SHOWN}, CAST(score_rank AS INT) AS score_rank FROM pairs", S, PAIR, PAIRS)
def wide_pairs(t: Tables) -> DataFrame:
    return rounded(pairs(t).select("race_id", "horse_number_1", "horse_number_2", "score", "min_pred", "max_rank", "target_top3", "score_rank"))


@query(f"SELECT race_id, horse_number_1, horse_number_2, horse_number_3, {SHOWN} FROM triples", S, TRIPLE, TRIPLES)
def trio_combos(t: Tables) -> DataFrame:
    return rounded(triples(t).select("race_id", "horse_number_1", "horse_number_2", "horse_number_3", "score", "min_pred", "max_rank", "target_top3"))


def found(df: DataFrame) -> DataFrame:
    return rounded(df.select("rule", "races", "selections", "hits", "return_mid_pct", "min_fold_return_mid_pct", "buy_rate_pct"))


#: Odds and ranks of pairs and of triples, a list that a SQL text can hold; the queries named _all search the whole grids.
WIDE_RULES = [Rule(f"w{i}", odds_min=lo, odds_max=hi, pred_rank_max=top) for i, (top, (lo, hi)) in enumerate((a, b) for a in (1, 3, 5, 10) for b in ((1.0, 8.0), (1.0, 20.0), (2.0, 30.0), (5.0, 50.0), (10.0, 100.0)))]
TRIO_RULES = [Rule(f"t{i}", odds_min=lo, odds_max=hi, pred_rank_max=top) for i, (top, (lo, hi)) in enumerate((a, b) for a in (1, 3, 5, 10, 30) for b in ((1.0, 100.0), (5.0, 200.0), (20.0, 300.0), (50.0, 500.0)))]


def searched_sql(source: str, rules: list[Rule]) -> str:
    body = " UNION ALL ".join(f"SELECT '{q.name}' AS rule, * FROM {source} WHERE place_odds_mid >= {q.odds_min} AND place_odds_mid < {q.odds_max} AND score_rank <= {q.pred_rank_max}" for q in rules)
    return f"SELECT rule, CAST(sum(races) AS BIGINT) AS races, CAST(sum(n) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, round(100.0 * sum(paid) / sum(n), 6) AS return_mid_pct, round(min(100.0 * paid / n), 6) AS min_fold_return_mid_pct, round(100.0 * sum(races) / (SELECT count(DISTINCT race_id) FROM {source}), 6) AS buy_rate_pct FROM (SELECT rule, fold, count(DISTINCT race_id) AS races, count(*) AS n, sum(target_top3) AS hits, sum(target_top3 * place_odds_mid) AS paid FROM ({body}) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 4 AND sum(n) >= 50 AND min(n) >= 5"


@query(searched_sql("pairs", WIDE_RULES), S, PAIR, PAIRS)
def wide_search(t: Tables) -> DataFrame:
    return found(searched(x.as_rows(pairs(t)), WIDE_RULES, 50, 5))


@query(searched_sql("(SELECT * FROM triples WHERE score_rank <= 30)", TRIO_RULES), S, TRIPLE, TRIPLES)
def trio_search(t: Tables) -> DataFrame:
    return found(searched(x.as_rows(triples(t), 30), TRIO_RULES, 50, 5))


@query()
def wide_search_all(t: Tables) -> DataFrame:
    """The whole grid of 53,472 rules."""
    return found(searched(x.as_rows(pairs(t)), wide_rules(), 50, 10))


@query()
def trio_search_all(t: Tables) -> DataFrame:
    """The whole grid of 33,168 rules."""
    return found(searched(x.as_rows(triples(t), 30), trio_rules(), 50, 10))


@query("SELECT race_id, date, horse_number_1, horse_number_2, CAST(score_rank AS INT) AS score_rank, target_top3 AS hit, place_odds_mid AS odds, target_top3 * place_odds_mid * 100 AS payout FROM pairs WHERE score_rank <= 3 AND max_rank <= 3 AND place_odds_mid >= 10", S, PAIR, PAIRS)
def exotic_export(t: Tables) -> DataFrame:
    return x.exported(pairs(t).where("score_rank <= 3 AND max_rank <= 3 AND place_odds_mid >= 10"), 2)


# Named consensus rules.
CONSENSUS = [
    Rule("union_value_odds", None, 4.0, 6.0, 1800, 2200, exclude_track_ids=(7, 10), mode="union", base_pred_min=0.50, secondary_pred_min=0.40),
    Rule("union_value_odds_turf", None, 4.0, 6.0, 1800, 2200, include_track_ids=(5, 6, 8, 9), surface_id=0, mode="union", base_pred_min=0.50, secondary_pred_min=0.40),
    Rule("union_wide_value", None, 3.0, 5.0, 1800, 2200, include_track_ids=(4, 5, 6, 8, 9), mode="union", base_pred_min=0.35, secondary_pred_min=0.40),
    Rule("union_broad_30_value", None, 3.0, 6.0, include_track_ids=(4, 5, 6, 8, 9), mode="union", base_pred_min=0.35, secondary_pred_min=0.35),
    Rule("union_mid_20_value", None, 3.0, 5.0, 1400, 2200, include_track_ids=(4, 5, 6, 8, 9), mode="union", base_pred_min=0.35, secondary_pred_min=0.35),
    Rule("union_mid_20_balanced", None, 2.5, 6.0, mode="union", base_pred_min=0.45, secondary_pred_min=0.45),
    Rule("union_mid_20_stable", None, 2.5, 6.0, 1400, exclude_track_ids=(6,), mode="union", base_pred_min=0.50, secondary_pred_min=0.40),
    Rule("pedigree_mid_20_stable_value", None, 3.2, 6.0, include_track_ids=(4, 5, 6, 8, 9), mode="intersection", base_pred_min=0.34, secondary_pred_min=0.36),
    Rule("union_mid_25_value", None, 2.5, 6.0, 1400, mode="union", base_pred_min=0.50, secondary_pred_min=0.40),
    Rule("union_broad_37_value", None, 3.0, 6.0, mode="union", base_pred_min=0.35, secondary_pred_min=0.35),
    Rule("consensus_high_return", None, 3.0, 6.0, 1800, 2200, exclude_track_ids=(3, 7, 10), mode="intersection", base_pred_min=0.45, secondary_pred_min=0.40),
    Rule("consensus_precise", None, 3.0, 6.0, 1800, 2200, exclude_track_ids=(3, 7, 10), mode="intersection", base_pred_min=0.45, secondary_pred_min=0.45),
    Rule("consensus_volume", None, 3.0, 6.0, 1800, 2200, exclude_track_ids=(3, 7, 10), mode="intersection", base_pred_min=0.35, secondary_pred_min=0.45),
    Rule("avg_balanced", None, 3.0, 6.0, 1800, 2200, exclude_track_ids=(3, 7, 10), mode="average", avg_pred_min=0.425),
]


def both(t: Tables) -> DataFrame:
    return p.agreed(scored(t))


def both_once(t: Tables) -> DataFrame:
    """``both``, for queries that read it more than once."""
    return p.agreed(scored_once(t))


C = ("c", "SELECT * FROM s WHERE pred_top3_secondary IS NOT NULL")


@query("SELECT race_id, horse_number, round((pred_top3 + pred_top3_secondary) / 2, 6) AS pred_top3_mean FROM c", S, C)
def cons_join(t: Tables) -> DataFrame:
    return rounded(both(t).select("race_id", "horse_number", "pred_top3_mean"))


@query(f"SELECT race_id, horse_number FROM c WHERE {condition(CONSENSUS[-1])}", S, C)
def cons_rule(t: Tables) -> DataFrame:
    return both(t).where(r.predicate(CONSENSUS[-1])).select("race_id", "horse_number")


@query(STABLE, S, C, ("taken", taken(CONSENSUS, "c")), PER_FOLD)
def cons_eval(t: Tables) -> DataFrame:
    return rounded(r.stability(r.summary(r.applied(both(t), CONSENSUS), "rule", "fold"), 4, "rule"))


#: Score thresholds of the two models.
STEPS = (0.30, 0.36, 0.40, 0.45)
CONS_RULES = [Rule(f"c{m}{i}", None, 1.5, 6.0, mode=m, base_pred_min=a, secondary_pred_min=b) for m in ("union", "intersection") for i, (a, b) in enumerate((a, b) for a in STEPS for b in STEPS)]


@query("SELECT rule, CAST(sum(races) AS BIGINT) AS races, CAST(sum(n) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, round(100.0 * sum(paid) / sum(n), 6) AS return_mid_pct, round(min(100.0 * paid / n), 6) AS min_fold_return_mid_pct, round(100.0 * sum(races) / (SELECT count(DISTINCT race_id) FROM c), 6) AS buy_rate_pct FROM (SELECT rule, fold, count(DISTINCT race_id) AS races, count(*) AS n, sum(target_top3) AS hits, sum(target_top3 * place_odds_mid) AS paid FROM taken GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 4 AND sum(n) >= 20 AND min(n) >= 2", S, C, ("taken", taken(CONS_RULES, "c")))
def cons_search(t: Tables) -> DataFrame:
    return found(searched(both_once(t), CONS_RULES, 20, 2))


@query()
def cons_search_all(t: Tables) -> DataFrame:
    """The whole grid of 85,176 rules in all three modes."""
    return found(searched(both_once(t), consensus_rules(), 70, 10))


FIRST = "CASE rule " + " ".join(f"WHEN '{q.name}' THEN {i}" for i, q in enumerate(CONSENSUS)) + " END"
MERGED = ("merged", f"SELECT race_id, horse_number, fold, date, arg_min(rule, {FIRST}) AS rule, string_agg(rule, '+' ORDER BY rule) AS matched_rules, any_value(target_top3) AS target_top3, any_value(place_odds_min) AS place_odds_min, any_value(place_odds_mid) AS place_odds_mid, any_value(place_odds_max) AS place_odds_max FROM taken GROUP BY 1, 2, 3, 4")
T = ("taken", taken(CONSENSUS, "c"))


@query(f"SELECT {SUMS} FROM merged", S, C, T, MERGED)
def cons_portfolio(t: Tables) -> DataFrame:
    return rounded(r.summary(p.merged(both(t), CONSENSUS)))


@query(f"SELECT matched_rules, {SUMS} FROM merged GROUP BY 1", S, C, T, MERGED)
def cons_matched(t: Tables) -> DataFrame:
    return rounded(r.summary(p.merged(both(t), CONSENSUS), "matched_rules"))


@query("SELECT race_id, horse_number, date, rule, matched_rules FROM merged", S, C, T, MERGED)
def cons_export(t: Tables) -> DataFrame:
    return p.merged(both(t), CONSENSUS).select("race_id", "horse_number", "date", "rule", "matched_rules").orderBy("date", "race_id", "horse_number")


@query(f"SELECT 'single' AS kind, rule, {SUMS} FROM (SELECT rule, race_id, target_top3, place_odds_min, place_odds_mid, place_odds_max FROM single) GROUP BY 2 UNION ALL SELECT 'consensus', rule, {SUMS} FROM taken GROUP BY 2", S, C, T, ("single", taken(TIERS)))
def cand_compare(t: Tables) -> DataFrame:
    one = r.summary(r.applied(scored_once(t), TIERS), "rule").withColumn("kind", F.lit("single"))
    two = r.summary(r.applied(both_once(t), CONSENSUS), "rule").withColumn("kind", F.lit("consensus"))
    return rounded(one.unionByName(two)).orderBy(F.desc("return_mid_pct"), "rule")


# The strategies of each type of bet, and the named portfolios of them.
GOOD, FAR = (4, 5, 6, 8, 9), (1, 2, 3, 7, 10)
BETS = {
    "win": [
        Rule("win_stable", 0.15, 1.2, 3.5, 1600, None, GOOD, surface_id=0, pred_rank_max=3),
        Rule("win_roi", 0.15, 3.0, 10.0, 1600, None, GOOD, surface_id=0, pred_rank_max=3),
        Rule("win_broad", 0.12, 1.0, 4.0, 1400, None, (4, 5, 6, 9), surface_id=0),
    ],
    "place": [
        Rule("place_latest", 0.37, 3.2, 6.0, 1200, None, pred_rank_max=5, ev_mid_min=1.5),
        Rule("place_broad", 0.37, 3.0, 6.0, 1200, None, pred_rank_max=5, ev_mid_min=1.5),
        Rule("place_stable", 0.34, 3.2, 6.0, 1200, None, None, (3, 7, 10), pred_rank_max=5, ev_mid_min=1.4),
        Rule("pedigree_mid_20_stable", None, 3.2, 6.0, include_track_ids=GOOD, mode="intersection", base_pred_min=0.34, secondary_pred_min=0.36),
    ],
    "wide": [
        Rule("wide_roi", 0.10, 10.0, 100.0, exclude_track_ids=FAR, pred_rank_max=5, ev_mid_min=0.0, max_rank_max=3, min_pred_min=0.25),
        Rule("wide_broad", 0.07, 10.0, 100.0, exclude_track_ids=FAR, pred_rank_max=5, ev_mid_min=1.0, max_rank_max=3, min_pred_min=0.22),
    ],
    "trio": [
        Rule("trio_roi", 0.0, 100.0, 1000.0, None, None, None, FAR, 0, 10, 0.0, max_rank_max=6, min_pred_min=0.0),
        Rule("trio_balanced", 0.0, 1.0, 200.0, 1800, 2600, None, FAR, 0, 10, 0.0, max_rank_max=4, min_pred_min=0.0),
        Rule("trio_hit_rate", 0.0, 1.0, 100.0, 1800, 2600, None, (3, 7, 10), 0, 3, 0.0, max_rank_max=4, min_pred_min=0.0),
        Rule("trio_high_roi", 0.0, 20.0, 200.0, 1800, 2600, None, FAR, 0, 10, 0.0, max_rank_max=4, min_pred_min=0.0),
    ],
}
PORTFOLIOS = {
    "best_mixed_width": ["win_stable", "place_broad", "wide_roi", "trio_roi"], "balanced_all": ["win_stable", "place_latest", "wide_roi", "trio_balanced"], "roi_all": ["win_roi", "place_latest", "wide_roi", "trio_roi"],
    "volume_plus_roi": ["win_stable", "win_roi", "place_latest", "wide_roi", "trio_balanced"], "exotic_roi": ["wide_roi", "trio_roi"], "exotic_balanced": ["wide_roi", "trio_balanced"], "place_wide": ["place_broad", "wide_roi"],
    "place_trio_roi": ["place_broad", "trio_roi"], "pedigree_trio_roi": ["pedigree_mid_20_stable", "trio_high_roi"], "trio_double_roi": ["trio_roi", "trio_high_roi"], "base_low_variance": ["win_stable", "place_latest"],
}
NUMBERS = {"win": 1, "place": 1, "wide": 2, "trio": 3}
WON = ("won", "SELECT s.* EXCLUDE (target_top3, place_odds_mid, expected_value_mid), CASE WHEN u.finish = 1 THEN 1 ELSE 0 END AS target_top3, w.odds AS place_odds_mid, s.pred_top3 * w.odds AS expected_value_mid FROM s JOIN runner u ON u.race_id = s.race_id AND u.horse_number = s.horse_number JOIN win_odds w ON w.race_id = s.race_id AND w.horse_number = s.horse_number")
AS_ROWS = [(f"{x}_rows", f"SELECT *, score AS pred_top3, score_rank AS pred_rank, score * place_odds_mid AS expected_value_mid FROM {x}") for x in ("pairs", "triples")]
FROM = {"win": "won", "place": "s", "wide": "pairs_rows", "trio": "triples_rows"}
KEY_OF = {"win": "CAST(horse_number AS VARCHAR)", "place": "CAST(horse_number AS VARCHAR)", "wide": "horse_number_1 || '-' || horse_number_2", "trio": "horse_number_1 || '-' || horse_number_2 || '-' || horse_number_3"}
LEDGER = ("ledger", " UNION ALL ".join(f"SELECT race_id, fold, '{k}' AS bet_type, rule AS strategy, {KEY_OF[k]} AS selection_key, 100.0::DOUBLE AS stake, target_top3 AS hit, place_odds_mid AS odds, target_top3 * place_odds_mid * 100 AS payout FROM ({taken(rules, FROM[k])})" for k, rules in BETS.items()))
ALL = (S, WON, PAIR, PAIRS, TRIPLE, TRIPLES, *AS_ROWS, LEDGER)


def bets(t: Tables) -> DataFrame:
    """The ledger of all strategies, kept once."""
    one = scored_once(t)
    won = one.withColumns({"target_top3": (F.col("finish") == 1).cast("int"), "place_odds_mid": F.col("win_odds"), "expected_value_mid": F.col("pred_top3") * F.col("win_odds")})
    source = {"win": won, "place": one, "wide": x.as_rows(pairs(t)), "trio": x.as_rows(triples(t))}
    number = lambda n: ["horse_number"] if n == 1 else [f"horse_number_{i + 1}" for i in range(n)]
    parts = [p.ledger(r.applied(source[k], rules), k, F.col("rule"), number(NUMBERS[k])) for k, rules in BETS.items()]
    return saved(reduce(DataFrame.unionByName, parts))


def total(t: Tables) -> int:
    with freed(t.spark):
        return scored_once(t).select("race_id").distinct().count()


@query("SELECT race_id, fold, bet_type, strategy, selection_key, stake, hit, round(odds, 6) AS odds, round(payout, 6) AS payout FROM ledger", *ALL)
def bet_ledger(t: Tables) -> DataFrame:
    return rounded(bets(t))


def bet_sql(by: str, source: str) -> str:
    return f"SELECT {by}, CAST(sum(races) AS BIGINT) AS races, CAST(sum(n) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, round(100 * sum(paid) / sum(staked), 6) AS roi_pct, round(min(100 * paid / staked), 6) AS min_fold_roi_pct, round(100.0 * sum(races) / (SELECT count(DISTINCT race_id) FROM predictions), 6) AS buy_rate_pct, round(100.0 * sum(hits) / sum(n), 6) AS hit_pct FROM (SELECT {by}, fold, count(DISTINCT race_id) AS races, count(*) AS n, sum(hit) AS hits, coalesce(sum(payout), 0) AS paid, sum(stake) AS staked FROM {source} GROUP BY 1, 2) GROUP BY 1"


@query(bet_sql("strategy", "ledger"), *ALL)
def bet_summary(t: Tables) -> DataFrame:
    return rounded(p.bet_summary(bets(t), total(t)))


GROUPS = {k: [q.name for q in rules] for k, rules in BETS.items()}


def members_sql(members: dict[str, list[str]]) -> tuple[str, str]:
    values = ", ".join(f"('{a}', '{b}')" for a, names in members.items() for b in names)
    return ("held", f"SELECT m.portfolio, l.* FROM ledger l JOIN (VALUES {values}) m(portfolio, strategy) ON m.strategy = l.strategy")


@query(bet_sql("portfolio", "held"), *ALL, members_sql(PORTFOLIOS))
def bet_portfolio(t: Tables) -> DataFrame:
    return rounded(p.portfolio_summary(bets(t), total(t), PORTFOLIOS))


@query(bet_sql("portfolio", "held"), *ALL, members_sql(p.one_per_type(GROUPS)))
def bet_combos(t: Tables) -> DataFrame:
    return rounded(p.portfolio_summary(bets(t), total(t), p.one_per_type(GROUPS)))


STRATEGIES = [name for names in GROUPS.values() for name in names]
BIT = "CASE strategy " + " ".join(f"WHEN '{n}' THEN {1 << i}" for i, n in enumerate(STRATEGIES)) + " END"
SUBSETS = [
    ("money", f"SELECT {BIT} AS bit, fold, count(*) AS n, sum(hit) AS hits, coalesce(sum(payout), 0) AS paid, sum(stake) AS staked FROM ledger GROUP BY 1, 2"),
    ("masks", f"SELECT m, count(*) AS races FROM (SELECT race_id, bit_or({BIT}) AS m FROM ledger GROUP BY 1) GROUP BY 1"),
    ("u", f"SELECT unnest(range(1, {1 << len(STRATEGIES)})) AS subset"),
    ("by_fold", "SELECT subset, fold, sum(n) AS n, sum(hits) AS hits, sum(paid) AS paid, sum(staked) AS staked FROM u JOIN money ON subset & bit <> 0 GROUP BY 1, 2"),
    ("over_folds", "SELECT subset, sum(n) AS n, sum(hits) AS hits, 100 * sum(paid) / sum(staked) AS roi, min(100 * paid / staked) AS worst FROM by_fold GROUP BY 1"),
    ("bought", "SELECT subset, 100.0::DOUBLE * sum(races) / (SELECT count(DISTINCT race_id) FROM predictions) AS rate, sum(races) AS races FROM u JOIN masks ON subset & m <> 0 GROUP BY 1"),
]
#: Gates of the subset search: percentages of races bought, and the worst fold's return.
GATES = (1.0, 60.0, 20.0)


@query(f"SELECT CAST(o.subset AS INT) AS subset, CAST(n AS BIGINT) AS selections, CAST(hits AS BIGINT) AS hits, round(roi, 6) AS roi_pct, round(worst, 6) AS min_fold_roi_pct, CAST(races AS BIGINT) AS races, round(rate, 6) AS buy_rate_pct FROM over_folds o JOIN bought b ON b.subset = o.subset WHERE rate >= {GATES[0]} AND rate <= {GATES[1]} AND worst >= {GATES[2]}", *ALL, *SUBSETS)
def bet_subsets(t: Tables) -> DataFrame:
    """All 8,191 subsets of the 13 strategies; those that pass the gates, the best return first."""
    found = p.subsets(bets(t), STRATEGIES, total(t))
    low, high, worst = GATES
    return rounded(found.where((F.col("buy_rate_pct") >= low) & (F.col("buy_rate_pct") <= high) & (F.col("min_fold_roi_pct") >= worst))).orderBy(F.desc("roi_pct"), F.desc("min_fold_roi_pct"), "subset")


@query()
def ped_experiment(t: Tables) -> DataFrame:
    """Coverage gate, consensus, portfolio summary and the wide consensus search in one table."""
    from paddock.operators.coverage import gate

    known = scored_once(t).join(t.horse.where("pedigree_fetch_status = 'fetched'"), "horse_id", "left_semi")
    with freed(t.spark):
        gate(100.0 * known.count() / max(1, scored_once(t).count()), 10.0)
    one = r.summary(p.merged(both_once(t), CONSENSUS), "matched_rules").select(F.lit("portfolio").alias("part"), F.col("matched_rules").alias("name"), "selections", "hits", "return_mid_pct")
    two = searched(both_once(t), consensus_rules(), 70, 10).select(F.lit("search").alias("part"), F.col("rule").alias("name"), "selections", "hits", "return_mid_pct")
    return rounded(one.unionByName(two))
