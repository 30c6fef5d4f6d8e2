"""All reports of an evaluation over the given predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import reports
from paddock.operators import rules as r
from paddock.plans.registry import query
from paddock.plans.rules import CONDS, FIXED, GRID, S, SUMS, condition, rounded, scored, scored_once, taken
from paddock.sources.adapter import Tables

LEAST = 5
TAKEN = ("taken", taken(GRID))


def band_sql(score: str, edges: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {a} AND {score} < {b} THEN '{a:g}-{b:g}'" for a, b in zip(edges, edges[1:])) + " END"


def holdout_sql() -> str:
    head = "SELECT '{report}' AS report, '{score}' AS score, {name} AS name, {value} AS value, " + SUMS
    parts = [head.format(report="strategy", score=s, name="CAST(k AS VARCHAR)", value="NULL") + f" FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY {s} DESC, horse_number) AS n FROM s WHERE {s} IS NOT NULL) JOIN (SELECT unnest([1, 2, 3]) AS k) ON n <= k GROUP BY k" for s in reports.SCORES]
    parts += [head.format(report="threshold", score=s, name="CAST(x AS VARCHAR)", value="NULL") + f" FROM s JOIN (SELECT unnest({list(ts)})::DOUBLE AS x) ON {s} >= x GROUP BY x" for s, ts in reports.THRESHOLDS.items()]
    parts += [head.format(report="band", score=s, name="b", value="NULL") + f" FROM (SELECT *, {band_sql(s, edges)} AS b FROM s) WHERE b IS NOT NULL GROUP BY b" for s, edges in reports.BANDS.items()]
    parts.append(head.format(report="rule", score="", name="rule", value="NULL") + f" FROM taken GROUP BY rule HAVING count(*) >= {LEAST}")
    parts += [head.format(report="condition", score="", name="rule", value=f"'{n}=' || c") + f" FROM (SELECT *, {c} AS c FROM taken) WHERE c IS NOT NULL GROUP BY rule, c HAVING count(*) >= {LEAST}" for n, c in CONDS.items()]
    return " UNION ALL ".join(parts)


@query(holdout_sql(), S, TAKEN)
def holdout_reports(t: Tables) -> DataFrame:
    """Strategies, thresholds and bands of three scores, the rule grid, and the grid by condition."""
    return rounded(reports.holdout(scored_once(t).repartition("race_id"), GRID, LEAST))


FOLDED = ("folded", "SELECT 'rule' AS report, rule, CAST(NULL AS VARCHAR) AS value, fold, target_top3, place_odds_mid FROM taken" + "".join(f" UNION ALL SELECT 'condition', rule, '{n}=' || c, fold, target_top3, place_odds_mid FROM (SELECT *, {c} AS c FROM taken) WHERE c IS NOT NULL" for n, c in CONDS.items()))
HELD = ("held", f"SELECT report, rule, value, fold, count(*) AS selections, sum(target_top3) AS hits, 100.0::DOUBLE * sum(target_top3 * place_odds_mid) / count(*) AS ret FROM folded GROUP BY ALL HAVING count(*) >= {LEAST}")


@query("""SELECT report, rule, value, count(*) AS folds, CAST(sum(selections) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, round(sum(ret * selections) / sum(selections), 6) AS return_mid_pct, round(min(ret), 6) AS min_fold_return_mid_pct,
round(max(ret), 6) AS max_fold_return_mid_pct, min(selections) AS min_fold_selections, count(*) = 4 AS all_folds FROM held GROUP BY ALL""", S, TAKEN, FOLDED, HELD)
def stability_reports(t: Tables) -> DataFrame:
    """How the grid's rules hold over the folds, as a whole and by condition."""
    return rounded(reports.stable(scored_once(t).repartition("race_id"), GRID, 4, LEAST))


WITH_PEDIGREE = ("w", "SELECT s.*, CAST(CASE WHEN h.pedigree_fetch_status = 'fetched' THEN 1 ELSE 0 END AS INT) AS pedigree_available FROM s JOIN runner u ON u.race_id = s.race_id AND u.horse_number = s.horse_number LEFT JOIN horse h ON h.horse_id = u.horse_id")


@query(" UNION ALL ".join(f"SELECT '{n}' AS condition, {c} AS value, {SUMS} FROM w WHERE {condition(FIXED)} GROUP BY 2" for n, c in {"fold": "CAST(fold AS VARCHAR)", "month": "strftime(date, '%Y-%m')", "track": "CAST(track_id AS VARCHAR)", "surface": "CAST(surface_id AS VARCHAR)", "pedigree_available": "CAST(pedigree_available AS VARCHAR)"}.items()), S, WITH_PEDIGREE)
def pedigree_breakdown(t: Tables) -> DataFrame:
    """A rule's rows by fold, month, track, surface and pedigree flag."""
    ped = t.horse.select("horse_id", (F.col("pedigree_fetch_status") == "fetched").cast("int").alias("p"))
    own = t.runner.select("race_id", "horse_number", "horse_id").join(ped, "horse_id", "left")
    own = own.select("race_id", "horse_number", F.coalesce("p", F.lit(0)).alias("pedigree_available"))
    return rounded(reports.breakdown(scored(t).where(r.predicate(FIXED)).join(own, ["race_id", "horse_number"])))
