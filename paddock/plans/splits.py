"""Queries of splits, enrichment and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import rules as r
from paddock.operators import splits as s
from paddock.plans.registry import query
from paddock.sources.adapter import Tables

DATES = ("d", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM predictions)")


@query("SELECT p.race_id, horse_number, CASE WHEN i < greatest(1, least(n - 1, CAST(floor(n * 0.8::DOUBLE) AS INT))) THEN 'train' ELSE 'test' END AS part FROM predictions p JOIN d ON p.date = d.date", DATES)
def split_ratio(t: Tables) -> DataFrame:
    return s.split_ratio(t.predictions, 0.2).select("race_id", "horse_number", "part")


FOLDS = ("f", "SELECT k + 1 AS fold, a.date AS test_start, CASE WHEN k < 3 THEN b.date END AS test_end FROM (SELECT unnest(range(4)) AS k) JOIN d a ON a.i = CAST(floor(n * 0.5) AS INT) + k * greatest(1, (n - CAST(floor(n * 0.5) AS INT)) // 4) LEFT JOIN d b ON b.i = a.i + greatest(1, (b.n - CAST(floor(b.n * 0.5) AS INT)) // 4) WHERE a.i < a.n - 1")


@query("SELECT CAST(fold AS INT) AS fold, test_start, test_end FROM f", DATES, FOLDS)
def split_walk(t: Tables) -> DataFrame:
    return s.fold_table(t.predictions, 4, 0.5)


@query("SELECT CAST(f.fold AS INT) AS fold, CASE WHEN p.date < test_start THEN 'train' ELSE 'test' END AS part, count(*) AS rows, count(DISTINCT race_id) AS races FROM predictions p JOIN f ON p.date < test_start OR test_end IS NULL OR p.date < test_end GROUP BY 1, 2", DATES, FOLDS)
def fold_report(t: Tables) -> DataFrame:
    p = t.predictions.drop("fold")
    return s.fold_report(s.in_folds(p, s.fold_table(p, 4, 0.5)))


@query("SELECT race_id, horse_number FROM predictions WHERE distance >= 1400 AND distance < 2000 AND surface_id = 0")
def train_filter(t: Tables) -> DataFrame:
    return s.train_filter(t.predictions, 1400, 2000, 0).select("race_id", "horse_number")


@query("SELECT p.race_id, p.horse_number, round(pred_top3 * o.odds_min, 6) AS expected_value_min, round(pred_top3 * (o.odds_min + o.odds_max) / 2, 6) AS expected_value_mid FROM predictions p LEFT JOIN place_odds o ON p.race_id = o.race_id AND p.horse_number = o.horse_number")
def pred_enrich(t: Tables) -> DataFrame:
    scored = t.predictions.drop("place_odds_min", "place_odds_max", "place_odds_mid")
    odds = t.place_odds.select("race_id", "horse_number", F.col("odds_min").alias("place_odds_min"), F.col("odds_max").alias("place_odds_max"), ((F.col("odds_min") + F.col("odds_max")) / 2).alias("place_odds_mid"))
    df = r.enriched(scored.join(odds, ["race_id", "horse_number"], "left"))
    return df.select("race_id", "horse_number", *[F.round(c, 6).alias(c) for c in ("expected_value_min", "expected_value_mid")])


@query("SELECT fold, round((sum(CASE WHEN target_top3 = 1 THEN r END) - k * (k + 1) / 2.0) / (k * (n - k)), 6) AS auc, round(avg(-CASE WHEN target_top3 = 1 THEN ln(pred_top3) ELSE ln(1 - pred_top3) END), 6) AS log_loss, round(avg((pred_top3 - target_top3) ** 2), 6) AS brier FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY q) + (count(*) OVER (PARTITION BY fold, q) - 1) / 2.0::DOUBLE AS r, sum(target_top3) OVER (PARTITION BY fold)::DOUBLE AS k, count(*) OVER (PARTITION BY fold)::DOUBLE AS n FROM (SELECT *, round(pred_top3, 6) AS q FROM predictions)) GROUP BY fold, k, n")
def metrics(t: Tables) -> DataFrame:
    return s.metrics(t.predictions).select("fold", *[F.round(c, 6).alias(c) for c in ("auc", "log_loss", "brier")])
