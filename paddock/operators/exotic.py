"""Pairs and triples of runners, built from their odds rows, so no combination is made that has no odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RACE = ["race_id", "date", "fold", "track_id", "surface_id", "distance"]


def combos(scored: DataFrame, odds: DataFrame, size: int) -> DataFrame:
    """Odds rows with hit, score, min_pred, max_rank and score_rank of their runners; scored has pred_rank.

    The runners of a race, under 19, are one map by number, so one join by race_id serves
    all numbers of a combination.
    """
    numbers = [f"horse_number_{i}" for i in range(1, size + 1)]
    runner = F.struct("target_top3", "pred_top3", "pred_rank")
    race = scored.groupBy(*RACE).agg(F.map_from_entries(F.collect_list(F.struct("horse_number", runner))).alias("__r"))
    df = odds.join(race, "race_id")
    df = df.withColumns({f"__{i}": F.try_element_at("__r", F.col(n)) for i, n in enumerate(numbers)}).where(" AND ".join(f"__{i} IS NOT NULL" for i in range(size)))
    part = lambda c: [F.col(f"__{i}.{c}") for i in range(size)]
    score = part("pred_top3")[0]
    for p in part("pred_top3")[1:]:
        score = score * p
    df = df.withColumns({
        "target_top3": F.least(*part("target_top3")),
        "score": score,
        "min_pred": F.least(*part("pred_top3")),
        "max_rank": F.greatest(*part("pred_rank")),
    })
    order = Window.partitionBy("race_id").orderBy(F.desc("score"), *numbers)
    return df.withColumn("score_rank", F.row_number().over(order)).drop("__r", *[f"__{i}" for i in range(size)])


def wide_pairs(scored: DataFrame, odds: DataFrame) -> DataFrame:
    df = combos(scored, odds, 2).withColumn("place_odds_mid", (F.col("odds_min") + F.col("odds_max")) / 2)
    return df.withColumn("expected_value_mid", F.col("score") * F.col("place_odds_mid"))


def trio_combos(scored: DataFrame, odds: DataFrame) -> DataFrame:
    df = combos(scored, odds, 3).withColumn("place_odds_mid", F.col("odds"))
    return df.withColumn("expected_value_mid", F.col("score") * F.col("odds"))


def as_rows(df: DataFrame, score_rank_max: int | None = None) -> DataFrame:
    """Combinations in the columns that rule search reads: rank is the score's, the runners' worst rank bounds it by its own filter."""
    df = df if score_rank_max is None else df.where(F.col("score_rank") <= score_rank_max)
    return df.withColumns({"pred_top3": F.col("score"), "pred_rank": F.col("score_rank")})


def exported(df: DataFrame, size: int, stake: float = 100.0) -> DataFrame:
    numbers = [f"horse_number_{i}" for i in range(1, size + 1)]
    payout = F.col("target_top3") * F.col("place_odds_mid") * stake
    return df.select("race_id", "date", *numbers, "score_rank", F.col("target_top3").alias("hit"), F.col("place_odds_mid").alias("odds"), payout.alias("payout")).orderBy("date", "race_id", "score_rank")
