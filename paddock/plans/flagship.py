"""One query end to end: history, rank in the race, the best of each race, and what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import history, rules
from paddock.operators.base import drop_patterns, guard
from paddock.plans.datasets import B, rows
from paddock.plans.history import ROWS, past, ready
from paddock.plans.registry import query
from paddock.plans.rules import SUMS, rounded
from paddock.sources.adapter import Tables

W = past("horse_id")


@query(
    f"SELECT k, {SUMS} FROM (SELECT *, CAST(n AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY pred DESC, horse_number) AS n FROM (SELECT *, (place_odds_min + place_odds_max) / 2 AS place_odds_mid, coalesce(avg(target_top3) {W}, 0) AS pred FROM h_rows)) WHERE n = 1) GROUP BY 1",
    B,
    ROWS,
)
def flagship(t: Tables) -> DataFrame:
    df = history.cumulative_before(ready(t), "horse", ["horse_id"])
    df = df.withColumns({"pred_top3": F.coalesce("horse_past_top3_rate", F.lit(0.0)), "place_odds_mid": (F.col("place_odds_min") + F.col("place_odds_max")) / 2})
    return rounded(rules.summary(rules.top_k(df, "pred_top3", [1]), "k"))


@query("SELECT race_id, horse_number, target_top3 FROM base", B)
def leak_guard(t: Tables) -> DataFrame:
    return guard(rows(t).select("race_id", "horse_number", "target_top3"))


@query("SELECT race_id, horse_number, date, gate, age FROM base", B)
def drop_columns(t: Tables) -> DataFrame:
    return drop_patterns(rows(t).select("race_id", "horse_number", "date", "gate", "age", "sire_id", "win_odds"), ["sire", "odds"])
