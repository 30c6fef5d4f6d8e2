"""Selection rules: predicates over scored rows, and their results by rule, fold and condition."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAKE = 100.0


@dataclass(frozen=True)
class Rule:
    """Lower bounds count, upper bounds don't; None leaves a condition out. ``mode`` says which scores a consensus needs."""

    name: str = ""
    pred_min: float | None = None
    odds_min: float | None = None
    odds_max: float | None = None
    distance_min: int | None = None
    distance_max: int | None = None
    include_track_ids: tuple | None = None
    exclude_track_ids: tuple | None = None
    surface_id: int | None = None
    pred_rank_max: int | None = None
    ev_mid_min: float | None = None
    mode: str | None = None
    base_pred_min: float | None = None
    secondary_pred_min: float | None = None
    avg_pred_min: float | None = None
    max_rank_max: int | None = None
    min_pred_min: float | None = None


def load_rule(given: dict, overrides: dict | None = None) -> Rule:
    """A rule from a dict with overrides on top; refuses keys that no rule has."""
    values = {**given, **{k: v for k, v in (overrides or {}).items() if v is not None}}
    if unknown := sorted(values.keys() - {f.name for f in fields(Rule)}):
        raise ValueError(f"unknown rule keys: {', '.join(unknown)}")
    return Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def race_rank(pred: str = "pred_top3") -> Column:
    """1 for the best score of a race; equal scores by horse_number."""
    return F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc(pred), "horse_number"))


def enriched(df: DataFrame, pred: str = "pred_top3") -> DataFrame:
    """Adds pred_rank, expected_value_min and expected_value_mid."""
    return df.withColumns({"pred_rank": race_rank(pred), "expected_value_min": F.col(pred) * F.col("place_odds_min"), "expected_value_mid": F.col(pred) * F.col("place_odds_mid")})


def _fold(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def predicate(rule: Rule, pred: str = "pred_top3") -> Column:
    """The rule as one condition. A null track isn't an excluded one; other nulls never pass."""
    at_least = {pred: rule.pred_min, "place_odds_mid": rule.odds_min, "distance": rule.distance_min, "expected_value_mid": rule.ev_mid_min, "min_pred": rule.min_pred_min}
    parts = [F.col(c) >= v for c, v in at_least.items() if v is not None]
    parts += [F.col(c) < v for c, v in {"place_odds_mid": rule.odds_max, "distance": rule.distance_max}.items() if v is not None]
    if rule.pred_rank_max is not None:
        parts.append(F.col("pred_rank") <= rule.pred_rank_max)
    if rule.max_rank_max is not None:
        parts.append(F.col("max_rank") <= rule.max_rank_max)
    if rule.include_track_ids is not None:
        parts.append(F.col("track_id").isin(*rule.include_track_ids))
    if rule.exclude_track_ids is not None:
        parts.append(~F.coalesce(F.col("track_id").isin(*rule.exclude_track_ids), F.lit(False)))
    if rule.surface_id is not None:
        parts.append(F.col("surface_id") == rule.surface_id)
    first, second = F.col("pred_top3"), F.col("pred_top3_secondary")
    if rule.mode == "intersection":
        parts.append((first >= rule.base_pred_min) & (second >= rule.secondary_pred_min))
    elif rule.mode == "union":
        parts.append((first >= rule.base_pred_min) | (second >= rule.secondary_pred_min))
    elif rule.mode == "average":
        parts.append((first + second) / 2 >= rule.avg_pred_min)
    return _fold(parts) if parts else F.lit(True)


def applied(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each row and rule that takes it, with the column rule: an array of names is filtered and exploded, no join."""
    names = F.array(*[F.when(F.coalesce(predicate(r), F.lit(False)), F.lit(r.name)) for r in rules])
    return df.withColumn("rule", F.explode(F.array_compact(names)))


def pct(top: Column, bottom: Column) -> Column:
    return F.try_divide(100.0 * top, bottom)


def returned(odds: str) -> Column:
    return F.sum(F.col("target_top3") * F.col(odds) * STAKE)


def summary(df: DataFrame, *by: str) -> DataFrame:
    """races, selections, hits, hit_pct and return percentages at least, middle and greatest odds, by the given columns."""
    n = F.count(F.lit(1))
    out = df.groupBy(*by).agg(
        F.countDistinct("race_id").alias("races"),
        n.alias("selections"),
        F.coalesce(F.sum("target_top3"), F.lit(0)).cast("long").alias("hits"),
        *[pct(returned(f"place_odds_{k}"), n * STAKE).alias(f"return_{k}_pct") for k in ("min", "mid", "max")],
    )
    return out.withColumn("hit_pct", pct(F.col("hits"), F.col("selections")))


def top_k(df: DataFrame, score: str, ks: list[int], ascending: bool = False) -> DataFrame:
    """The k best rows of each race by ``score`` for every k of ``ks``, with the column k; null scores don't count."""
    order = F.asc(score) if ascending else F.desc(score)
    ranked = df.where(F.col(score).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy("race_id").orderBy(order, "horse_number")))
    return ranked.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("__r")))).drop("__r")


def above(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """Each row once for every threshold it reaches, with the column threshold."""
    return df.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: F.col(score) >= x)))


def banded(df: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """Rows inside the edges with the column band, closed on the left; others go."""
    band = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        band = F.when((F.col(score) >= lo) & (F.col(score) < hi), F.lit(f"{lo:g}-{hi:g}")).otherwise(band)
    return df.withColumn("band", band).where("band IS NOT NULL")


def grid(preds: list[float], ranges: list[tuple[float, float]]) -> list[Rule]:
    return [Rule(f"{p:g}|{lo:g}-{hi:g}", pred_min=p, odds_min=lo, odds_max=hi) for p in preds for lo, hi in ranges]


def broken_down(df: DataFrame, conditions: dict[str, Column], *by: str) -> DataFrame:
    """``summary`` by each condition on its own, in one pass: rows are stacked, races are counted in two steps."""
    pairs = F.array(*[F.struct(F.lit(name).alias("condition"), c.cast("string").alias("value")) for name, c in conditions.items()])
    stacked = df.withColumn("__c", F.explode(pairs)).select("*", "__c.condition", "__c.value")
    return summary(stacked, *by, "condition", "value")


def size_band(size: Column) -> Column:
    return F.when(size < 10, "small").when(size < 14, "medium").when(size < 19, "large")


def stability(per_fold: DataFrame, n_folds: int, *by: str) -> DataFrame:
    """Over the folds of ``summary`` rows: folds hit, sums, returns weighted by selections, least and greatest fold return."""
    s = F.col("selections")
    return per_fold.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum(s).alias("selections"),
        F.sum("hits").alias("hits"),
        F.try_divide(F.sum(F.col("return_mid_pct") * s), F.sum(s)).alias("return_mid_pct"),
        F.min("return_mid_pct").alias("min_fold_return_mid_pct"),
        F.max("return_mid_pct").alias("max_fold_return_mid_pct"),
        F.min(s).alias("min_fold_selections"),
        (F.count(F.lit(1)) == n_folds).alias("all_folds"),
    )


def rule_table(rules: list[Rule]) -> list[dict]:
    return [asdict(r) for r in rules]
