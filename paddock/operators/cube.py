"""Search of very many rules over cells.

A rule is one option of each dimension: a range of scores, odds, distances, and so on. The
cut points of all options divide the rows into cells, so rows are summed by cell and fold
once. Then one dimension after the other is turned from levels into options: each level's
sums go to the options that hold it, and equal ones are added up. What is shuffled after the
first sum is bounded by the grid, not by the rows or by rules times rows. Distinct races do
not add up over cells; they are counted from the rows, for the rules that passed the gates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.search import DISTANCES, ODDS, PREDS, SURFACES
from paddock.sources.scratch import saved

#: Odds are summed as whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
MONEY = ("paid_min", "paid_mid", "paid_max")


@dataclass(frozen=True)
class Dimension:
    """``level`` gives a row's level; ``members`` are (level, option number); ``options`` are the fields that each option sets, ``labels`` their texts."""

    name: str
    level: Column
    members: tuple[tuple[int, int], ...]
    options: tuple[dict, ...]
    labels: tuple[str, ...]


def ranges(name: str, column: str, bounds: Iterable[tuple], fields: Callable[[tuple], dict], label: Callable[[tuple], str]) -> Dimension:
    """Options that are ranges [low, high), an end may be None; a null value lies only in (None, None)."""
    bounds = list(bounds)
    cuts = sorted({x for pair in bounds for x in pair if x is not None})
    level = F.coalesce(reduce(lambda a, b: a + b, [(F.col(column) >= c).cast("int") for c in cuts], F.lit(0)), F.lit(-1))

    def holds(at: int, low, high) -> bool:
        if at < 0:
            return low is None and high is None
        return (low is None or at > cuts.index(low)) and (high is None or at <= cuts.index(high))

    members = tuple((at, i) for at in range(-1, len(cuts) + 1) for i, pair in enumerate(bounds) if holds(at, *pair))
    return Dimension(name, level, members, tuple(map(fields, bounds)), tuple(map(label, bounds)))


def choices(name: str, column: str, options: Iterable[tuple], fields: Callable[[tuple], dict], label: Callable[[tuple], str]) -> Dimension:
    """Options (included values or None, excluded values or None); a null value is excluded by none and included by none."""
    options = list(options)
    named = sorted({x for pair in options for part in pair for x in part or ()})
    level = F.when(F.col(column).isin(named), F.col(column).cast("int")).otherwise(-1)
    holds = lambda v, some, none: (some is None or v in some) and (none is None or v not in none)
    members = tuple((v, i) for v in [-1, *named] for i, pair in enumerate(options) if holds(v, *pair))
    return Dimension(name, level, members, tuple(map(fields, options)), tuple(map(label, options)))


# What the searches beyond the common grid ask, and the win profile's grid.
RANKS, EVS = (None, 4, 5, 6, 8), (None, 1.2, 1.3, 1.4, 1.5)
TRACKS = {"all": (None, None), "exclude_7_10": (None, (7, 10)), "exclude_3_7_10": (None, (3, 7, 10)), "exclude_3_7_8_10": (None, (3, 7, 8, 10)), "include_4_5_6_9": ((4, 5, 6, 9), None), "include_4_5_6_8_9": ((4, 5, 6, 8, 9), None)}
WIN_PREDS = (0.04, 0.05, 0.06, 0.08, 0.10, 0.12, 0.14, 0.15, 0.16, 0.17, 0.18, 0.20, 0.22, 0.25)
WIN_ODDS = ((1.0, 2.0), (1.0, 2.5), (1.0, 3.0), (1.0, 3.5), (1.0, 4.0), (1.0, 5.0), (1.2, 3.0), (1.2, 3.5), (1.5, 3.0), (1.5, 3.5), (1.5, 5.0), (2.0, 5.0), (2.0, 8.0), (3.0, 10.0))
WIN_DISTANCES = ((None, None), (1200, None), (1400, None), (1600, None), (1600, 2200), (1800, 2200))
WIN_RANKS = (None, 1, 2, 3, 4, 5, 6, 8)
#: Of each profile: least predictions, odds, distances, worst ranks, least expected values. 315,000 and 169,344 rules.
PROFILES = {"place": (PREDS, ODDS, DISTANCES, RANKS, EVS), "win": (WIN_PREDS, WIN_ODDS, WIN_DISTANCES, WIN_RANKS, (None,))}


def grid(preds, odds, distances, ranks=(None,), evs=(None,), tracks=TRACKS, surfaces=SURFACES) -> list[Dimension]:
    """The dimensions of a search; the columns are those of a scored table."""
    label = {v: k for k, v in tracks.items()}
    text = lambda x: "all" if x is None else str(x)
    return [
        ranges("pred", "pred_top3", [(p, None) for p in preds], lambda b: {"pred_min": b[0]}, lambda b: f"pred>={b[0]:.2f}"),
        ranges("odds", "place_odds_mid", odds, lambda b: {"odds_min": b[0], "odds_max": b[1]}, lambda b: f"odds=[{b[0]:.1f},{b[1]:.1f})"),
        ranges("distance", "distance", distances, lambda b: {"distance_min": b[0], "distance_max": b[1]}, lambda b: f"distance=[{b[0]},{b[1]})"),
        choices("track", "track_id", tracks.values(), lambda b: {"track_label": label[b]}, lambda b: f"track={label[b]}"),
        choices("surface", "surface_id", [(None if s is None else (s,), None) for s in surfaces], lambda b: {"surface_id": b[0] and b[0][0]}, lambda b: f"surface={text(b[0] and b[0][0])}"),
        ranges("rank", "pred_rank", [(None, None if k is None else k + 1) for k in ranks], lambda b: {"pred_rank_max": b[1] and b[1] - 1}, lambda b: "rank=all" if b[1] is None else f"rank=<={b[1] - 1}"),
        ranges("ev", "expected_value_mid", [(e, None) for e in evs], lambda b: {"ev_mid_min": b[0]}, lambda b: "ev_mid=all" if b[0] is None else f"ev_mid=>={b[0]:.1f}"),
    ]


def size_of(dims: list[Dimension]) -> int:
    return reduce(lambda n, d: n * len(d.options), dims, 1)


def cells(df: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(fold, a level for each dimension, selections, hits, paid_min, paid_mid, paid_max) of the rows that some rule can take."""
    leveled = df.withColumns({f"__{d.name}": d.level for d in dims})
    for d in dims:  # a level that no option holds, such as a missing score
        leveled = leveled.where(F.col(f"__{d.name}").isin(sorted({at for at, _ in d.members})))
    hit = F.coalesce(F.col("target_top3"), F.lit(0))
    money = [F.sum(F.when(hit == 1, F.round(F.col(f"place_odds_{x}") * UNIT).cast("long")).otherwise(0)).alias(f"paid_{x}") for x in ("min", "mid", "max")]
    return leveled.groupBy("fold", *[f"__{d.name}" for d in dims]).agg(F.count(F.lit(1)).alias("selections"), F.sum(hit).cast("long").alias("hits"), *money)


def rule_sums(df: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(rule, fold, selections, hits, paid_min, paid_mid, paid_max): the sums of every rule with rows; a rule's number counts its options, the last dimension fastest."""
    out, left = cells(df, dims).withColumn("rule", F.lit(0).cast("long")), list(dims)
    sums = [F.sum(c).alias(c) for c in ("selections", "hits", *MONEY)]
    for d in dims:
        left = left[1:]
        # As long as the options' cut points, so that every task can hold it.
        table = F.broadcast(df.sparkSession.createDataFrame([*d.members], f"__{d.name} int, option int"))
        out = out.join(table, f"__{d.name}").withColumn("rule", F.col("rule") * len(d.options) + F.col("option"))
        out = out.groupBy("rule", "fold", *[f"__{x.name}" for x in left]).agg(*sums)
    return out


def described(df: DataFrame, dims: list[Dimension]) -> DataFrame:
    """``df`` with each rule's fields and its ``rule_key``, worked out from its number."""
    stride, at = size_of(dims), {}
    for d in dims:
        stride //= len(d.options)
        at[d.name] = (F.floor(F.col("rule") / stride) % len(d.options)).cast("int")
    fields = {f: F.get(F.array(*[F.lit(o[f]) for o in d.options]), at[d.name]) for d in dims for f in d.options[0]}
    key = F.concat_ws("|", *[F.get(F.lit(list(d.labels)), at[d.name]) for d in dims])
    return df.withColumns({**fields, "rule_key": key})


def races_of(df: DataFrame, dims: list[Dimension], rules: DataFrame) -> DataFrame:
    """(rule, races): distinct races with a row that the rule takes, for some rules by number.

    A race's levels come once each. They meet the rules through the first dimension's options
    and the others are checked there; the rules are no more than the grid has.
    """
    # Dealt by race, so that its rules are counted where it lies.
    spread = df.select("race_id", *[d.level.alias(f"__{d.name}") for d in dims]).repartition("race_id").distinct()
    stride, own = size_of(dims), rules.select("rule")
    for d in dims:
        stride //= len(d.options)
        levels = F.array(*[F.array(*[F.lit(at) for at, o in d.members if o == i]) for i in range(len(d.options))])
        own = own.withColumn(f"o_{d.name}", (F.floor(F.col("rule") / stride) % len(d.options)).cast("int")).withColumn(f"in_{d.name}", F.get(levels, F.col(f"o_{d.name}")))
    first = dims[0].name
    table = F.broadcast(df.sparkSession.createDataFrame([*dims[0].members], f"__{first} int, o_{first} int"))
    met = spread.join(table, f"__{first}").join(own, f"o_{first}")
    for d in dims[1:]:
        met = met.where(F.array_contains(f"in_{d.name}", F.col(f"__{d.name}")))
    return met.select("rule", "race_id").distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("races"))


def percent(money: Column, n: Column) -> Column:
    """100 * money / n, ``money`` in whole units, rounded to six places in whole numbers, so that it is the same however sums were dealt."""
    return F.call_function("div", 200 * money + n, 2 * n) / UNIT


def search(df: DataFrame, dims: list[Dimension], min_selections: int = 100, min_fold_selections: int = 10, min_fold_return: float | None = None, buy_rate: tuple[float | None, float | None] = (None, None), top: int | None = 20) -> DataFrame:
    """The rules with rows in every fold that pass the gates, the best return first: their fields, rule_key, races, selections, hits, and percentages.

    Columns read: race_id, fold, target_top3, pred_top3, place_odds_min, _mid, _max, distance,
    track_id, surface_id, pred_rank, expected_value_mid. One unit is staked on each selection.
    ``buy_rate`` bounds the share of all races; with it, races are counted for all rules that
    pass the other gates, else only for the ``top`` ones (None: all).
    """
    folds = df.select("fold").where("fold IS NOT NULL").distinct().count()
    ret = lambda money: percent(F.col(money), F.col("selections"))
    per_fold = rule_sums(df.where("fold IS NOT NULL"), dims).withColumn("ret", ret("paid_mid"))
    out = per_fold.groupBy("rule").agg(
        F.count(F.lit(1)).alias("folds"), *[F.sum(c).alias(c) for c in ("selections", "hits", *MONEY)],
        F.min("ret").alias("min_fold_return_mid_pct"), F.max("ret").alias("max_fold_return_mid_pct"), F.min("selections").alias("min_fold_selections"),
    )
    out = out.where((F.col("folds") == folds) & (F.col("selections") >= min_selections) & (F.col("min_fold_selections") >= min_fold_selections))
    if min_fold_return is not None:
        out = out.where(F.col("min_fold_return_mid_pct") >= min_fold_return)
    out = out.withColumns({"hit_rate_pct": percent(F.col("hits") * UNIT, F.col("selections")), **{f"return_{m}_pct": ret(f"paid_{m}") for m in ("min", "mid", "max")}})
    order = [F.desc("return_mid_pct"), F.desc("min_fold_return_mid_pct"), F.desc("selections"), "rule"]
    gated = buy_rate != (None, None)
    if top is not None and not gated:
        out = out.orderBy(*order).limit(top)
    out = saved(out.drop("folds", *MONEY))
    total = df.select("race_id").distinct().count()
    out = out.join(races_of(df, dims, out), "rule").withColumn("buy_rate_pct", percent(F.col("races") * UNIT, F.lit(total)))
    low, high = buy_rate
    out = out if low is None else out.where(F.col("buy_rate_pct") >= low)
    out = out if high is None else out.where(F.col("buy_rate_pct") <= high)
    out = described(out, dims).orderBy(*order)
    return out if top is None or not gated else out.limit(top)
