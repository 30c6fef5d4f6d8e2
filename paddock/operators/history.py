"""Point-in-time history: a row sees only rows of strictly earlier dates, never its own day's.

Cumulative figures are built from one row per key and day, summed before the shuffle, so a
key with very many rows costs a few small rows a day; rows join their key's day, once for all
figures of one id. Keys that are null are one pooled key unless ``missing`` says that they
have no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.sources.scratch import saved

#: Columns of rows without results: they count for no one, and their history is taken as of this day instead of their own.
LIVE, AS_OF = "__live", "__as_of"
#: Strength of the prior in smoothed rates, in starts.
PRIOR_STARTS = 20
#: The number of a stored row.
ROW = "__row"


def distance_band(distance: Column) -> Column:
    return F.when(distance < 1400, "under1400").when(distance < 1800, "1400_1799").when(distance < 2200, "1800_2199").otherwise("2200plus")


def day_of(df: DataFrame) -> str:
    return AS_OF if AS_OF in df.columns else "date"


def counted(df: DataFrame, value: Column) -> Column:
    """``value``, null for live rows."""
    return F.when(~F.col(LIVE), value) if LIVE in df.columns else value


def missing_key(keys: list[str]) -> Column:
    """True where an id counts as unknown: null or empty."""
    return F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) == ""


#: (prefix, further keys, means: name to column, spans: name to column)
Spec = tuple[str, list[str], dict[str, str], dict[str, str]]


def spec(prefix: str, *keys: str, means: dict[str, str] | None = None, spans: dict[str, str] | None = None) -> Spec:
    return prefix, list(keys), means or {}, spans or {}


def history_before(df: DataFrame, lead: str, specs: list[Spec], recents: list[tuple[int, dict[str, str]]] = [], last: bool = False, missing: Column | None = None, source: DataFrame | None = None, name: str | None = None) -> DataFrame:  # noqa: B006
    """All history of one leading id, in a single join of the rows.

    Each of ``specs`` adds {prefix}_past_starts, _past_top3, _past_top3_rate over rows of the
    same id and further keys, the means of its columns, nulls skipped, and their least and
    greatest. ``recents`` add {name}_recent{n}_avg_{key}, or _top3_rate for the key top3, over the last n rows before the
    day, ``last`` the last day's distance from today and its race's distance.

    Rows that agree in all keys of ``specs`` and the day are summed first; what precedes a day
    is a running sum over these few, dealt by the leading id once for all specs. ``source``
    holds the rows that count, ``df`` itself by default. A chain of calls passes the rows it
    began with, so that each step reads those and not all the steps before.
    """
    source, name = df if source is None else source, name or lead.removesuffix("_id")
    grain = [lead, *dict.fromkeys(k for _, keys, _, _ in specs for k in keys)]
    mean_of = dict.fromkeys(c for _, _, means, _ in specs for c in means.values())
    span_of = dict.fromkeys(c for _, _, _, spans in specs for c in spans.values())
    on, own = day_of(source), lambda c: counted(source, F.col(c))
    sums = [F.count(counted(source, F.lit(1))).alias("__n"), F.sum(own("target_top3")).alias("__hit")]
    for i, c in enumerate(mean_of):
        mean_of[c] = i
        sums += [F.sum(own(c).cast("double")).alias(f"__s{i}"), F.count(own(c)).alias(f"__c{i}")]
    for i, c in enumerate(span_of):
        span_of[c] = i
        sums += [F.min(own(c)).alias(f"__lo{i}"), F.max(own(c)).alias(f"__hi{i}")]
    days = source.groupBy(*grain, on).agg(*sums).repartition(F.col(lead)).withColumn("__day", F.unix_date(on))
    out: dict[str, Column] = {}
    for prefix, keys, means, spans in specs:
        past = Window.partitionBy(lead, *keys).orderBy("__day").rangeBetween(Window.unboundedPreceding, -1)
        starts, hits = (F.coalesce(F.sum(c).over(past), F.lit(0)) for c in ("__n", "__hit"))
        out |= {f"{prefix}_past_starts": starts.cast("long"), f"{prefix}_past_top3": hits.cast("long"), f"{prefix}_past_top3_rate": F.try_divide(hits, starts)}
        out |= {f"{prefix}_past_avg_{k}": F.try_divide(F.sum(f"__s{mean_of[c]}").over(past), F.sum(f"__c{mean_of[c]}").over(past)) for k, c in means.items()}
        for k, c in spans.items():
            out |= {f"{prefix}_past_min_{k}": F.min(f"__lo{span_of[c]}").over(past), f"{prefix}_past_max_{k}": F.max(f"__hi{span_of[c]}").over(past)}
    days = days.select(*grain, on, *[c.alias(n) for n, c in out.items()])
    if recents or last:
        tails = last_rows(source, lead, recents, last, name)
        if specs:
            days = days.join(tails, days[lead].eqNullSafe(F.col("__id")) & (days[on] == F.col("__of"))).drop("__id", "__of")
        else:
            days = tails.withColumnsRenamed({"__id": lead, "__of": on})
    days = days.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate([*grain, on])})
    same = F.col(on) == F.col(f"__k{len(grain)}")
    for i, k in enumerate(grain):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = df.join(days, same, "left").drop(*[f"__k{i}" for i in range(len(grain) + 1)])
    if last:
        joined = joined.withColumns({f"{name}_days_since_last": F.datediff("date", "__d"), f"{name}_distance_diff_prev": F.col("distance") - F.col(f"{name}_prev_distance")}).drop("__d")
    if missing is not None:
        joined = joined.withColumns({n: F.when(missing, F.lit(0).cast("long") if n.endswith(("_starts", "_top3")) else None).otherwise(F.col(n)) for n in out})
    return joined


def last_rows(source: DataFrame, lead: str, recents: list[tuple[int, dict[str, str]]], last: bool, name: str) -> DataFrame:
    """(__id, __of, the columns of ``recents`` and ``last``): for each day of an id, what its last rows of earlier days give.

    A day gives its last n rows at most, which are picked before the shuffle, and the n days
    before hold all that is asked for, so no window has more than n times n rows in a frame.
    The rows themselves go no further than their window: only figures are shuffled again.
    """
    on, n = day_of(source), max([n for n, _ in recents] + [1])
    columns = dict.fromkeys([c for _, means in recents for c in means.values()] + ["date", "distance"] * last)
    back = Window.partitionBy(lead, on).orderBy(F.desc("race_id"), F.desc("horse_number"))
    row = F.struct("race_id", "horse_number", *columns)
    kept = source.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n)
    day = kept.groupBy(F.col(lead).alias("__id"), F.col(on).alias("__of")).agg(F.sort_array(F.collect_list(counted(source, row))).alias("__rows"))
    before = Window.partitionBy("__id").orderBy("__of").rowsBetween(-n, -1)
    tail = F.flatten(F.collect_list("__rows").over(before))
    tails = day.select("__id", "__of", tail.alias("__all")).select("__id", "__of", F.slice("__all", F.greatest(F.lit(1), F.size("__all") - n + 1), F.lit(n)).alias("__tail"))
    out: dict[str, Column] = {}
    for k, means in recents:
        some = F.slice("__tail", F.greatest(F.lit(1), F.size("__tail") - k + 1), F.lit(k))
        out |= {recent_name(name, k, key): mean(some[c].cast("array<double>")) for key, c in means.items()}
    if last:
        out |= {"__d": F.try_element_at("__tail", F.lit(-1))["date"], f"{name}_prev_distance": F.try_element_at("__tail", F.lit(-1))["distance"]}
    return tails.select("__id", "__of", *[c.alias(x) for x, c in out.items()])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` stored, with a number for each row."""
    return saved(df.withColumn(ROW, F.monotonically_increasing_id()))


def histories(df: DataFrame, steps: list[dict], source: DataFrame | None = None) -> DataFrame:
    """``history_before`` of several ids; each step holds its parameters but for the rows. ``df`` is ``numbered``.

    A step shuffles no columns but its own: the few that it needs of each row meet its days,
    and what comes of it is stored by the row's number. At last all steps' figures join the
    rows, dealt by race, once each.
    """
    source = df if source is None else source
    out = df.repartition("race_id")
    for step in steps:
        own = [ROW, "race_id", day_of(source), step["lead"], *(k for _, keys, _, _ in step["specs"] for k in keys), *(["date", "distance"] if step.get("last") else [])]
        own = list(dict.fromkeys(own))
        part = history_before(df.select(*own), source=source, **step).drop(*[c for c in own if c not in (ROW, "race_id")])
        out = out.join(saved(part).repartition("race_id"), ["race_id", ROW])
    return out.drop(ROW)


def mean(values: Column) -> Column:
    """The mean of an array's values that aren't null; null without any."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, v: a + v), F.size(some))


def cumulative_before(df: DataFrame, prefix: str, keys: list[str], means: dict[str, str] | None = None, spans: dict[str, str] | None = None, missing: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """``history_before`` of one prefix."""
    return history_before(df, keys[0], [spec(prefix, *keys[1:], means=means, spans=spans)], missing=missing, source=source)


def recent_name(name: str, n: int, key: str) -> str:
    return f"{name}_recent{n}_top3_rate" if key == "top3" else f"{name}_recent{n}_avg_{key}"


def recent_before(df: DataFrame, prefix: str, key: str, n: int, means: dict[str, str]) -> DataFrame:
    """Adds the means of the last n rows alone."""
    return history_before(df, key, [], [(n, means)], name=prefix)


def global_prior(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Adds prior_starts and prior_top3, of all rows of earlier dates; dates are few, so the daily table is small."""
    source = df if source is None else source
    on = day_of(source)
    day = source.groupBy(on).agg(F.count(counted(source, F.lit(1))).alias("__n"), F.sum(counted(source, F.col("target_top3"))).alias("__hit"))
    past = Window.orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    before = day.select(on, F.coalesce(F.sum("__n").over(past), F.lit(0)).cast("long").alias("prior_starts"), F.coalesce(F.sum("__hit").over(past), F.lit(0)).cast("long").alias("prior_top3"))
    return df.join(F.broadcast(before), on)  # a row for each day of the calendar at most


def smooth(prefix: str) -> Column:
    """(top3 + 20 prior rate) / (starts + 20); the raw rate where there is no prior. One division of whole numbers, so that equal inputs give equal doubles."""
    starts, hits = F.col(f"{prefix}_past_starts"), F.col(f"{prefix}_past_top3")
    with_prior = F.try_divide(hits * F.col("prior_starts") + PRIOR_STARTS * F.col("prior_top3"), (starts + PRIOR_STARTS) * F.col("prior_starts"))
    return F.when(F.col("prior_starts") == 0, F.try_divide(hits, starts)).otherwise(with_prior)


def share_and_lift(df: DataFrame, owner: str, condition: str) -> DataFrame:
    """Adds the condition's share of its owner's starts and what its rate is above the owner's."""
    p, o = f"{owner}_{condition}", owner
    return df.withColumns({
        f"{p}_past_start_share": F.try_divide(F.col(f"{p}_past_starts"), F.col(f"{o}_past_starts")),
        f"{p}_past_top3_rate_lift": F.col(f"{p}_past_top3_rate") - F.col(f"{o}_past_top3_rate"),
    })


MEASURES = {"finish": "finish", "time_per_200": "time_per_200", "finish_diff": "finish_diff", "finish_3f": "finish_3f", "corner4": "corner_4"}


def fit(df: DataFrame) -> DataFrame:
    """Adds how distance and weight differ from the horse's earlier ones; needs horse means and spans."""
    d, lo, hi = F.col("distance"), F.col("horse_past_min_distance"), F.col("horse_past_max_distance")
    over = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0), x))
    return df.withColumns({
        "horse_distance_diff_avg": d - F.col("horse_past_avg_distance"),
        "horse_weight_diff_avg": F.col("weight") - F.col("horse_past_avg_weight"),
        "horse_distance_above_max": over(d - hi),
        "horse_distance_below_min": over(lo - d),
    })


def all_history(base: DataFrame, with_pedigree: bool = True) -> DataFrame:
    """Every history feature of the training dataset, from the rows of ``base_rows``."""
    own = numbered(base.withColumns({"time_per_200": F.try_divide(F.col("time_sec"), F.col("distance")) * 200, "distance_band": distance_band(F.col("distance"))}))
    conditions = {"horse": {"track": ["track_id"], "surface": ["surface_id"], "distance_band": ["distance_band"]}}
    conditions |= {o: {"track": ["track_id"], "surface": ["surface_id"], "course": ["track_id", "surface_id", "distance_band"]} for o in ("jockey", "trainer")}
    means = {"horse": {**MEASURES, "distance": "distance", "weight": "weight"}, "jockey": {"finish": "finish"}, "trainer": {"finish": "finish"}}
    partners = {"horse": ("jockey", "trainer"), "jockey": ("trainer",), "trainer": ()}
    recents = {"horse": [(n, {"top3": "target_top3", **MEASURES}) for n in (3, 5)], "jockey": [(20, {"top3": "target_top3", "finish": "finish"})], "trainer": [(20, {"top3": "target_top3", "finish": "finish"})]}
    steps = []
    for owner in ("horse", "jockey", "trainer"):
        specs = [spec(owner, means=means[owner], spans={"distance": "distance"} if owner == "horse" else None)]
        specs += [spec(f"{owner}_{kind}", *keys) for kind, keys in conditions[owner].items()] + [spec(f"{owner}_{b}", f"{b}_id") for b in partners[owner]]
        steps.append({"lead": f"{owner}_id", "specs": specs, "recents": recents[owner], "last": owner == "horse"})
    steps += pedigree_steps() if with_pedigree else []
    df = histories(own.where(LIVE) if LIVE in own.columns else own, steps, own)
    for owner in conditions:
        for kind in conditions[owner]:
            df = share_and_lift(df, owner, kind)
    df = global_prior(fit(df), own)
    return smoothed_pedigree(df) if with_pedigree else df


def pedigree_steps(conditions: bool = True) -> list[dict]:
    """History of sires, dams and broodmare sires, alone and by condition; an unknown one has none."""
    steps = []
    for kind in ("sire", "dam", "broodmare_sire"):
        key = f"{kind}_id"
        specs = [spec(kind, means={"finish": "finish"})]
        if conditions and kind != "dam":
            specs += [spec(f"{kind}_{name}", column) for name, column in {"track": "track_id", "surface": "surface_id", "distance_band": "distance_band"}.items()]
        steps.append({"lead": key, "specs": specs, "missing": missing_key([key])})
    return steps


def smoothed_pedigree(df: DataFrame, conditions: bool = True) -> DataFrame:
    """Adds the smoothed rates of ``pedigree_steps``; needs ``global_prior``."""
    for step in pedigree_steps(conditions):
        df = df.withColumns({f"{p}_past_top3_rate_smooth": F.when(~step["missing"], smooth(p)) for p, *_ in step["specs"]})
    return df
