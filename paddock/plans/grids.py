"""The whole searches with rank and expected value conditions, and the win profile's, over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import cube
from paddock.plans.registry import query
from paddock.plans.rules import S, scored_once
from paddock.sources.adapter import Tables
from paddock.sources.scratch import saved

TOP, GATES = 500, {"min_selections": 20, "min_fold_selections": 2}
#: What the win profile searches: win odds in the place of place odds, and wins.
WIN_ROWS = ("w", """SELECT p.race_id, p.horse_number, p.fold, p.track_id, p.surface_id, p.distance, CAST(CASE WHEN u.finish = 1 THEN 1 ELSE 0 END AS INT) AS target_top3, p.pred_top3 / 2 AS pred_top3, o.odds AS place_odds_min, o.odds AS place_odds_mid, o.odds AS place_odds_max
FROM predictions p JOIN runner u ON u.race_id = p.race_id AND u.horse_number = p.horse_number JOIN win_odds o ON o.race_id = p.race_id AND o.horse_number = p.horse_number""")
WIN_S = ("s", S[1].replace("FROM predictions", "FROM w"))


def steps(rows: str, profile: str) -> str:
    """SQL that turns one dimension after the other from cut points into options, given as a table of them."""
    preds, odds, distances, ranks, evs = cube.PROFILES[profile]
    bounds = {"pred_top3": [(p, None) for p in preds], "place_odds_mid": odds, "distance": distances, "pred_rank": [(None, k and k + 1) for k in ranks], "expected_value_mid": [(e, None) for e in evs]}
    sql, tables, number = [], [], "0"
    paid = ", ".join(f"CAST(sum(CASE WHEN target_top3 = 1 THEN CAST(round(place_odds_{m} * 1000000) AS BIGINT) ELSE 0 END) AS BIGINT) AS paid_{m}" for m in ("min", "mid", "max"))
    cuts = {c: sorted({x for b in own for x in b if x is not None}) for c, own in bounds.items()}
    level = lambda c: f"CASE WHEN {c} IS NULL THEN -1 ELSE {' + '.join(f'CAST({c} >= {x} AS INT)' for x in cuts[c]) or '0'} END AS {c}"
    dims = ["pred_top3", "place_odds_mid", "distance", "track_id", "surface_id", "pred_rank", "expected_value_mid"]
    plain = ", ".join(c if c in ("track_id", "surface_id") else level(c) for c in dims)
    sql.append(f"g0 AS (SELECT fold, {plain}, 0 AS rule, count(*) AS n, CAST(sum(target_top3) AS BIGINT) AS hits, {paid} FROM {rows} GROUP BY ALL)")
    for k, c in enumerate(dims, 1):
        if c == "track_id":
            on = " OR ".join(f"(i = {i} AND {'TRUE' if t == (None, None) else f'track_id IN {t[0]}' if t[0] else f'(track_id IS NULL OR track_id NOT IN {t[1]})'})" for i, t in enumerate(cube.TRACKS.values()))
            size, table = len(cube.TRACKS), f"(SELECT unnest(range({len(cube.TRACKS)})) AS i)"
        elif c == "surface_id":
            size, table, on = 3, "(SELECT unnest(range(3)) AS i)", "i = 0 OR surface_id = i - 1"
        else:
            index = lambda x, c=c: cuts[c].index(x)
            ends = [(i, -1 if (low, high) == (None, None) else 0 if low is None else index(low) + 1, 99 if high is None else index(high)) for i, (low, high) in enumerate(bounds[c])]
            size, table, on = len(ends), "(SELECT * FROM (VALUES " + ", ".join(map(str, ends)) + ") AS v(i, low, high))", f"{c} BETWEEN low AND high"
        rest = "".join(f"{x}, " for x in dims[k:])
        sql.append(f"g{k} AS (SELECT fold, {rest}rule * {size} + i AS rule, sum(n) AS n, sum(hits) AS hits, sum(paid_min) AS paid_min, sum(paid_mid) AS paid_mid, sum(paid_max) AS paid_max FROM g{k - 1} JOIN {table} o ON {on} GROUP BY ALL)")
        tables.append((c, size))
    # The options of a rule's number, and what the best rules take of the rows.
    at, below = {}, 1
    for c, size in reversed(tables):
        at[c] = f"CAST((rule // {below}) % {size} AS INT) + 1"
        below *= size
    value = lambda x: "NULL" if x is None else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)
    pick = lambda xs, c: f"([{', '.join(map(value, xs))}])[{at[c]}]"
    text = lambda xs: [repr(x)[1:-1] for x in xs]
    quoted = lambda xs, c: "([" + ", ".join(f"'{x}'" for x in text(xs)) + f"])[{at[c]}]"
    fields = {"pred_min": pick(preds, "pred_top3"), "odds_min": pick([o[0] for o in odds], "place_odds_mid"), "odds_max": pick([o[1] for o in odds], "place_odds_mid"), "distance_min": pick([d[0] for d in distances], "distance"),
              "distance_max": pick([d[1] for d in distances], "distance"), "track_label": quoted(list(cube.TRACKS), "track_id"), "surface_id": pick([None, 0, 1], "surface_id"), "pred_rank_max": pick(ranks, "pred_rank"), "ev_mid_min": pick(evs, "expected_value_mid") if evs != (None,) else "CAST(NULL AS DOUBLE)"}
    key = " || '|' || ".join([quoted([f"pred>={p:.2f}" for p in preds], "pred_top3"), quoted([f"odds=[{a:.1f},{b:.1f})" for a, b in odds], "place_odds_mid"), quoted([f"distance=[{a},{b})" for a, b in distances], "distance"), quoted([f"track={x}" for x in cube.TRACKS], "track_id"), quoted(["surface=all", "surface=0", "surface=1"], "surface_id"), quoted(["rank=all" if k is None else f"rank=<={k}" for k in ranks], "pred_rank"), quoted(["ev_mid=all" if e is None else f"ev_mid=>={e:.1f}" for e in evs], "expected_value_mid")])
    percent = lambda money, n: f"CAST((200 * {money} + {n}) // (2 * {n}) AS DOUBLE) / 1000000"
    sql.append(f"""best AS (SELECT rule, CAST(sum(n) AS BIGINT) AS selections, CAST(sum(hits) AS BIGINT) AS hits, {percent('sum(hits) * 1000000', 'sum(n)')} AS hit_rate_pct, {", ".join(f"{percent(f'sum(paid_{m})', 'sum(n)')} AS return_{m}_pct" for m in ("min", "mid", "max"))},
  min({percent('paid_mid', 'n')}) AS min_fold_return_mid_pct, max({percent('paid_mid', 'n')}) AS max_fold_return_mid_pct, CAST(min(n) AS BIGINT) AS min_fold_selections FROM g7 GROUP BY rule
  HAVING count(*) = (SELECT count(DISTINCT fold) FROM {rows}) AND sum(n) >= {GATES['min_selections']} AND min(n) >= {GATES['min_fold_selections']} ORDER BY return_mid_pct DESC, min_fold_return_mid_pct DESC, selections DESC, rule LIMIT {TOP})""")
    sql.append(f"named AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in fields.items())}, {key} AS rule_key FROM best)")
    inside = " OR ".join(f"(track_label = '{k}' AND {'TRUE' if t == (None, None) else f'track_id IN {t[0]}' if t[0] else f'(track_id IS NULL OR track_id NOT IN {t[1]})'})" for k, t in cube.TRACKS.items())
    sql.append(f"""taken AS (SELECT rule, count(DISTINCT race_id) AS races FROM named b JOIN (SELECT race_id, pred_top3, place_odds_mid, distance, track_id, surface_id AS surface, pred_rank, expected_value_mid FROM {rows}) x ON pred_top3 >= pred_min AND place_odds_mid >= odds_min AND place_odds_mid < odds_max
  AND (distance_min IS NULL OR distance >= distance_min) AND (distance_max IS NULL OR distance < distance_max) AND (b.surface_id IS NULL OR surface = b.surface_id) AND (pred_rank_max IS NULL OR pred_rank <= pred_rank_max) AND (ev_mid_min IS NULL OR expected_value_mid >= ev_mid_min) AND ({inside}) GROUP BY rule)""")
    r = ", ".join(("hit_rate_pct", "return_min_pct", "return_mid_pct", "return_max_pct", "min_fold_return_mid_pct", "max_fold_return_mid_pct"))
    return ",\n".join(sql) + f"\nSELECT rule, rule_key, {', '.join(fields)}, races, selections, hits, {r}, min_fold_selections, {percent('races * 1000000', 'total')} AS buy_rate_pct FROM named JOIN taken USING (rule) CROSS JOIN (SELECT count(DISTINCT race_id) AS total FROM {rows})"


def twin(profile: str) -> str:
    return "SELECT * FROM (WITH " + steps("s", profile) + ")"


def best(df: DataFrame, profile: str) -> DataFrame:
    return cube.search(df, cube.grid(*cube.PROFILES[profile]), **GATES, top=TOP)


@query(twin("place"), S)
def rule_search_grid(t: Tables) -> DataFrame:
    """The best of all 315,000 rules of the place profile with rank and expected value conditions."""
    return best(scored_once(t), "place")


@query(twin("win"), WIN_ROWS, WIN_S)
def rule_search_win(t: Tables) -> DataFrame:
    """The best of all 169,344 rules of the win profile."""
    return best(scored_wins(t), "win")


def scored_wins(t: Tables) -> DataFrame:
    from paddock.operators.rules import enriched

    won = F.when(F.col("finish") == 1, 1).otherwise(0)
    rows = t.predicted.select("race_id", "horse_number", "date", "fold", "track_id", "surface_id", "distance", won.alias("target_top3"), (F.col("pred_top3") / 2).alias("pred_top3"), *[F.col("win_odds").alias(f"place_odds_{m}") for m in ("min", "mid", "max")])
    return saved(enriched(rows))
