"""Queries of joined rows, datasets and race-relative features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators import base, relative
from paddock.plans.registry import query
from paddock.sources.adapter import Tables
from paddock.sources.scratch import kept

BASE = """SELECT u.race_id, u.horse_number, u.finish, u.horse_id, u.jockey_id, u.trainer_id, u.gate, u.age, u.weight, u.time_sec, u.finish_diff, u.finish_3f, u.corner_4, r.date, r.track_id, r.surface_id, r.distance, r.track_condition_id, r.race_number, r.post_time_min, r.course_direction_id, r.course_layout_id, r.course_variant_id, r.weather_id, u.sex_id, u.stable_id, u.horse_weight, u.horse_weight_diff, u.popularity, h.horse_name, p.odds_min AS place_odds_min, p.odds_max AS place_odds_max, w.odds AS win_odds, h.sire_id, h.dam_id, h.broodmare_sire_id, CASE WHEN h.pedigree_fetch_status = 'fetched' THEN 1 ELSE 0 END AS pedigree_available, CASE WHEN u.finish <= 3 THEN 1 ELSE 0 END AS target_top3
FROM runner u JOIN race r ON u.race_id = r.race_id LEFT JOIN place_odds p ON p.race_id = u.race_id AND p.horse_number = u.horse_number LEFT JOIN win_odds w ON w.race_id = u.race_id AND w.horse_number = u.horse_number LEFT JOIN horse h ON h.horse_id = u.horse_id WHERE u.status_id = 0 AND u.finish IS NOT NULL"""
B = ("base", BASE)
SHOWN = "race_id, horse_number, date, finish, target_top3, track_id, distance, place_odds_min, place_odds_max, win_odds, sire_id, pedigree_available"
COLUMNS = SHOWN.split(", ")


def rows(t: Tables) -> DataFrame:
    return base.quoted_rows(t.quoted, t.race, t.horse)


@query(f"SELECT {SHOWN} FROM base", B)
def base_rows(t: Tables) -> DataFrame:
    return rows(t).select(*COLUMNS)


@query("SELECT race_id, horse_number, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS target_top3 FROM base", B)
def label_win(t: Tables) -> DataFrame:
    return base.with_win_label(rows(t)).select("race_id", "horse_number", "target_top3")


@query("SELECT race_id, horse_number, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS target_top3, win_odds AS place_odds_min, win_odds AS place_odds_max FROM base", B)
def odds_win_compat(t: Tables) -> DataFrame:
    return base.win_odds_as_place(rows(t)).select("race_id", "horse_number", "target_top3", "place_odds_min", "place_odds_max")


# The columns of the evaluation dataset.
EVAL = [
    "race_id", "date", "track_id", "race_number", "post_time_min", "surface_id", "distance", "course_direction_id", "course_layout_id", "course_variant_id", "weather_id", "track_condition_id", "race_size", "gate", "horse_number",
    "horse_id", "horse_name", "sex_id", "age", "jockey_id", "weight", "popularity", "stable_id", "trainer_id", "horse_weight", "horse_weight_diff", "place_odds_min", "place_odds_max", "target_top3",
]


@query(f"SELECT {', '.join(EVAL)} FROM (SELECT *, CAST(count(*) OVER (PARTITION BY race_id) AS INT) AS race_size FROM base)", B)
def ds_eval_odds(t: Tables) -> DataFrame:
    return rows(t).withColumn("race_size", F.count(F.lit(1)).over(Window.partitionBy("race_id")).cast("int")).select(*EVAL)


@query()
def ds_training(t: Tables) -> DataFrame:
    """Every feature; too wide for one SQL twin, its parts have theirs."""
    return base.guard(base.training(rows(t)))


@query("SELECT race_id, race_number, post_time_min, course_direction_id, course_layout_id, course_variant_id, weather_id, CAST(count(*) OVER (PARTITION BY race_id) AS INT) AS race_size, gate, horse_number, horse_id, horse_name, sex_id, age, weight, stable_id, target_top3 FROM base", B)
def ds_training_plain(t: Tables) -> DataFrame:
    df = base.drop_patterns(base.training(rows(t), with_history=False), ["sire", "pedigree", "track", "surface", "distance", "date", "jockey", "trainer", "dam"])
    return base.guard(df)


LIVE = "date >= DATE '2000-10-01'"
EARLY = "date < DATE '2000-10-01'"


def _known(owner: str) -> str:
    return f"(SELECT {owner}_id AS id, count(*) AS n, sum(target_top3) AS k, avg(finish) AS f FROM base WHERE {EARLY} GROUP BY 1)"


@query(
    "SELECT u.race_id, u.horse_number, " + ", ".join(f"coalesce({o}.n, 0) AS {o}_past_starts, CAST(coalesce({o}.k, 0) AS BIGINT) AS {o}_past_top3, {o}.k / {o}.n::DOUBLE AS {o}_past_top3_rate, {o}.f AS {o}_past_avg_finish" for o in ("horse", "jockey", "trainer"))
    + ", CAST(u.date - l.d AS INT) AS horse_days_since_last, l.r AS horse_recent3_avg_finish, u.weight - avg(u.weight) OVER (PARTITION BY u.race_id) AS race_weight_diff FROM (SELECT * FROM base WHERE " + LIVE + ") u "
    + " ".join(f"LEFT JOIN {_known(o)} {o} ON {o}.id IS NOT DISTINCT FROM u.{o}_id" for o in ("horse", "jockey", "trainer"))
    + f" LEFT JOIN (SELECT horse_id, max(date) AS d, avg(finish) AS r FROM (SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY date DESC, race_id DESC, horse_number DESC) AS back FROM base WHERE {EARLY}) WHERE back <= 3 GROUP BY 1) l ON l.horse_id = u.horse_id",
    B,
)
def ds_live(t: Tables) -> DataFrame:
    """The whole training dataset for races to come, built through the same history; some of its columns are shown."""
    df = kept(rows(t))
    live = base.live_features(df.where(EARLY), df.where(LIVE))
    shown = [f"{o}_past_{x}" for o in ("horse", "jockey", "trainer") for x in ("starts", "top3", "top3_rate", "avg_finish")]
    return live.select("race_id", "horse_number", *shown, "horse_days_since_last", "horse_recent3_avg_finish", "race_weight_diff")


REL = ("weight", "finish_diff", "time_sec", "corner_4")


@query("SELECT race_id, horse_number, " + ", ".join(f"round({c} - avg({c}) OVER (PARTITION BY race_id), 6) AS race_{c}_diff" for c in REL) + " FROM base", B)
def rel_diff(t: Tables) -> DataFrame:
    df = relative.relative(rows(t).select("race_id", "horse_number", *REL), {c: True for c in REL})
    return df.select("race_id", "horse_number", *[F.round(f"race_{c}_diff", 6).alias(f"race_{c}_diff") for c in REL])


def _rank(c: str, up: bool) -> str:
    v = f"coalesce({c}, -1)"
    w = "PARTITION BY race_id"
    order = "ASC" if up else "DESC"
    return f"rank() OVER ({w} ORDER BY {v} {order}) + (count(*) OVER ({w}, {v}) - 1) / 2.0::DOUBLE AS race_{c}_rank"


@query("SELECT race_id, horse_number, " + ", ".join(_rank(c, c != "weight") for c in REL) + " FROM base", B)
def rel_rank(t: Tables) -> DataFrame:
    df = relative.relative(rows(t).select("race_id", "horse_number", *REL), {c: c != "weight" for c in REL})
    return df.select("race_id", "horse_number", *[f"race_{c}_rank" for c in REL])
