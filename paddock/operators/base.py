"""Joined rows, labels and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators import columns, history
from paddock.operators.relative import relative, specs

#: Names that training data may not hold: they are known only at or after the post.
LEAKS = ("popularity", "odds")
KEYS = ["race_id", "horse_number"]


def base_rows(runner: DataFrame, race: DataFrame, place_odds: DataFrame, win_odds: DataFrame, horse: DataFrame) -> DataFrame:
    """Finished runners with race, odds and pedigree; the label is a finish among the first three."""
    place = place_odds.select(*KEYS, F.col("odds_min").alias("place_odds_min"), F.col("odds_max").alias("place_odds_max"))
    quoted = runner.join(place, KEYS, "left").join(win_odds.withColumnRenamed("odds", "win_odds"), KEYS, "left")
    return quoted_rows(quoted, race, horse)


def quoted_rows(quoted: DataFrame, race: DataFrame, horse: DataFrame) -> DataFrame:
    """``base_rows`` of runners that have their odds beside them."""
    ped = horse.select("horse_id", "horse_name", "sire_id", "dam_id", "broodmare_sire_id", (F.col("pedigree_fetch_status") == "fetched").cast("int").alias("__p"))
    rows = quoted.where("status_id = 0 AND finish IS NOT NULL").join(race, "race_id").join(ped, "horse_id", "left")
    return rows.withColumns({"pedigree_available": F.coalesce("__p", F.lit(0)), "target_top3": (F.col("finish") <= 3).cast("int")}).drop("__p")


def with_win_label(df: DataFrame) -> DataFrame:
    """The label as a win, after history has been built on the first three."""
    return df.withColumn("target_top3", (F.col("finish") == 1).cast("int"))


def win_odds_as_place(df: DataFrame) -> DataFrame:
    """Win odds in the places of both place odds, with the win label, so that place tools evaluate wins."""
    return with_win_label(df).withColumns({"place_odds_min": F.col("win_odds"), "place_odds_max": F.col("win_odds")})


def training(base: DataFrame, with_history: bool = True, with_pedigree: bool = True, beside: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``columns.training``, in order: keys, race and runner, pedigree and history with its race-relative twins, if wanted, and the label; of live rows alone if there are some. ``beside`` names columns of ``base`` that come after them."""
    names = columns.training(with_pedigree, with_history)
    size = F.count(F.lit(1)).over(Window.partitionBy("race_id")).cast("int")
    if not with_history:
        return base.withColumn("race_size", size).select(*names, *beside)
    df = history.all_history(base, with_pedigree)
    plain, bred = columns.twins_of()
    wanted = plain + (bred if with_pedigree else [])
    needed = [c for c in names if not c.startswith("race_") or c in columns.PLAIN]
    return relative(df.withColumn("race_size", size).select(*needed, *beside), specs(wanted)).select(*names, *beside)


def guard(df: DataFrame) -> DataFrame:
    """``df`` itself; refuses columns that leak what isn't known before the race."""
    bad = sorted(c for c in df.columns if any(x in c for x in LEAKS))
    if bad:
        raise ValueError(f"training data holds {', '.join(bad)}")
    return df


def drop_patterns(df: DataFrame, patterns: list[str], protected: list[str] = KEYS) -> DataFrame:
    return df.drop(*[c for c in df.columns if c not in protected and any(p in c for p in patterns)])


#: What is known of a runner only after its race.
AFTER = ("finish", "time_sec", "finish_diff", "finish_3f", "corner_4", "popularity", "horse_weight", "horse_weight_diff", "win_odds", "place_odds_min", "place_odds_max")


def live_features(past: DataFrame, future: DataFrame) -> DataFrame:
    """The training dataset's columns for ``future`` rows (base rows without results) from the history of ``past``.

    Future rows count for no one, so all of them stand on the first future day, as of which
    their history is taken; results that they may carry are blanked first.
    """
    blank = future.withColumns({c: F.lit(None).cast(future.schema[c].dataType) for c in AFTER if c in future.columns} | {"target_top3": F.lit(0)})
    first = future.agg(F.min("date")).first()[0]
    both = past.withColumns({history.LIVE: F.lit(False), history.AS_OF: F.col("date")}).unionByName(blank.withColumns({history.LIVE: F.lit(True), history.AS_OF: F.lit(first).cast("date")}))
    return training(both)
