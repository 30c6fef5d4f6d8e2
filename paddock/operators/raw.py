"""Raw race documents to typed tables and rejects, from one scan.

A document is read once. All six parts become one typed struct, with the keys that could not
be read beside them; this is stored once, and every table is a projection of what is stored.
A race with any reason against it goes to the rejects as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import normalize as n
from paddock.sources.io import RACE_FIELDS, RUNNER_FIELDS
from paddock.sources.scratch import saved

TEXTS = "map<string,string>"
#: Maps tell a key that a document lacks from one whose value is null.
DOCUMENT = f"race {TEXTS}, runners array<{TEXTS}>, odds struct<win: {TEXTS}, place: {TEXTS}, wide: {TEXTS}, trio: {TEXTS}>, broken string"
TABLES = ("race", "runner", "win", "place", "wide", "trio", "rejects")


@dataclass(frozen=True)
class Field:
    """How one key of a document is read: to columns by name, from its text and the race's id.

    ``judged`` names the columns that must have a value where the text has one; a ``needed``
    key must have a text as well.
    """

    key: str
    read: Callable[[Column, Column], dict[str, Column]]
    judged: tuple[str, ...] = ()
    needed: bool = False


def plain(name: str, needed: bool = False) -> Field:
    return Field(name, lambda text, _: {name: text}, needed=needed)


def coded(key: str, table: dict, needed: bool = False) -> Field:
    return Field(key, lambda text, _: {f"{key}_id": n.code(text, table)}, (f"{key}_id",), needed)


def parsed(key: str, parse: Callable[[Column], Column], name: str | None = None, needed: bool = False) -> Field:
    return Field(key, lambda text, _: {name or key: parse(text)}, (name or key,), needed)


def both(names: tuple[str, str], parse: Callable[[Column], tuple[Column, Column]]) -> Callable[[Column, Column], dict[str, Column]]:
    return lambda text, _: dict(zip(names, parse(text)))


def margin(text: Column, _: Column) -> dict[str, Column]:
    return {"finish_diff": n.margin(text), "margin_read": F.when(text == n.NO_MARGIN, 0.0).otherwise(n.margin(text))}


def corner_places(text: Column, _: Column) -> dict[str, Column]:
    places = n.corners(text)
    return {f"corner_{i + 1}": F.get(places, F.lit(i)) for i in range(4)} | {"corner_count": F.when(text.isNotNull(), F.size(places))}


RACE = (
    plain("race_id", needed=True), Field("date", lambda text, race_id: {"date": n.race_date(text, race_id)}, ("date",), True), coded("track", n.TRACK, True),
    parsed("race_number", n.integer, needed=True), parsed("post_time", n.minutes_of_day, "post_time_min"), coded("surface", n.SURFACE), parsed("distance", n.integer),
    coded("course_direction", n.DIRECTION), coded("course_layout", n.LAYOUT), coded("course_variant", n.VARIANT), coded("weather", n.WEATHER),
    coded("track_condition", n.CONDITION), parsed("race_size", n.integer),
)
RUNNER = (
    parsed("gate", n.integer), parsed("horse_number", n.integer), Field("finish", both(("finish", "status_id"), n.finish), ("status_id",), True),
    plain("horse_name", needed=True), plain("horse_id"), Field("sex_age", both(("sex_id", "age"), n.sex_age), ("sex_id", "age")), plain("jockey_raw"), plain("jockey_id"),
    parsed("weight", n.number), parsed("time", n.seconds, "time_sec"), Field("finish_diff", margin, ("margin_read",)), parsed("popularity", n.integer), parsed("finish_3f", n.number),
    Field("corner", corner_places), Field("trainer_raw", both(("stable_id", "trainer_raw"), n.trainer)), plain("trainer_id"),
    Field("horse_weight", both(("horse_weight", "horse_weight_diff"), n.body_weight), ("horse_weight",)),
)
assert tuple(f.key for f in RACE) == RACE_FIELDS and tuple(f.key for f in RUNNER) == RUNNER_FIELDS
#: Columns that only say whether a text was read.
ONLY_JUDGED = {"margin_read"}


def typed(row: Column, fields: tuple[Field, ...], race_id: Column, part: str) -> Column:
    """A struct of a map's typed values, with ``bad``: the reasons, as ``part.key``, and ``part.missing`` where the map or one of its keys is missing."""
    values, bad = {}, [F.when(F.coalesce(F.exists(F.lit([f.key for f in fields]), lambda k: ~F.map_contains_key(row, k)), F.lit(True)), F.lit(f"{part}.missing"))]
    for field in fields:
        text = F.try_element_at(row, F.lit(field.key))
        own = field.read(text, race_id)
        values |= own
        wrong = F.lit(False)
        for name in field.judged:
            wrong = wrong | (text.isNotNull() & own[name].isNull())
        bad.append(F.when(wrong | text.isNull() if field.needed else wrong, F.lit(f"{part}.{field.key}")))
    kept = [c.alias(name) for name, c in values.items() if name not in ONLY_JUDGED]
    return F.struct(*kept, F.array_compact(F.array(*bad)).alias("bad"))


def odds_rows(block: Column, part: str, horses: int, span: bool) -> Column:
    """An array of typed odds of a block, with ``bad``; the block's keys are one, two or three horse numbers."""

    def one(entry: Column) -> Column:
        numbers = n.combination(entry["key"], horses)
        names = ["horse_number"] if horses == 1 else [f"horse_number_{i + 1}" for i in range(horses)]
        text = entry["value"]
        texts = F.split(text, "-") if span else F.array(text)
        values = F.transform(texts, lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("double"))
        read = (F.size(texts) == (2 if span else 1)) & ~F.exists(values, lambda v: v.isNull())
        wrong = ~F.coalesce(text.startswith("-") | read, F.lit(False))
        if span:
            odds = [c.alias(name) for name, c in zip(("odds_min", "odds_max"), n.odds_range(text))]
        else:
            odds = [n.odds(text).alias("odds")]
        bad = F.array_compact(F.array(F.when(numbers.isNull(), F.lit(f"{part}.numbers")), F.when(wrong, F.lit(f"{part}.odds"))))
        return F.struct(*[F.get(numbers, F.lit(i)).alias(name) for i, name in enumerate(names)], *odds, bad.alias("bad"))

    return F.transform(F.map_entries(block), one)


ODDS = {"win": (1, False), "place": (1, True), "wide": (2, True), "trio": (3, False)}


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents as maps of texts with their file; one that isn't JSON has only its text, in ``broken``."""
    read = spark.read.schema(DOCUMENT).option("columnNameOfCorruptRecord", "broken").option("multiLine", multi_line).json(path)
    return read.select("race", "runners", "odds", "broken", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("read_at"))


def typed_documents(documents: DataFrame) -> DataFrame:
    """(race_id, source, read_at, broken, race, runners, win, place, wide, trio, reasons) of ``read_documents`` rows; reasons are distinct and sorted."""
    race_id = F.try_element_at("race", F.lit("race_id"))
    runners = F.transform("runners", lambda row: typed(row, RUNNER, race_id, "runners"))
    df = documents.select(
        race_id.alias("race_id"), "source", "read_at", "broken", typed(F.col("race"), RACE, race_id, "race").alias("race"), runners.alias("runners"),
        *[odds_rows(F.col(f"odds.{part}"), part, *shape).alias(part) for part, shape in ODDS.items()],
    )
    lists = ["runners", *ODDS]
    absent = [F.when(F.col(part).isNull(), F.lit(f"{part}.missing")) for part in lists]
    inside = [F.flatten(F.transform(F.coalesce(F.col(part), F.array()), lambda x: x["bad"])) for part in lists]
    reasons = F.array_sort(F.array_distinct(F.concat(F.col("race.bad"), F.array_compact(F.array(*absent)), *inside)))
    return df.withColumn("reasons", F.when(F.col("broken").isNotNull(), F.array(F.lit("document"))).otherwise(reasons))


def tables_of(judged: DataFrame, only: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The seven tables of ``typed_documents`` rows, or the named ones."""
    good = judged.where(F.size("reasons") == 0)
    columns = lambda part: [c for c in judged.schema[part].dataType.elementType.names if c != "bad"]
    rows = lambda part: lambda: good.select("race_id", "read_at", F.explode(part).alias("x")).select("race_id", *[f"x.{c}" for c in columns(part)], "read_at")
    make = {"race": lambda: good.select("race.*", "read_at").drop("bad"), "runner": rows("runners")}
    make |= {part: rows(part) for part in ODDS}
    make["rejects"] = lambda: judged.where(F.size("reasons") > 0).select("race_id", "reasons", "source", "read_at", "broken")
    return {part: make[part]() for part in TABLES if part in only}


def needed(judged: DataFrame, only: tuple[str, ...]) -> DataFrame:
    """What the named tables read of ``typed_documents`` rows."""
    parts = ["runners" if part == "runner" else part for part in only if part != "rejects"]
    return judged.select("race_id", "read_at", "reasons", *parts, *(["source", "broken"] if "rejects" in only else []))


def ingest(spark: SparkSession, path: str, multi_line: bool = True, only: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The documents under ``path`` as tables race, runner, win, place, wide, trio and rejects, from one scan.

    ``only`` names the tables that are wanted: documents are judged as a whole all the same,
    but no more is stored than those tables read.

    A race is accepted only if all of its 13 keys, the 17 keys of each runner and all odds can
    be read; ``rejects`` has the others once each, with all reasons, such as ``runners.finish``,
    ``win.odds``, ``trio.numbers``, ``race.missing`` for a missing key, ``document`` for what
    isn't JSON. Null values pass unless the key needs one (race id, date, track, race number,
    finish, horse name); null odds don't. A key that the document has beyond these is ignored.
    Documents that repeat a race give its rows each, with the time of their file (``read_at``)
    as the order for an upsert. No document gives empty tables.
    """
    return tables_of(saved(needed(typed_documents(read_documents(spark, path, multi_line)), only)), only)
