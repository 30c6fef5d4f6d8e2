"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Shape of a raw race document; all values are text.
RACE_FIELDS = ("race_id", "date", "track", "race_number", "post_time", "surface", "distance", "course_direction", "course_layout", "course_variant", "weather", "track_condition", "race_size")
RUNNER_FIELDS = ("gate", "horse_number", "finish", "horse_name", "horse_id", "sex_age", "jockey_raw", "jockey_id", "weight", "time", "finish_diff", "popularity", "finish_3f", "corner", "trainer_raw", "trainer_id", "horse_weight")
RAW = "race struct<{}>, runners array<struct<{}>>, odds struct<win: map<string,string>, place: map<string,string>, wide: map<string,string>, trio: map<string,string>>".format(*(", ".join(f"{f}: string" for f in fields) for fields in (RACE_FIELDS, RUNNER_FIELDS)))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).option("multiLine", True).json(path)


def read_tables(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base}/{n}.parquet") for n in names}


def only_races(df: DataFrame, races: DataFrame) -> DataFrame:
    """The rows of the given races, by a semi join where a list of ids would be too long."""
    return df.join(races.select("race_id"), "race_id", "left_semi")


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def read_predictions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
