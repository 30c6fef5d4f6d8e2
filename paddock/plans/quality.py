"""Queries of quality and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators import coverage as c
from paddock.plans.registry import query
from paddock.sources.adapter import Tables

SIX = ("race", "runner", "win_odds", "place_odds", "wide_odds", "trio_odds")


@query(" UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in SIX))
def q_counts(t: Tables) -> DataFrame:
    return c.long_report([getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name in SIX])


@query("SELECT r.race_id, race_size, coalesce(n, 0) AS runners FROM (SELECT race_id, 1 + race_number % 7 AS race_size FROM race) r LEFT JOIN (SELECT race_id, count(*) AS n FROM runner GROUP BY 1) u ON r.race_id = u.race_id WHERE coalesce(n, 0) <> race_size")
def q_size_mismatch(t: Tables) -> DataFrame:
    n = t.runner.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))
    race = t.race.select("race_id", (1 + F.col("race_number") % 7).alias("race_size"))
    return race.join(n, "race_id", "left").select("race_id", "race_size", F.coalesce("n", F.lit(0)).alias("runners")).where("runners <> race_size")


@query("SELECT race_id FROM race WHERE race_id NOT IN (SELECT race_id FROM win_odds UNION SELECT race_id FROM place_odds UNION SELECT race_id FROM wide_odds UNION SELECT race_id FROM trio_odds)")
def q_no_odds(t: Tables) -> DataFrame:
    seen = c.long_report([getattr(t, name).select("race_id").distinct() for name in SIX[2:]])
    return t.race.select("race_id").join(seen, "race_id", "left_anti")


@query("SELECT count(*) FILTER (WHERE status_id = 0) AS finished, count(*) FILTER (WHERE finish <= 3) AS placed, round(100.0 * count(*) FILTER (WHERE finish <= 3) / count(*) FILTER (WHERE status_id = 0), 6) AS placed_pct, count(*) FILTER (WHERE status_id <> 0) AS not_finished FROM runner")
def q_placed_rate(t: Tables) -> DataFrame:
    n = t.runner.agg(F.count_if(F.col("status_id") == 0).alias("finished"), F.count_if(F.col("finish") <= 3).alias("placed"), F.count_if(F.col("status_id") != 0).alias("not_finished"))
    return n.withColumn("placed_pct", c.percent(F.col("placed"), F.col("finished")))


@query("SELECT bet_type, total, covered, round(100.0 * covered / total, 6) AS pct, total - covered AS missing FROM (SELECT 'win' AS bet_type, count(*) AS total, count(o.odds) AS covered FROM runner u LEFT JOIN win_odds o USING (race_id, horse_number) UNION ALL SELECT 'place', count(*), count(o.h) FROM runner u LEFT JOIN (SELECT race_id, horse_number, 1 AS h FROM place_odds) o USING (race_id, horse_number))")
def q_runner_coverage(t: Tables) -> DataFrame:
    keys = ["race_id", "horse_number"]
    return c.long_report([c.covered(t.runner, t.win_odds, keys, "win"), c.covered(t.runner, t.place_odds, keys, "place")])


@query("SELECT bet_type, total, covered, round(100.0 * covered / total, 6) AS pct, total - covered AS missing FROM (SELECT 'wide' AS bet_type, (SELECT count(*) FROM race) AS total, (SELECT count(DISTINCT race_id) FROM wide_odds WHERE race_id IN (SELECT race_id FROM race)) AS covered UNION ALL SELECT 'trio', (SELECT count(*) FROM race), (SELECT count(DISTINCT race_id) FROM trio_odds WHERE race_id IN (SELECT race_id FROM race)))")
def q_race_coverage(t: Tables) -> DataFrame:
    return c.long_report([c.covered(t.race, t.wide_odds, ["race_id"], "wide"), c.covered(t.race, t.trio_odds, ["race_id"], "trio")])


CHECKS = {
    "win_odds_positive": ("win_odds", "NOT odds > 5"),
    "place_min_above_max": ("place_odds", "odds_min > odds_max OR odds_min < 2"),
    "wide_order": ("wide_odds", "NOT horse_number_1 < horse_number_2"),
    "trio_order": ("trio_odds", "NOT (horse_number_1 < horse_number_2 AND horse_number_2 < horse_number_3)"),
    "horse_status": ("horse", "pedigree_fetch_status NOT IN ('pending', 'fetched')"),
}


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS broken FROM {table} WHERE {p}" for k, (table, p) in CHECKS.items())
    + " UNION ALL SELECT 'runner_key', count(*) FROM (SELECT 1 FROM runner GROUP BY race_id, horse_number HAVING count(*) > 1) UNION ALL SELECT 'runner_orphan', count(*) FROM runner WHERE race_id NOT IN (SELECT race_id FROM race WHERE track_id <> 3)"
)
def q_constraints(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("rule"), "broken")
    parts = [one(getattr(t, table).where(p), name) for name, (table, p) in CHECKS.items()]
    parts.append(one(t.runner.groupBy("race_id", "horse_number").count().where("count > 1"), "runner_key"))
    parts.append(one(t.runner.join(t.race.where("track_id <> 3"), "race_id", "left_anti"), "runner_orphan"))
    return c.long_report(parts)


@query("SELECT pedigree_fetch_status AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM horse GROUP BY 1")
def q_status_counts(t: Tables) -> DataFrame:
    n = t.horse.groupBy(F.col("pedigree_fetch_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", c.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


HAS = "SELECT u.race_id, r.date, CASE WHEN h.pedigree_fetch_status = 'fetched' THEN 1 ELSE 0 END AS has FROM runner u JOIN race r ON u.race_id = r.race_id LEFT JOIN horse h ON u.horse_id = h.horse_id"


def _has(t: Tables) -> DataFrame:
    has = t.horse.select("horse_id", (F.col("pedigree_fetch_status") == "fetched").cast("int").alias("h"))
    return t.runner.join(t.race.select("race_id", "date"), "race_id").join(has, "horse_id", "left").select("race_id", "date", F.coalesce("h", F.lit(0)).alias("has"))


@query("SELECT count(*) AS n, CAST(sum(has) AS BIGINT) AS with_pedigree, round(100.0 * sum(has) / count(*), 6) AS row_pct, count(DISTINCT race_id) AS races, count(DISTINCT CASE WHEN has = 1 THEN race_id END) AS races_with FROM has_rows", ("has_rows", HAS))
def q_pedigree_cov(t: Tables) -> DataFrame:
    n = _has(t).agg(F.count(F.lit(1)).alias("n"), F.sum("has").alias("with_pedigree"), F.countDistinct("race_id").alias("races"), F.countDistinct(F.when(F.col("has") == 1, F.col("race_id"))).alias("races_with"))
    return n.withColumn("row_pct", c.percent(F.col("with_pedigree"), F.col("n")))


@query("SELECT count(*) AS races, count(*) FILTER (WHERE h = n) AS full_races, count(*) FILTER (WHERE 2 * h >= n) AS half_races FROM (SELECT race_id, count(*) AS n, sum(has) AS h FROM has_rows GROUP BY 1)", ("has_rows", HAS))
def q_pedigree_race(t: Tables) -> DataFrame:
    race = _has(t).groupBy("race_id").agg(F.count(F.lit(1)).alias("n"), F.sum("has").alias("h"))
    return race.agg(F.count(F.lit(1)).alias("races"), F.count_if(F.col("h") == F.col("n")).alias("full_races"), F.count_if(2 * F.col("h") >= F.col("n")).alias("half_races"))


@query("SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, CAST(sum(has) AS BIGINT) AS with_pedigree, round(100.0 * sum(has) / count(*), 6) AS row_pct FROM has_rows GROUP BY 1 ORDER BY 1 DESC LIMIT 12", ("has_rows", HAS))
def q_pedigree_month(t: Tables) -> DataFrame:
    month = _has(t).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("has").alias("with_pedigree"))
    return month.withColumn("row_pct", c.percent(F.col("with_pedigree"), F.col("n"))).orderBy(F.desc("month")).limit(12)


WAITING = "SELECT h.horse_id, count(u.race_id) AS runner_rows FROM horse h LEFT JOIN runner u ON u.horse_id = h.horse_id WHERE pedigree_fetch_status = 'pending' GROUP BY 1"
RUNNING = "SELECT horse_id, runner_rows, row_number() OVER (ORDER BY runner_rows DESC, horse_id) AS rank, CAST(sum(runner_rows) OVER (ORDER BY runner_rows DESC, horse_id) AS BIGINT) AS running FROM waiting"


def _projected(t: Tables) -> DataFrame:
    waiting = t.horse.where("pedigree_fetch_status = 'pending'").select("horse_id")
    n = t.runner.groupBy("horse_id").agg(F.count(F.lit(1)).alias("n"))
    return c.projection(waiting.join(n, "horse_id", "left").select("horse_id", F.coalesce("n", F.lit(0)).alias("runner_rows")))


@query("SELECT * FROM running_sum", ("waiting", WAITING), ("running_sum", RUNNING))
def q_fetch_projection(t: Tables) -> DataFrame:
    return _projected(t)


@query("SELECT target, min(rank) AS horses_needed FROM (SELECT unnest([5.0, 10.0, 25.0, 30.0, 99.0])::DOUBLE AS target) LEFT JOIN running_sum ON running * 100.0::DOUBLE / (SELECT count(*) FROM runner) >= target GROUP BY 1", ("waiting", WAITING), ("running_sum", RUNNING))
def q_fetch_targets(t: Tables) -> DataFrame:
    targets = t.spark.createDataFrame([(x,) for x in (5.0, 10.0, 25.0, 30.0, 99.0)], "target double")
    return c.reached(_projected(t), targets, t.runner.count())


@query("SELECT round(100.0 * sum(has) / count(*), 6) AS row_pct, 100.0 * sum(has) / count(*) >= 10 AS passes FROM has_rows", ("has_rows", HAS))
def q_coverage_gate(t: Tables) -> DataFrame:
    n = _has(t).agg(c.percent(F.sum("has"), F.count(F.lit(1))).alias("row_pct"))
    return n.withColumn("passes", F.col("row_pct") >= 10)
