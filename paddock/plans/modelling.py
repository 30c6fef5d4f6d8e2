"""Queries of walk-forward scoring, pages, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import base, reports
from paddock.operators import modelling as m
from paddock.operators import rules as r
from paddock.operators import splits as s
from paddock.plans.datasets import BASE, rows
from paddock.plans.registry import query
from paddock.plans.rules import FIXED, GRID, rounded
from paddock.sources import io, pages
from paddock.sources.adapter import Tables
from paddock.sources.scratch import folder, kept, saved

CATEGORIES = ["track_id", "surface_id", "track_condition_id"]
#: Folds of the walk, the share of race days before the first, and the size of the models; the last two are far below a production model's (500 trees of depth 6), which are these functions' parameters.
FOLDS, RATIO, TREES, DEPTH = 4, 0.5, 3, 3
def trained_rows(t: Tables) -> DataFrame:
    """The training dataset with the place odds that evaluation needs."""
    df = base.training(rows(t), beside=("place_odds_min", "place_odds_max"))
    base.guard(df.drop("place_odds_min", "place_odds_max"))
    df = df.select(*base.KEYS, *[c for c in df.columns if c not in base.KEYS])
    return saved(df.withColumn("place_odds_mid", (F.col("place_odds_min") + F.col("place_odds_max")) / 2))


def numbers_of(df: DataFrame) -> list[str]:
    """The numeric columns that models learn from."""
    none = {*CATEGORIES, "target_top3", "place_odds_min", "place_odds_mid", "place_odds_max"}
    return [c for c, kind in df.dtypes if kind in ("int", "bigint", "double") and c not in none]


#: What evaluation reads besides the score.
EVALUATED = ["date", "track_id", "surface_id", "distance", "race_size", "target_top3", "place_odds_min", "place_odds_mid", "place_odds_max"]


def walked(df: DataFrame, numbers: list[str], folds: DataFrame) -> DataFrame:
    """Scored test rows with what evaluation reads, as it was before models' stand-ins for missing values."""
    found = m.walk_forward(df, folds, CATEGORIES, numbers, TREES, DEPTH).select(*base.KEYS, "fold", "test_start", "test_end", "pred_top3")
    return kept(found.join(df.select(*base.KEYS, *EVALUATED), base.KEYS))


@query()
def wf_predict(t: Tables) -> DataFrame:
    df = trained_rows(t)
    return walked(df, numbers_of(df), s.fold_table(df, FOLDS, RATIO)).select("race_id", "horse_number", "fold", "pred_top3", "target_top3")


@query()
def wf_eval(t: Tables) -> DataFrame:
    """The walk's metrics by fold, and the 20 most stable rules and rules by condition over its folds."""
    df = trained_rows(t)
    scored = kept(r.enriched(walked(df, numbers_of(df), s.fold_table(df, FOLDS, RATIO))))
    held = reports.stable(scored, GRID, FOLDS, least=5, top=20)
    measured = s.metrics(scored).select(F.lit("metrics").alias("report"), F.concat(F.lit("fold "), "fold").alias("rule"), "auc", "log_loss", "brier")
    return rounded(held.unionByName(measured, allowMissingColumns=True))


@query()
def holdout_eval(t: Tables) -> DataFrame:
    """The holdout's metrics and all its reports."""
    df = trained_rows(t)
    cut = s.split_ratio(df, 0.2).where("part = 'test'").agg(F.min("date")).first()[0]
    fold = t.spark.createDataFrame([(1, cut, None)], "fold int, test_start date, test_end date")
    scored = kept(r.enriched(walked(df, numbers_of(df), fold)))
    measured = s.metrics(scored).select(F.lit("metrics").alias("report"), "auc", "log_loss", "brier")
    return rounded(reports.holdout(scored, GRID, least=5).unionByName(measured, allowMissingColumns=True))


@query()
def ablation(t: Tables) -> DataFrame:
    """Metrics and a fixed rule's results without each of the eight groups of columns, and the differences to all columns."""
    df = trained_rows(t)
    folds, every = s.fold_table(df, 2, RATIO), numbers_of(df)
    variants = reports.without_groups(every, protected=[*base.KEYS, "date", "target_top3", "track_id", "surface_id", "distance", "race_size"])
    return rounded(reports.ablation({name: (len(every) - len(numbers), r.enriched(walked(df, numbers, folds))) for name, numbers in variants.items()}, FIXED))


@query("SELECT feature, avg(v) AS mean, max(v) AS max, min(v) AS min, count(v) AS folds FROM (SELECT CAST(track_id AS VARCHAR) AS feature, fold, CAST(round(avg(pred_top3) * 1000000) AS BIGINT) AS v FROM predictions GROUP BY 1, 2) GROUP BY 1")
def importance(t: Tables) -> DataFrame:
    """The report over a table of (fold, feature, importance), in millionths, of which a mean is one division."""
    table = t.predictions.groupBy(F.col("track_id").cast("string").alias("feature"), "fold").agg(F.round(F.avg("pred_top3") * 1_000_000).cast("long").alias("importance"))
    return m.importance_report(table)


@query()
def importance_models(t: Tables) -> DataFrame:
    """The same report over the importances of the walk's models."""
    df = trained_rows(t)
    numbers, folds = numbers_of(df), s.fold_table(df, 2, RATIO)
    found = [(f.fold, name, value) for f, model in m.fold_models(df, folds, CATEGORIES, numbers, TREES, DEPTH) for name, value in m.importances(model, CATEGORIES, numbers)]
    return rounded(m.importance_report(t.spark.createDataFrame(found, "fold int, feature string, importance double")))


@query("SELECT feature, value, dense_rank() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1 AS place, n FROM (SELECT 'surface_id' AS feature, coalesce(CAST(surface_id AS VARCHAR), '__MISSING__') AS value, count(*) AS n FROM base GROUP BY 2 UNION ALL SELECT 'jockey_id', coalesce(jockey_id, '__MISSING__'), count(*) FROM base GROUP BY 2)", ("base", BASE))
def feat_prep(t: Tables) -> DataFrame:
    """The index of each category, the most frequent first, a missing one by its own name, as the models' pipeline gives it to the rows."""
    names = ["surface_id", "jockey_id"]
    df = kept(m.prepared(rows(t), names))
    indexed = m.indexer(names).fit(df).transform(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"{c}__i").cast("int").alias("place")) for c in names])
    each = indexed.select(F.explode(pairs).alias("x")).select("x.*")
    return each.groupBy("feature", "value", "place").agg(F.count(F.lit(1)).alias("n"))


@query()
def model_save_score(t: Tables) -> DataFrame:
    df = trained_rows(t)
    numbers = numbers_of(df)
    df = m.prepared(df, CATEGORIES).fillna(m.ABSENT, numbers)
    at = f"{folder(t.spark)}/model-{uuid.uuid4().hex}"
    m.save(m.pipeline(CATEGORIES, numbers, trees=TREES, depth=DEPTH).fit(df), at, [*CATEGORIES, *numbers], df.count())
    return m.score(m.load(at), df).select("race_id", "horse_number", "pred_top3")


@query("SELECT CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(horse_number) AS BIGINT) AS numbers, count(*) AS in_folder FROM predictions GROUP BY 1")
def io_parquet_out(t: Tables) -> DataFrame:
    """Predictions written by fold and read back: whole, and each fold's folder on its own."""
    at = f"{folder(t.spark)}/predictions-{uuid.uuid4().hex}"
    io.write_predictions(t.predictions, at)
    whole = t.spark.read.parquet(at).groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("horse_number").alias("numbers"))
    apart = [t.spark.read.parquet(f"{at}/fold={f}").agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("in_folder")) for f in (1, 2, 3, 4)]
    return whole.join(reduce(DataFrame.unionByName, apart), "fold")


@query("SELECT race_id, count(*) AS n FROM win_odds WHERE race_id IN (SELECT race_id FROM race WHERE track_id = 4) GROUP BY 1")
def io_tables(t: Tables) -> DataFrame:
    return io.only_races(t.win_odds, t.race.where("track_id = 4")).groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT fold, count(*) AS n, round(avg(pred_top3), 6) AS mean_pred FROM predictions GROUP BY 1")
def io_parquet_cols(t: Tables) -> DataFrame:
    at = f"{folder(t.spark)}/predictions-{uuid.uuid4().hex}"
    io.write_predictions(t.predictions, at)
    return io.read_predictions(t.spark, at, ["fold", "pred_top3"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pred_top3"), 6).alias("mean_pred"))


@query("SELECT CAST(fold AS VARCHAR) AS fold, CAST(count(*) AS VARCHAR) AS n FROM predictions GROUP BY 1")
def io_csv_out(t: Tables) -> DataFrame:
    at = f"{folder(t.spark)}/report-{uuid.uuid4().hex}"
    io.write_report(t.predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), at)
    return t.spark.read.option("header", True).csv(at)


@query("SELECT race_id, count(*) AS runners FROM raw_text GROUP BY 1")
def io_raw_json(t: Tables) -> DataFrame:
    """Raw documents written and read with the fixed schema."""
    at = f"{folder(t.spark)}/raw-{uuid.uuid4().hex}"
    runner = F.struct(F.col("horse_number").cast("string").alias("horse_number"), F.col("finish_text").alias("finish"))
    t.raw_text.groupBy("race_id").agg(F.collect_list(runner).alias("runners")).select(F.struct("race_id").alias("race"), "runners").write.json(at)
    return t.spark.read.schema(io.RAW).json(at).select("race.race_id", F.size("runners").cast("long").alias("runners"))


@query("SELECT count(*) AS n FROM predictions WHERE pred_top3 >= 0.4 AND distance >= 1400")
def io_rule_json(t: Tables) -> DataFrame:
    rule = r.load_rule({"pred_min": 0.37, "distance_min": 1400}, {"pred_min": 0.4})
    return t.predictions.where(r.predicate(rule)).agg(F.count(F.lit(1)).alias("n"))


#: The given pages hold no tables, so each is given one of results, and one of pedigrees, made of its own number.
ROWS_HTML = "concat(coalesce(html, ''), '<table><tr><th>No</th><th>Name</th><th>Odds</th></tr>', repeat('<tr><td>1</td><td> n </td><td>2.5</td></tr>', CAST(page_id % 7 AS INT)), '</table>')"
PED_HTML = "concat('<table>', repeat('<tr><td>a</td><td>b</td></tr>', CAST(page_id % 16 AS INT)), '<tr><td>s', CAST(page_id AS {s}), '</td><td>x</td></tr>', repeat('<tr><td>c</td><td>d</td></tr>', CAST(14 + page_id % 3 AS INT)), '</table>')"


@query("SELECT page_id, CAST(page_id % 7 AS INT) AS n_rows, CAST(CASE WHEN page_id % 7 > 0 THEN i END AS INT) AS row, CASE WHEN page_id % 7 > 0 THEN '1|n|2.5' END AS cells FROM (SELECT page_id, unnest(range(greatest(1, page_id % 7))) AS i FROM pages)")
def html_rows(t: Tables) -> DataFrame:
    found = pages.html_rows(t.pages.select("page_id", F.expr(ROWS_HTML).alias("html")))
    text = F.concat_ws("|", *[F.try_element_at("cells", F.lit(c)) for c in ("No", "Name", "Odds")])
    return found.select("page_id", "n_rows", "row", F.when(F.col("row").isNotNull(), text).alias("cells"))


@query("SELECT page_id, CASE WHEN rows >= 17 THEN CASE WHEN page_id % 16 = 0 THEN 's' || page_id ELSE 'a' END END AS sire, CASE WHEN rows >= 17 THEN 'c' END AS dam, CASE WHEN rows >= 17 THEN 'd' END AS broodmare_sire, CASE WHEN rows >= 17 THEN 'fetched' ELSE 'failed' END AS status FROM (SELECT page_id, page_id % 16 + 15 + page_id % 3 AS rows FROM pages)")
def html_pedigree(t: Tables) -> DataFrame:
    return pages.html_pedigree(t.pages.select("page_id", F.expr(PED_HTML.format(s="STRING")).alias("html")))
