"""Point-in-time joins: the newest fact of a key that isn't after a row's own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a block of a key's time.
BLOCK = 6 * 3600


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], row_at: str, fact_at: str, tie: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """Every row of ``rows`` with ``values`` and ``fact_at`` of the newest fact of its keys at or before ``row_at``; of equal times the larger ``tie``.

    Both sides are put in one order inside blocks of a key's time, so that a key with very
    many rows is dealt to many tasks; what a block hasn't seen itself comes from the last fact
    of the blocks before it, a table of one row for each key and block. A row before its key's
    first fact, with a null key or time, or of a key without facts has nulls. Facts with a null
    key or time don't count. No column of ``rows`` may have the name of ``values`` or ``fact_at``.
    """
    cut = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / block)
    known = facts.where(F.col(fact_at).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    found = F.struct(F.col(fact_at).alias("at"), F.col(tie).alias("tie"), *[F.col(v) for v in values])
    known = known.select(*keys, F.col(fact_at).alias("__at"), F.lit(0).alias("__kind"), F.col(tie).alias("__tie"), found.alias("__fact"), cut(fact_at).alias("__block"))
    own = rows.select(*keys, F.col(row_at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(known.schema["__tie"].dataType).alias("__tie"), F.struct(*rows.columns).alias("__row"), cut(row_at).alias("__block"))
    both = known.unionByName(own, allowMissingColumns=True)
    here = Window.partitionBy(*keys, "__block").orderBy("__at", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__in", F.last("__fact", ignorenulls=True).over(here)).where("__kind = 1").select("__row", "__block", "__in", *keys)
    ends = known.groupBy(*keys, "__block").agg(F.max("__fact").alias("__end"))
    asked = own.select(*keys, "__block").distinct()
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = asked.join(ends, [*keys, "__block"], "full").withColumn("__before", F.last("__end", ignorenulls=True).over(before)).where("__before IS NOT NULL")
    blocks = blocks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__block").alias("__b"), "__before")
    same: Column = F.col("__block") == F.col("__b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    out = seen.join(blocks, same, "left").withColumn("__fact", F.coalesce("__in", "__before"))
    return out.select("__row.*", F.col("__fact.at").alias(fact_at), *[F.col(f"__fact.{v}").alias(v) for v in values])
