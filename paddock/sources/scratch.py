"""Intermediate results that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary folder, but only on one machine: on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


#: Spark's setting by which an execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: nothing reads them once the result is stored."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    folder(df.sparkSession)
    with freed(df.sparkSession):
        return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder: later reads take only the columns they need."""
    at = f"{folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
