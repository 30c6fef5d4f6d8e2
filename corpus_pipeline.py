"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of ``docs``; the last one returns the packed pieces. ``run`` writes
every stage's rows as Parquet in the cluster's shared folder and reads them again.
Null doc_ids and texts pass: a null text is the empty one. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import classifier, exact_dedup, minhash, packing, secrets
from paddock.llm.common import ascii_lower, read_table, shared_folder, stored, text_print
from paddock.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of rows that aren't held out."""
    return classifier.keep_good(docs, classifier.fit(docs, read_table(spark, sf_dir, "labels")))


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` but those of ``gone`` (doc_id, key). Only the rows that go are dealt out, which Spark broadcasts where their stored table is small."""
    out = gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    keyed = docs.withColumn("__own", key)
    return keyed.join(out, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_anti").drop("__own")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id. Rows that repeat an id and a text are one document and stay once; a row goes by its id and its text."""
    judged = stored(exact_dedup.exact_duplicates(docs).select("doc_id", "kept", F.col("text_sha256").alias("key")))
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    left = without(docs, judged.where("NOT kept").distinct(), digest)
    twice = stored(judged.where("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return left
    again = docs.withColumn("__own", digest).join(twice.withColumnsRenamed({"doc_id": "__id", "key": "__key"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_semi")
    return without(left, twice, digest).unionByName(again.dropDuplicates(["doc_id", "__own"]).drop("__own"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of each component of near duplicate texts (five words, 0.8). Only texts link rows, not a shared id; a row goes by its id and its text, so rows that repeat both stay together."""
    judged = minhash.near_classes(docs, tie=False)
    gone = stored(judged.groupBy("doc_id", F.col("print").alias("key")).agg(F.max("stays").alias("stays")).where("NOT stays"))
    return without(docs, gone, text_print(F.col("text")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark. Rows without an id go by their text's hash, not as one group."""
    by_text = F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.withColumn("__key", F.coalesce(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), by_text))
    return secrets.redact(keyed, secrets.scan_secrets(keyed, "__key"), "__key").drop("__key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, tokenizer_path()).drop("task")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("secret scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs


#: A learned classifier, MinHash and a library's token ids aren't SQL; tests compare with brute force.
ORACLE_SQL = None
