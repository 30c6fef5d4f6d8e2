"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so, so equal texts are cut alike. Every chunk gets
an identifier, and identifiers are verified: the distinct chunks are grouped by their
whole bytes, and an identifier that two different chunks share is made longer by the
chunk's SHA-256. A document is then its recipe, the ordered list of identifiers; equal
recipes are equal texts. Only distinct chunks and recipes are shuffled, each text is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import ascii_lower, durable, texts

#: After 256 characters a chunk ends at the first of these marks in the text, or at about 2,048 characters.
CHUNKS = r"(?s).{256,2047}?(?:[aehinorst][.,\n]|[est] [a-f])|.{1,2048}"


def chunk_list(text: Column, pattern: str = CHUNKS) -> Column:
    """The chunks of a text, in order; joined they are the text. The empty text has none."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_key(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("h"), F.xxhash64(F.lit(7), chunk).alias("g"), F.length(chunk).alias("n"))


def ambiguous_keys(chunk: DataFrame, key=chunk_key) -> DataFrame:
    """The keys that two or more different chunks share. Copies of a chunk are merged before they are shuffled."""
    each = chunk.groupBy("chunk").agg(F.lit(1).alias("one")).select(key(F.col("chunk")).alias("key"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=chunk_key) -> DataFrame:
    """(doc_id, recipe, n_bytes, text_sha256), one row per document, of the case-folded text.

    ``recipe`` lists verified identifiers: struct(key, digest), digest null unless the key is ambiguous.
    """
    folded = texts(docs, id_col, text_col).withColumn("text", ascii_lower(F.col("text")))
    doc = durable(
        folded.select(
            "doc_id",
            F.transform(chunk_list(F.col("text")), key).alias("keys"),
            F.octet_length("text").alias("n_bytes"),
            F.sha2(F.col("text"), 256).alias("text_sha256"),
        )
    )
    bad = durable(ambiguous_keys(folded.select(F.explode(chunk_list(F.col("text"))).alias("chunk")), key))
    none = F.lit(None).cast("string")
    if bad.isEmpty():
        return doc.select("doc_id", F.transform("keys", lambda k: F.struct(k.alias("key"), none.alias("digest"))).alias("recipe"), "n_bytes", "text_sha256")
    # Seen only where two chunks share a 128-bit key: those chunks' own digests settle which is which.
    at = (
        folded.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), F.posexplode(chunk_list(F.col("text"))).alias("at", "chunk"))
        .select("doc_id", "text_sha256", "at", key(F.col("chunk")).alias("key"), F.sha2(F.col("chunk"), 256).alias("digest"))
        .join(bad, "key", "left_semi")
        .select(F.col("text_sha256").alias("owner"), "at", "digest").distinct()
    )
    own = at.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("at", "digest"))).alias("digests"))
    joined = doc.join(own, doc.text_sha256 == own.owner, "left")
    whole = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.try_element_at(F.col("digests"), i).alias("digest")))
    return joined.select("doc_id", whole.alias("recipe"), "n_bytes", "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=chunk_key) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Texts are equal when identical after lower-casing A to Z; a null text is the empty one,
    and all empty texts are one group. The row with the largest doc_id stays. Rows that
    repeat a doc_id with the same text are all marked like that document and all count in
    ``group_size``. A null doc_id stays only if its whole group has no other id.
    An empty table gives an empty result.
    """
    doc = recipes(docs, id_col, text_col, key)
    doc = doc.withColumn("r", F.xxhash64("recipe"))
    group = doc.groupBy("r", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    more = group.where("group_size > 1").withColumnsRenamed({"r": "r2", "recipe": "recipe2"})
    out = doc.join(more, (doc.r == more.r2) & (doc.recipe == more.recipe2), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
