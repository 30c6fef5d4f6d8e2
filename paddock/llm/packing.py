"""Harmonic packing of whole documents into sequences of one capacity.

A length l belongs to class k = floor(capacity / l): it is over capacity / (k + 1) and at
most capacity / k, so k such pieces fill one bin. Documents are cut first into whole
sequences; what remains is kept whole if k pieces of its length fill a bin well enough,
else the exact share capacity / (k + 1) is cut off for class k + 1 and the rest is looked
at again. So every class has lengths that fill its bins.

Tasks number the pieces of each class on their own; how many pieces earlier tasks hold,
one row for each task and class, turns that into a number over all tasks, and with it
every task knows the bins of its pieces: bin = number div k. Only the last, unfilled bin
of each class is left: fewer than k pieces, under ``capacity`` ids and so for all classes
a number that doesn't grow with the input; those are packed by first fit, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.bpe import PieceIds
from paddock.llm.common import durable, in_tasks, slices, texts

CAPACITY = 2048
#: A rest is kept whole if its class's bins are filled to this share, or if it is shorter than capacity / LAST_CLASS.
FILL = 0.985
LAST_CLASS = 32
#: Distinct pieces that a task remembers.
KEPT_PIECES = 250_000
END_ID = 1


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= LAST_CLASS or k * rest >= FILL * capacity:
            return [*out, (rest, k)]
        part = capacity // (k + 1)
        out.append((part, k + 1))
        rest -= part
    return out


def cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, seen = PieceIds(path, KEPT_PIECES), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch):
                owner, rows = [], []
                for row, ids in enumerate(codec.ids(part["text"].to_pylist())):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")  # noqa: PLW2901
                    start = 0
                    for length, k in cut(len(ids), capacity):
                        seen[k] = number = seen.get(k, -1) + 1
                        rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), task, k, number))
                        owner.append(row)
                        start += length
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(owner)), *columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "k", "number"])

    return run


def first_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds sequence_id: each piece, the longest first, to the first bin with room."""
    pieces = pieces.sort_values(["length", "k", "rank"], ascending=[False, True, True], ignore_index=True)
    room, bins = np.zeros(0, np.int64), []
    for length in pieces["length"]:
        fits = np.flatnonzero(room >= length)
        if not len(fits):
            room, fits = np.append(room, capacity), [len(room)]
        bins.append(int(fits[0]))
        room[fits[0]] -= length
    return pieces.assign(sequence_id=np.array(bins, np.int64))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, task), one row per piece.

    A document is the library's ids and then id 1, so a null or empty text is one piece of
    one id. Rows that repeat a doc_id are packed each; ``task`` with the doc_id and start
    tells them apart only if they lie in different tasks. Sequences hold ``capacity`` ids
    at most, without gaps from 0. An empty table gives an empty result.
    """
    doc = texts(docs, id_col, text_col)
    kind = doc.schema["doc_id"].dataType.simpleString()
    numbers = "start long, length long, ids_crc32 long, doc_tokens long"
    piece = durable(in_tasks(doc, cutter(tokenizer_path, capacity), f"doc_id {kind}, {numbers}, task long, k long, number long"))

    count = piece.groupBy("k", "task").agg(F.max("number").alias("last"))
    before = Window.partitionBy("k").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("k")
    base = durable(count.select(F.col("k").alias("k2"), F.col("task").alias("task2"), F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base"), F.sum(F.col("last") + 1).over(whole).alias("total")))
    ranked = piece.join(base, (piece.k == base.k2) & (piece.task == base.task2)).withColumn("rank", F.col("base") + F.col("number"))
    full = F.col("rank") < F.col("total") - F.col("total") % F.col("k")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "k", "rank"]
    filled = ranked.where(full).select(*columns, (F.shiftleft(F.col("k"), 40) + F.floor(F.col("rank") / F.col("k"))).alias("sequence_id"))
    rest = ranked.where(~full).select(*columns)
    fitted = rest.groupBy().applyInPandas(lambda p: first_fit(p, capacity), f"doc_id {kind}, {numbers}, task long, k long, rank long, sequence_id long")
    packed = filled.unionByName(fitted)
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "k", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"), "task")
