"""What several operators share: whole-text input, ASCII folding, durable intermediate results."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that separates words: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a batch between Spark and a worker.
BATCH_ROWS = 1_000
#: Bytes of text that a task holds as Python strings at a time.
SLICE_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one; other columns can't clash then."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """A to Z become a to z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The maximal runs without ASCII white space, in order."""
    return F.array_remove(F.split(F.translate(c, SPACES[1:], " " * 5), " "), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share: the session's
    ``spark.checkpoint.dir``; only where that is unset, as in tests, a temporary one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where every executor can read it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder: smaller than a checkpoint, and Spark knows its size when it chooses a join."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` for whole texts: both sides of a task hold BATCH_ROWS rows at a time instead of Spark's 10,000, and a task's memory goes back at its end.

    The number of rows of a batch is a setting of the session; a smaller one stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(frugal, schema)


def give_back() -> None:
    """Hands freed memory of this worker back to the system, so that an idle worker doesn't hold what its last task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``limit`` bytes of text, one row at least."""
    sizes, at, held = pc.binary_length(batch[column]).to_pylist(), 0, 0
    for row, size in enumerate(sizes):
        held += size or 0
        if held >= limit:
            yield batch.slice(at, row + 1 - at)
            at, held = row + 1, 0
    if at < len(sizes):
        yield batch.slice(at)


def text_print(text: Column) -> Column:
    """A 64-bit hash of the text, null as the empty one, which tells apart rows of one doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def printed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``texts`` with their ``print``."""
    return texts(docs, id_col, text_col).withColumn("print", text_print(F.col("text")))


def pack_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, print, packed) of ``printed`` rows: each text's UTF-8 bytes compressed, for texts that go through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch):
                data = [press.compress(t.encode()) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["print"], pa.array(data, pa.binary())], names=["doc_id", "print", "packed"])

    return in_tasks(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long, packed binary")


def unpack(packed: list[bytes]) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(p) for p in packed]
