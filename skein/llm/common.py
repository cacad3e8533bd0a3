"""Shared helpers: scratch tables, document keys, word splitting and bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python task holds as words at once.
SLICE_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset in local mode (tests), a temporary one is set."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place and not spark.sparkContext.master.startswith("local"):  # also local-cluster: one machine
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not place:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def cut(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that later jobs don't depend on executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/skein-{uuid.uuid4().hex}"
    writer = df.write
    for name, value in options.items():
        writer = writer.option(name.replace("__", "."), value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_instead(old: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` written as by ``cut``, in place of the table ``old`` of such a kind, whose files go: nothing may read it any more."""
    new, spark = cut(df), df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return new


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Arrow batches of ``rows`` rows and about ``size`` bytes at most for the jobs inside: where a row holds whole texts, a batch is held twice, by Spark and by Python."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(min(rows, int(before[0])) if int(before[0]) > 0 else rows))
    if size:
        spark.conf.set(names[1], f"{size}b")
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more``; columns beyond these are left behind, so their names cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of ``column`` each; a longer value stands alone."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()  # workers stay for the next task: they should not keep what this one needed


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space: how many each row has, and all of them in order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat, lengths = lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(lengths)
        lengths = before[ends] - before[ends - lengths]
        flat = flat.filter(pa.array(full))
    return lengths, flat


def runs_of(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, a line end after each row; where rows begin; where runs of bytes that are ``inside`` begin and end.

    ``inside`` says it for each byte value; a line end must not be, so that no run goes on into the next row.
    """
    ended = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.string()), ""), "", "\n")
    offsets = np.frombuffer(ended.buffers()[1], dtype=np.int32, count=len(ended) + 1).astype(np.int64)
    data = np.frombuffer(ended.buffers()[2], dtype=np.uint8, count=int(offsets[-1]))
    change = np.flatnonzero(np.diff(inside[data], prepend=False, append=False))
    return data, offsets, change[::2], change[1::2]


def joined_runs(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The runs as texts; ``data`` may be another spelling of the same bytes."""
    places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[inside])).dictionary_encode()
