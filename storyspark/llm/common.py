"""What several of the operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in an Arrow batch, so that a worker holds a few MB of texts, however long they are.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column) -> Column:
    """crc32 of the id's decimal text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def training_labels(labels: DataFrame, label: str, bound: int | None = None) -> DataFrame:
    """(doc_id, y) of the rows that may be learned from: both set, remainder not 0.

    ``bound``: at most so many, the first in the order of a hash of the id.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0)).distinct()
    return rows if bound is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)


def strings(column: pa.Array) -> list[str]:
    """The column's texts; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def release_memory() -> None:
    """Hands freed memory back at a task's end, as a Python worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows and BATCH_BYTES at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_text(df: DataFrame, text_col: str, keep: list[str], fields: T.StructType, start: Callable[[], Callable[[list[str]], list[pa.Array]]], at_once: int = BATCH_ROWS) -> DataFrame:
    """``keep`` columns as they are, then ``fields`` worked out from the texts, batch by batch.

    ``start`` runs once in each task and gives the function from a batch's texts to the arrays of
    ``fields``; it gets at most ``at_once`` of them together. Only ``keep`` and the text travel, so
    other columns, also of clashing names, don't matter.
    """
    arrow_batches(df.sparkSession)
    taken = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([f for f in taken.schema.fields if f.name != "__text"] + fields.fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                batch = whole.slice(i, at_once)
                made = work(strings(batch.column(len(keep))))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + made, names=names)
        release_memory()

    return taken.mapInArrow(run, schema)
