"""Request limits in windows that open at a key's first request; a key of any size spreads over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.plans.cutting import materialize

COUNTED = [T.StructField("n", T.IntegerType()), T.StructField("over", T.BooleanType()), T.StructField("retry_after", T.LongType())]


def limited(events: DataFrame) -> T.StructType:
    """key, id and at as the events have them, with n, over and retry_after."""
    return T.StructType([T.StructField(c, events.schema[c].dataType) for c in ("key", "id", "at")] + COUNTED)


def following(us: np.ndarray, window: int) -> np.ndarray:
    """For each of these ascending times the place of the first one a window later, the length if there is none."""
    return np.searchsorted(us, us + window)


def last_starts(after: np.ndarray) -> np.ndarray:
    """For each place, as a window's start, the last start that a chain of windows from it reaches; by doubling."""
    n = len(after)
    last, jump = np.arange(n), after.copy()
    while (inside := np.flatnonzero(jump < n)).size:
        last[inside] = last[jump[inside]]
        jump[inside] = jump[jump[inside]]
    return last


def _cut(batches: Iterator[pa.RecordBatch], window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in a batch as blocks, numbered in order; edge: the key may go on in another block."""
    block = TaskContext.get().partitionId() << 33
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        ends = runs.run_ends.to_numpy().astype(np.int32)
        offsets = np.concatenate([np.zeros(1, np.int32), ends])
        us = b.column(2).to_numpy()
        edge = np.zeros(len(ends), bool)
        edge[[0, -1]] = True
        last = np.zeros(len(us), np.int32)
        for k in np.flatnonzero(edge).tolist():
            last[offsets[k] : offsets[k + 1]] = last_starts(following(us[offsets[k] : offsets[k + 1]], window))
        at = pa.array(offsets)
        lists = [pa.ListArray.from_arrays(at, x) for x in (b.column(1), pa.array(us), pa.array(last))]
        yield pa.RecordBatch.from_arrays([runs.values, pa.array(block + np.arange(len(ends))), pa.array(edge), *lists], names=names)
        block += len(ends)


def _carry(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """block, start, n: the window that is open before a block, from the blocks of keys in order; a look-up each."""
    key, start, n = object(), None, 0
    for b in batches:
        found = []
        for k, (c, block) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            us = b.column(2)[k].values.to_numpy()
            if c != key:
                key, start = c, None
            else:
                found.append((block, start, n))
            enters = 0 if start is None else int(np.searchsorted(us, start + window))
            if enters == len(us):
                n += len(us)
            else:
                x = int(b.column(3)[k].values[enters].as_py())
                start, n = int(us[x]), len(us) - x
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["block", "start", "n"])


def _count(batches: Iterator[pa.RecordBatch], limit: int, window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = pc.list_value_length(b.column(2)).to_numpy()
        whole, numbers, starts = b.column(2).flatten().to_numpy(), [], []
        at = 0
        for size, start, n in zip(sizes.tolist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            us = whole[at : at + size]
            at += size
            enters = 0 if start is None else int(np.searchsorted(us, start + window))
            after, begins = following(us, window).tolist(), []
            i = enters
            while i < size:
                begins.append(i)
                i = after[i]
            opened = np.repeat(np.array(begins, np.int64), np.diff([*begins, size]))
            numbers.append(np.concatenate([(n or 0) + 1 + np.arange(enters), np.arange(enters, size) - opened + 1]))
            starts.append(np.concatenate([np.full(enters, start or 0), us[opened]]))
        if not at:
            continue
        n, first = np.concatenate(numbers), np.concatenate(starts)
        over = n > limit
        wait = np.where(over, np.maximum(1, -((whole - first - window) // 1_000_000)), 0)
        keys = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([keys, b.column(1).flatten(), pa.array(whole), pa.array(n.astype(np.int32)), pa.array(over), pa.array(wait)], names=names)


def flag_over_limit(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Requests (key, id, at) with their number in a window that starts at the key's first request, and whether over ``limit``.

    A new window opens at the first request at or after the reset. retry_after is whole seconds, 1 at least.
    Keys and ids are of any type; null keys are a key; rows without a time take no part.

    Requests are range-sorted by key and time, so a key with most of them spreads over partitions, and cut into
    blocks of an Arrow batch at most. Each block finds by doubling where a chain of windows from any of its requests
    ends; one look-up for a block then carries the open window from block to block of a key, and blocks
    are counted in parallel.
    """
    window = window_s * 1_000_000
    schema = limited(events)
    rows = events.select("key", "id", F.unix_micros("at").alias("us")).dropna(subset=["us"])
    kinds = {c: events.schema[c].dataType for c in ("key", "id")}
    blocks = T.StructType([T.StructField("key", kinds["key"]), T.StructField("block", T.LongType()), T.StructField("edge", T.BooleanType()), T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("us", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.IntegerType()))])
    names, out = blocks.fieldNames(), ["key", "id", "us", "n", "over", "retry_after"]
    cut = rows.orderBy(F.asc_nulls_first("key"), "us", "id").mapInArrow(lambda b: _cut(b, window, names), blocks)
    cut = materialize(cut, "requests")
    edges = cut.filter("edge").select("key", "block", "us", "last").repartition("key").sortWithinPartitions("key", "block")
    carried = edges.mapInArrow(lambda b: _carry(b, window), "block long, start long, n long")
    met = cut.join(carried, "block", "left").select("key", "ids", "us", "start", "n")
    counted = met.mapInArrow(lambda b: _count(b, limit, window, out), T.StructType([schema["key"], schema["id"], T.StructField("us", T.LongType()), *COUNTED]))
    return counted.select("key", "id", F.timestamp_micros("us").cast(schema["at"].dataType).alias("at"), "n", "over", "retry_after")
