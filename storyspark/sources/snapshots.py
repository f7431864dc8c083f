"""Snapshots of topics by time, and keyed state in buckets, each as commits of whole folders."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.sources import commit_log as log

#: Folders of snapshots that are merged into one when there are more; and the mark of a bucket's key.
MERGE_AFTER, BUCKET = 24, "b"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_snapshots(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All kept snapshots; of two of one topic and time the one committed later. None before the first."""
    _, live = log.state(spark, path, version)
    if not live:
        return None
    rows = _union([spark.read.parquet(f"{path}/{folder}").withColumn("turn", F.lit(key)) for key, folder in live.items()])
    newest = rows.groupBy("topic", "generated_at").agg(F.max("turn").alias("newest"))
    same = ["topic", "generated_at"]
    return rows.join(newest, same).filter(F.col("turn") == F.col("newest")).drop("turn", "newest")


def newest_of_each(snapshots: DataFrame) -> DataFrame:
    newest = snapshots.groupBy("topic").agg(F.max("generated_at").alias("newest"))
    return snapshots.join(newest, "topic").filter(F.col("generated_at") == F.col("newest")).drop("newest")


def read_topic_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest snapshot of each topic; of keyed state, its rows."""
    _, live = log.state(spark, path, version)
    if any(k.startswith(BUCKET) for k in live):
        return read_state(spark, path, version)
    found = read_snapshots(spark, path, version)
    return None if found is None else newest_of_each(found)


def write_topic_snapshot(df: DataFrame, path: str) -> int:
    """Adds snapshots (topic, generated_at and story columns) and gives the version; readers see all of them or none.

    Earlier snapshots stay for runs that are repeated (``expire_snapshots`` ends that). A write that runs again replaces itself.
    """
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    version = log.commit(spark, path, lambda n, live: live | {f"{n:020d}": folder})
    if len(log.state(spark, path)[1]) > MERGE_AFTER:
        version = expire_snapshots(spark, path)
    return version


def expire_snapshots(spark: SparkSession, path: str, before: Column | None = None) -> int:
    """Merges all folders into one, without snapshots older than ``before``; each topic's newest stays. Writers may go on meanwhile."""
    version, seen = log.state(spark, path)
    rows = read_snapshots(spark, path, version)
    if rows is None:
        return version
    if before is not None:
        newest = rows.groupBy("topic").agg(F.max("generated_at").alias("newest"))
        rows = rows.join(newest, "topic").filter((F.col("generated_at") >= before) | (F.col("generated_at") == F.col("newest"))).drop("newest")
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")

    def change(_: int, live: log.Live) -> log.Live | None:
        if any(live.get(k) != f for k, f in seen.items()):
            return None  # another one has merged them
        return {k: f for k, f in live.items() if k not in seen} | {max(seen): folder}

    return log.commit(spark, path, change)


def snapshots_as_of(snapshots: DataFrame, runs: DataFrame, ttl_hours: int = 168) -> DataFrame:
    """run_at and the rows of the latest snapshot of a topic at or before it and within the TTL; runs: topic, run_at."""
    times = snapshots.select("topic", "generated_at").distinct()
    fits = (F.col("generated_at") <= F.col("run_at")) & (F.col("generated_at") >= F.col("run_at") - F.make_interval(hours=F.lit(ttl_hours)))
    chosen = runs.join(times, "topic").filter(fits).groupBy("topic", "run_at").agg(F.max("generated_at").alias("generated_at"))
    return snapshots.join(chosen, ["topic", "generated_at"])


def version_before(spark: SparkSession, path: str, batch: int) -> int:
    """The version that was newest when micro-batch ``batch`` first ran, noted once; older notes go with their versions."""
    note = f"{path}/_batches/{batch:020d}.txt"
    log.create_once(spark, note, str(log.state(spark, path)[0]))
    p, fs = log._path(spark, f"{path}/_batches")
    for s in fs.listStatus(p):
        number = s.getPath().getName()[:20]
        if number.isdigit() and int(number) < batch - log.KEPT // 2:
            fs.delete(s.getPath(), False)
    return int(log.read_file(spark, note))


def snapshots_before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The snapshots that were there when micro-batch ``batch`` first ran."""
    version = version_before(spark, path, batch)
    return read_snapshots(spark, path, version) if version else None


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a keyed state."""
    _, live = log.state(spark, path, version)
    return spark.read.parquet(*[f"{path}/{f}" for f in live.values()]) if live else None


def merge_state(mine: DataFrame, keys: list[str], merge, path: str, buckets: int) -> int:
    """Merges rows into a keyed state and gives the version; only the buckets of their keys are read and written.

    ``merge`` takes old and new rows together and leaves one for a key. A writer that meets another one's commit in
    one of its buckets merges again with what that has written. ``buckets`` is fixed by a path's first write.
    """
    spark = mine.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [f"{BUCKET}{r.b}" for r in mine.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return log.state(spark, path)[0]
    while True:
        version, live = log.state(spark, path)
        seen = {b: live.get(b) for b in touched}
        old = [f"{path}/{f}" for f in seen.values() if f]
        rows = merge(mine.unionByName(spark.read.parquet(*old), allowMissingColumns=True) if old else mine)
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/{folder}")
        lost = []

        def change(_: int, live: log.Live) -> log.Live | None:
            lost[:] = [b for b in touched if live.get(b) != seen[b]]
            return None if lost else live | {b: f"{folder}/bucket={b[len(BUCKET):]}" for b in touched}

        version = log.commit(spark, path, change)
        if not lost:
            return version
