"""Idempotent writers of plain Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyspark.plans.cutting import _path
from storyspark.sources.snapshots import read_topic_snapshot, write_topic_snapshot  # noqa: F401


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_daily_briefings(df: DataFrame, path: str, replace: bool = False) -> None:
    """One row for (topic_key, date), in folders by date. Rows that exist stay, unless ``replace``.

    ``replace`` rewrites only the folders of the dates that df has, with their other topics kept.
    """
    spark = df.sparkSession
    keys = ["topic_key", "date"]
    new = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("generated_at")))).filter("rn = 1").drop("rn")
    if not exists(spark, path):
        new.write.partitionBy("date").parquet(path)
        return
    old = spark.read.parquet(path)
    if not replace:
        new.join(old.select(*keys), keys, "left_anti").write.mode("append").partitionBy("date").parquet(path)
        return
    kept = old.join(new.select("date").distinct(), "date", "left_semi").join(new.select(*keys), keys, "left_anti")
    # dynamic overwrite would delete what it still reads, so the merged rows are written aside first
    aside = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    kept.unionByName(new).write.partitionBy("date").parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    p, fs = _path(spark, aside)
    fs.delete(p, True)


def append_eval_run(results: DataFrame, run_id: str, path: str) -> None:
    """Result rows of a run, in a folder of its own; a run written again replaces itself."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_eval_report(metrics: DataFrame, run_id: str, path: str) -> None:
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def append_pipeline_events(events: DataFrame, path: str) -> None:
    """Append-only, by day; rows come sanitised."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def find_briefings(briefings: DataFrame, id: str | None = None, topic_key: str | None = None, date: str | None = None, limit: int = 50) -> DataFrame:
    """By id, by topic and date, or the newest of a date; filters on date prune folders."""
    out = briefings
    for column, value in (("id", id), ("topic_key", topic_key), ("date", date)):
        if value is not None:
            out = out.filter(F.col(column) == F.lit(value))
    return out.orderBy(F.desc("generated_at"), "id").limit(limit)
