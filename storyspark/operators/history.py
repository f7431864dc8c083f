"""Per-client history out of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(df: DataFrame, keep: int, at: str, *ties: str) -> DataFrame:
    w = Window.partitionBy("client").orderBy(F.desc(at), *ties)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def search_history(log: DataFrame, keep: int = 50) -> DataFrame:
    """One row for (client, normalised topic): latest time and label, last story count that isn't null; newest ``keep``."""
    order = F.struct("at", "event_id")
    by = log.groupBy("client", F.lower(F.trim("topic")).alias("topic_key")).agg(F.max("at").alias("searched_at"), F.max_by("topic", order).alias("topic"), F.max_by("story_count", F.when(F.col("story_count").isNotNull(), order)).alias("story_count"))
    return _newest(by, keep, "searched_at", "topic_key")


def recently_viewed(log: DataFrame, keep: int = 20) -> DataFrame:
    """The last view of each (client, story); newest ``keep`` of a client."""
    return _newest(log.groupBy("client", "story").agg(F.max("at").alias("viewed_at"), F.count("*").alias("views")), keep, "viewed_at", "story")


def saved_stories(saves: DataFrame, removals: DataFrame, keep: int = 100) -> DataFrame:
    """The first save of each (client, story) since it was last removed; latest ``keep`` of a client."""
    gone = removals.groupBy("client", "story").agg(F.max("at").alias("removed_at"))
    live = saves.join(gone, ["client", "story"], "left").filter(F.col("removed_at").isNull() | (F.col("at") > F.col("removed_at")))
    return _newest(live.groupBy("client", "story").agg(F.min("at").alias("saved_at")), keep, "saved_at", "story")


def history_library(searches: DataFrame, views: DataFrame, saves: DataFrame, removals: DataFrame, clears: DataFrame) -> DataFrame:
    """client with its searches (50 and 8), views and saves as arrays; what was before a clear has vanished, saves stay."""
    cleared = clears.groupBy("client").agg(F.max("at").alias("cleared_at"))

    def live(df: DataFrame) -> DataFrame:
        return df.join(cleared, "client", "left").filter(F.col("cleared_at").isNull() | (F.col("at") > F.col("cleared_at"))).drop("cleared_at")

    def listed(df: DataFrame, value: Column, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rn", value.alias("v"))))
        return df.groupBy("client").agg(F.transform(ordered, lambda x: x.v).alias(name))

    s = listed(search_history(live(searches)), F.col("topic_key"), "searches")
    v = listed(recently_viewed(live(views)), F.col("story"), "viewed")
    k = listed(saved_stories(saves, removals), F.col("story"), "saved")
    return s.join(v, "client", "full").join(k, "client", "full").withColumn("recent_searches", F.slice("searches", 1, 8))
