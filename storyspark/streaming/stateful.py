"""Streaming twins of the stateful behaviours; with availableNow each equals its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyspark.functions.text import canonical_url
from storyspark.operators.changes import classify_changes, match_prior_stories, snapshot_from_changes
from storyspark.operators.limits import flag_over_limit, limited  # noqa: F401
from storyspark.plans.cutting import materialize
from storyspark.sources.snapshots import merge_state, read_snapshots, snapshots_as_of, snapshots_before, write_topic_snapshot

def _limit(start: int | None, n: int, at: int, limit: int, window: int) -> tuple[int, int, bool, int]:
    """The window's start and number of requests after one more, whether over the limit, seconds to wait; times in microseconds."""
    if start is None or at - start >= window:
        start, n = at, 0
    over = n + 1 > limit
    return start, n + 1, over, max(1, -((at - start - window) // 1_000_000)) if over else 0


def stream_flag_over_limit(events: DataFrame, limit: int, window_s: int, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream whose batches hold a key's requests in time order; state is a start and a count per key.

    A key's state goes once the watermark has passed its window, as any later request opens a new one.
    """
    window = window_s * 1_000_000
    rows = events.withWatermark("at", delay).select("key", "id", "at", F.unix_micros("at").alias("us"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["us", "id"])
        start, n = state.get if state.exists else (None, 0)
        made = []
        for i, at, us in zip(pdf["id"], pdf["at"], pdf["us"], strict=True):
            start, n, over, wait = _limit(start, n, int(us), limit, window)
            made.append((key[0], i, at, n, over, wait))
        state.update((start, n))
        state.setTimeoutTimestamp(max((start + window) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=["key", "id", "at", "n", "over", "retry_after"])

    return rows.groupBy("key").applyInPandasWithState(run, limited(events), "start long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def stream_dedupe_articles(stream: DataFrame, delay: str = "48 hours", at: str = "fetched_at") -> DataFrame:
    """The first row of each canonical url across micro-batches, within the watermark."""
    keyed = stream.withColumn("canonical_url", F.coalesce(canonical_url(F.col("url")), "url"))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["canonical_url"])


def failure_counts(events: DataFrame) -> DataFrame:
    """Failures for each UTC day, kind and provider; on a stream with a watermark, once the day has passed."""
    rows = events.filter(F.col("kind").isin("news_provider_failure", "ai_request_failure"))
    return rows.groupBy(F.window("created_at", "1 day").alias("w"), "kind", F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("date"), "kind", "provider", "n")


def stream_failure_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return failure_counts(events.withWatermark("created_at", delay))


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def stream_latest_state(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64):
    """Keeps latest_state current under ``path``: a micro-batch merges its own last rows into the buckets of its keys.

    Other buckets are neither read nor written. A batch that runs again changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        mine = materialize(latest_state(batch, keys, order), "state")
        merge_state(mine, keys, lambda rows: latest_state(rows, keys, order), path, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_changes(current: DataFrame, path: str, now, ttl_hours: int = 168, batch: int | None = None) -> DataFrame:
    """Matches story states to the latest snapshot at or before now within the TTL, writes the next one, returns the changes.

    ``batch``: the number of a micro-batch; one that runs again meets the snapshots that it met at first.
    """
    spark = current.sparkSession
    known = read_snapshots(spark, path) if batch is None else snapshots_before(spark, path, batch)
    if known is None:
        prior = current.select("cluster_no", "topic", "urls", "sources", "headline", "published_at", "content_hash", "stable_id", now.alias("first_seen"), now.alias("last_updated")).limit(0)
    else:
        prior = snapshots_as_of(known, current.select("topic").distinct().withColumn("run_at", now), ttl_hours).drop("run_at", "generated_at")
    changes = materialize(classify_changes(current, prior, match_prior_stories(current, prior), now), "changes")
    write_topic_snapshot(snapshot_from_changes(changes, current).drop("rank").withColumn("generated_at", now), path)
    return changes


def write_batch_changes(batch: DataFrame, number: int, path: str, out: str, now) -> None:
    """The changes of a micro-batch in a folder of its own under ``out``, which a second run replaces."""
    track_changes(batch, path, now, batch=number).write.mode("overwrite").parquet(f"{out}/batch={number}")


def stream_change_tracking(stream: DataFrame, path: str, out: str, checkpoint: str, now):
    """track_changes on each micro-batch of story states; changes go under ``out``, by batch."""

    def run(batch: DataFrame, number: int) -> None:
        write_batch_changes(batch, number, path, out, now)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
