"""Registered round trips: streams over the tables, written state and reports read back, feeds written and parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.plans import briefing_queries as bq
from storyspark.plans import research_queries as rq
from storyspark.plans import sql_parts as sq
from storyspark.plans.cutting import shared_dir
from storyspark.sources import feeds, sinks, snapshots
from storyspark.streaming import stateful as sf

#: Items in a written feed.
ITEMS = 40


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; by a pattern, as the table may be a folder or one file."""
    return spark.readStream.schema(ad.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def landed(stream: DataFrame) -> DataFrame:
    """All that a stream appends until it has read what is there."""
    spark, out = stream.sparkSession, _place(stream.sparkSession, "stream")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def q_stream_latest_state(s, d):
    """Each user's last event, kept in buckets by a stream."""
    events = streamed(s, d, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = _place(s, "state")
    sf.stream_latest_state(events, ["user_id"], ["ts", "event_id"], out, f"{out}-checkpoint", 16).awaitTermination()
    return snapshots.read_state(s, out).select("user_id", "event_id", "event_type", "value")


def q_stream_failure_counts(s, d):
    """Failures by day, of the days that the watermark has passed."""
    events = streamed(s, d, "events").filter(F.col("event_type").isin("error", "purchase"))
    kind = F.when(F.col("event_type") == "error", "news_provider_failure").otherwise("ai_request_failure")
    rows = events.select(kind.alias("kind"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("provider"), F.col("ts").cast("timestamp").alias("created_at"))
    return landed(sf.stream_failure_counts(rows)).withColumn("date", F.col("date").cast("string"))


def q_stream_dedupe_articles(s, d):
    pages = streamed(s, d, "pages").select("url", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("fetched_at"))
    return landed(sf.stream_dedupe_articles(pages)).select("canonical_url")


def q_stream_flag_over_limit(s, d):
    events = streamed(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return landed(sf.stream_flag_over_limit(events, 3, 86_400)).select("key", "id", "n", "over", "retry_after")


#: When the first states of a change stream land, and which articles these lack.
FIRST, KNOWN = "2024-01-30 00:00:00", "ordinal % 5 <> 1"


def q_stream_change_tracking(s, d):
    """The changes of a second landing of story states, against the snapshot that the first one left."""
    root = _place(s, "tracking")
    known, every = bq.state_of(s, d, KNOWN), bq.state_of(s, d, "true")
    for rows, at in ((known, FIRST), (every, ad.NOW)):
        rows = rows.withColumn("rank", F.col("cluster_no"))
        rows.write.mode("append").parquet(f"{root}/states")
        stream = s.readStream.schema(rows.schema).parquet(f"{root}/states")
        sf.stream_change_tracking(stream, f"{root}/snapshots", f"{root}/changes", f"{root}/checkpoint", ad.now(at)).awaitTermination()
    return s.read.parquet(f"{root}/changes/batch=1")


def q_append_eval_run(s, d):
    """Results of two runs, the first written again; each run is there once, with its report."""
    rows = ad.table(s, d, "documents").join(ad.table(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("good"))
    out = _place(s, "runs")
    for run, least in (("r1", 0), ("r2", 3), ("r1", 1)):
        sinks.append_eval_run(rows.filter(F.col("n") > least), run, out)
        sinks.write_eval_report(rows.agg(F.sum("n").alias("total")), run, f"{out}-report")
    report = s.read.schema("total long, run_id string").json(f"{out}-report")
    return s.read.parquet(out).join(report, "run_id").select("run_id", "source", "n", "good", "total")


def feed_files(s, d) -> DataFrame:
    """path and value of RSS files, of ITEMS documents of a source at most each; every seventh item has no link."""
    docs = ad.articles_from_documents(s, d).filter("title <> ''")
    plain = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    link = F.when(F.col("ordinal") % 7 != 0, F.concat(F.lit("<link>https://feed.example/"), "ordinal", F.lit("</link>"))).otherwise("")
    date = F.coalesce(F.concat(F.lit("<pubDate>Mon, "), F.date_format("published_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>")), F.lit(""))
    item = F.concat(F.lit("<item><title>"), plain("title"), F.lit(" - "), "source_name", F.lit("</title>"), link, date, F.lit("<description>"), plain("snippet"), F.lit("</description></item>"))
    name = F.concat("source_name", F.lit("-"), F.floor(F.col("ordinal") / ITEMS).cast("string"))
    by = docs.groupBy(name.alias("name")).agg(F.array_sort(F.collect_list(F.struct("ordinal", item.alias("item")))).alias("items"))  # ITEMS at most
    return by.select(F.concat(F.lit("file:/feeds/"), "name", F.lit(".xml")).alias("path"), F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda x: x.item), "\n"), F.lit("</channel></rss>")).alias("value"))


def q_parse_feed(s, d):
    return feeds.parse_feed(feed_files(s, d)).select("topic", "url", "title", "source_name", "snippet", "published_at")


QUERIES = {
    "stream_latest_state": (q_stream_latest_state, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id"),
    "stream_failure_counts": (
        q_stream_failure_counts,
        """WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'news_provider_failure' ELSE 'ai_request_failure' END AS kind, CASE WHEN user_id % 3 <> 0 THEN 'p' || (user_id % 3) ELSE 'unknown' END AS provider, ts FROM events WHERE event_type IN ('error', 'purchase'))
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, kind, provider, count(*) AS n FROM f WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM f) - INTERVAL 1 DAY GROUP BY ALL""",
    ),
    "stream_dedupe_articles": (q_stream_dedupe_articles, f"SELECT DISTINCT coalesce({sq.canonical('url')}, url) AS canonical_url FROM pages"),
    "stream_flag_over_limit": (q_stream_flag_over_limit, rq.QUERIES["flag_over_limit"][1]),
    "stream_change_tracking": (
        q_stream_change_tracking,
        f"WITH RECURSIVE {bq.CLASSIFIED.replace(f"WHERE e.ts < TIMESTAMP '{ad.SNAPSHOT_NOW}'", "WHERE d.doc_id % 5 <> 1").replace(ad.SNAPSHOT_NOW, FIRST)} SELECT * EXCLUDE (n_urls) FROM cl",
    ),
    "append_eval_run": (
        q_append_eval_run,
        "WITH g AS (SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM g) SELECT run_id, source, n, good, total FROM g, t, (VALUES ('r1', 1), ('r2', 3)) AS r(run_id, least) WHERE n > least",
    ),
    "parse_feed": (
        q_parse_feed,
        f"WITH {sq.ARTICLES} SELECT source_name || '-' || CAST(floor(ordinal / {ITEMS}) AS BIGINT) AS topic, 'https://feed.example/' || ordinal AS url, {sq.squeeze('title')} AS title, source_name, nullif({sq.squeeze('snippet')}, '') AS snippet, date_trunc('second', published_at) AS published_at FROM art WHERE title <> '' AND ordinal % 7 <> 0",
    ),
}
