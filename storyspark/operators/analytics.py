"""Operational analytics over runs, failure events and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.functions.text import round_k, safe_rate

SUMS = ("articles", "duplicates", "stories", "calls", "hits")


def _days(now: Column, days: int) -> tuple[Column, Column]:
    days = min(90, max(1, days))
    to = now.cast("date")
    return F.date_sub(to, days - 1), to


def _within(df: DataFrame, now: Column, days: int) -> DataFrame:
    a, b = _days(now, days)
    return df.filter(F.col("date").between(a, b))


def daily_trends(runs: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Sums, rates and means for each day of the window that ends today; empty days are there, with zeros.

    runs: topic, date, articles, duplicates, stories, calls, hits, duration_ms, sources. ``days`` is
    held to 1-90.
    """
    a, b = _days(now, days)
    calendar = runs.sparkSession.range(1).select(F.explode(F.sequence(a, b)).alias("date"))
    sums = _within(runs, now, days).groupBy("date").agg(*[F.sum(c).alias(c) for c in SUMS], F.sum("duration_ms").alias("ms"), F.sum("sources").alias("sources"), F.count("*").alias("briefings"))
    out = calendar.join(sums, "date", "left").na.fill(0)
    return out.select(
        "date", *SUMS,
        round_k(safe_rate(F.col("duplicates"), F.col("articles")), 6).alias("duplicate_rate"),
        round_k(safe_rate(F.col("hits"), F.col("calls") + F.col("hits")), 6).alias("hit_rate"),
        round_k(safe_rate(F.col("ms"), F.col("briefings")), 6).alias("mean_ms"),
        round_k(safe_rate(F.col("sources"), F.col("stories")), 6).alias("mean_sources"),
        "briefings",
    )


def failure_overlay(warnings: DataFrame, events: DataFrame) -> DataFrame:
    """date, api_failures, model_failures: the greater of what warnings and what events count.

    warnings: date, warning; events: kind, created_at. Days with neither are not there.
    """
    w = F.col("warning")
    said = warnings.groupBy("date").agg(F.count_if(w.rlike("(?i)news provider|providers failed|rate-limited|NEWS_")).alias("api_w"), F.count_if(w.rlike("(?i)fallback text|summarization|AI summarization|AI provider")).alias("model_w"))
    seen = events.groupBy(F.col("created_at").cast("date").alias("date")).agg(F.count_if(F.col("kind") == "news_provider_failure").alias("api_e"), F.count_if(F.col("kind") == "ai_request_failure").alias("model_e"))
    both = said.join(seen, "date", "full").na.fill(0)
    return both.select("date", F.greatest("api_w", "api_e").alias("api_failures"), F.greatest("model_w", "model_e").alias("model_failures"))


def topic_stats(runs: DataFrame) -> DataFrame:
    out = runs.groupBy("topic").agg(F.sum("articles").alias("articles"), F.sum("stories").alias("stories"), F.sum("calls").alias("calls"), F.count("*").alias("briefings"), F.sum("sources").alias("s"))
    return out.select("topic", "articles", "stories", "calls", "briefings", round_k(safe_rate(F.col("s"), F.col("stories")), 6).alias("mean_sources"))


def most_covered_topics(runs: DataFrame, n: int = 10) -> DataFrame:
    return topic_stats(runs).orderBy(F.desc("stories"), "topic").limit(n).select("topic", "stories", "briefings", "articles")


def provider_failures(events: DataFrame) -> DataFrame:
    """kind, provider, count, last_code and newest_code of failures; retries are no failures.

    last_code is the code of the oldest event that has one, as readers of a newest-first list that
    overwrite get it; newest_code is what the name says.
    """
    rows = events.filter(F.col("kind").isin("news_provider_failure", "ai_request_failure"))
    order = F.struct("created_at", "id")
    coded = F.when(F.col("code").isNotNull(), order)
    return rows.groupBy(F.when(F.col("kind") == "news_provider_failure", "news").otherwise("ai").alias("kind"), F.coalesce(F.nullif("provider", F.lit("")), F.lit("unknown")).alias("provider")).agg(
        F.count("*").alias("n"), F.min_by("code", coded).alias("last_code"), F.max_by("code", coded).alias("newest_code")
    )


def window_totals(runs: DataFrame, failures: DataFrame, jobs: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """One row: sums and rates of the window, means over runs and stories, failures, job runs."""
    r = _within(runs, now, days).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.sum("duration_ms").alias("ms"), F.sum("sources").alias("s"), F.count("*").alias("briefings"))
    f = _within(failures, now, days).agg(F.coalesce(F.sum("api_failures"), F.lit(0)).alias("api_failures"), F.coalesce(F.sum("model_failures"), F.lit(0)).alias("model_failures"))
    j = _within(jobs, now, days).agg(F.count_if(F.col("status") == "completed").alias("jobs_completed"), F.count_if(F.col("status") == "failed").alias("jobs_failed"), F.coalesce(F.sum("topics_failed"), F.lit(0)).alias("topics_failed"))
    out = r.crossJoin(f).crossJoin(j)  # one row each
    return out.select(
        *SUMS, "briefings", "api_failures", "model_failures", "jobs_completed", "jobs_failed", "topics_failed",
        round_k(safe_rate(F.col("duplicates"), F.col("articles")), 6).alias("duplicate_rate"),
        round_k(safe_rate(F.col("hits"), F.col("calls") + F.col("hits")), 6).alias("hit_rate"),
        round_k(safe_rate(F.col("ms"), F.col("briefings")), 6).alias("mean_ms"),
        round_k(safe_rate(F.col("s"), F.col("stories")), 6).alias("mean_sources"),
    )


def operational_alerts(totals: DataFrame, trends: DataFrame, failures: DataFrame, days: int = 14) -> DataFrame:
    """kind, severity, title, metric, value: one row for each rule that fires, else one "none" row.

    failures: provider_failures' rows. Trends compare the first and the last of the last three days.
    """
    last = trends.withColumn("k", F.row_number().over(Window.orderBy(F.desc("date")))).filter("k <= 3")  # one row a day, 90 at most
    t = last.agg(F.count("*").alias("n"), F.min_by("calls", "date").alias("calls0"), F.max_by("calls", "date").alias("calls1"), F.min_by("mean_ms", "date").alias("ms0"), F.max_by("mean_ms", "date").alias("ms1"))
    f = failures.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed"))
    x = totals.crossJoin(t).crossJoin(f)

    def alert(kind: str, severity: Column, title: str, metric: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), F.lit(title).alias("title"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    c = F.col
    per_day = c("articles") / min(90, max(1, days))
    api = c("api_failures")
    failing = (api >= 3) | (api / F.greatest(F.lit(1), c("briefings")) >= 0.5)

    def level(bad: Column) -> Column:
        return F.when(bad, "critical").otherwise("warning")

    total = c("failed") + c("model_failures") + c("jobs_failed")
    rules = F.array(
        F.when(failing, alert("excessive_api_usage", level(api >= 8), "Excessive or failing news API usage", "apiFailures", api)).when(per_day >= 80, alert("excessive_api_usage", F.lit("info"), "High article retrieval volume", "articlesRetrieved", c("articles"))),
        F.when((c("calls") >= 40) & (c("hit_rate") < 0.25), alert("excessive_ai_calls", level(c("calls") >= 80), "Excessive AI calls", "aiCalls", c("calls"))).when((c("n") >= 2) & (c("calls1") > c("calls0") * 1.5 + 5), alert("excessive_ai_calls", F.lit("info"), "AI calls trending up", "aiCalls", c("calls1"))),
        F.when(c("duplicate_rate") >= 0.45, alert("duplicate_news", level(c("duplicate_rate") >= 0.65), "High duplicate news rate", "duplicateRate", c("duplicate_rate"))),
        F.when(c("mean_ms") >= 15000, alert("slow_processing", level(c("mean_ms") >= 30000), "Slow briefing generation", "averageBriefingGenerationMs", c("mean_ms"))).when((c("n") >= 2) & (c("ms0") > 0) & (c("ms1") > c("ms0") * 1.5), alert("slow_processing", F.lit("info"), "Processing time trending slower", "averageBriefingGenerationMs", c("ms1"))),
        F.when(total > 0, alert("failed_providers", level((total >= 5) | (c("jobs_failed") > 0)), "Failed providers / jobs", "failedProviders", total)),
    )
    none = alert("none", F.lit("info"), "No major pipeline anomalies detected in this window.", "none", F.lit(0))
    found = F.array_compact(rules)
    return x.select(F.explode(F.when(F.size(found) == 0, F.array(none)).otherwise(found)).alias("a")).select("a.*")


def run_metrics(log: DataFrame, latest: int = 40) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, the latest runs by time, then id)."""
    totals = log.agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("runs"), round_k(safe_rate(F.sum("duration_ms"), F.count("*")), 6).alias("mean_ms"), round_k(safe_rate(F.sum("hits"), F.sum("hits") + F.sum("calls")), 6).alias("hit_rate"))
    return totals, log.orderBy(F.desc("date"), "topic").limit(latest)
