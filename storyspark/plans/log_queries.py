"""Registered queries of the analytics, history and hygiene operators, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.operators import analytics as an
from storyspark.operators import history as hi
from storyspark.operators import hygiene as hy
from storyspark.plans import sql_parts as sq

DAYS = 31


def events(spark, sf):
    e = ad.table(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int")})
    return e


def runs(spark, sf):
    """Events of a day and a seventh of the users, as a run."""
    e = events(spark, sf)
    by = e.groupBy(F.col("ts").cast("date").alias("date"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("topic"))
    out = by.agg(
        F.count("*").alias("articles"), (F.count("*") - F.count_distinct("event_type", "k")).alias("duplicates"), F.count_if(F.col("event_type") == "signup").alias("calls"), F.count_if(F.col("event_type") == "view").alias("hits"),
        F.count_if(F.col("event_type") == "click").alias("stories"), F.floor(F.sum(F.col("value").cast("decimal(20,6)")) * 100).cast("long").alias("duration_ms"), F.count_distinct("user_id").alias("sources"),
    )
    return out


def pipeline_events(spark, sf):
    e = events(spark, sf).filter(F.col("event_type").isin("error", "purchase", "signup"))
    kind = F.when(F.col("event_type") == "error", "news_provider_failure").when(F.col("event_type") == "purchase", "ai_request_failure").otherwise("ai_request_retry")
    provider = F.when(F.col("k") % 3 != 0, F.concat(F.lit("p"), (F.col("k") % 3).cast("string")))
    code = F.when(F.col("k") % 7 != 0, F.concat(F.lit("c"), (F.col("k") % 5).cast("string")))
    return e.select(F.col("event_id").alias("id"), kind.alias("kind"), F.col("ts").alias("created_at"), provider.alias("provider"), code.alias("code"), "event_type", "k")


def warnings(spark, sf):
    r = runs(spark, sf)
    return r.select("date", F.when(F.col("calls") > 5, "2 providers failed").when(F.col("hits") > 20, "1 card uses fallback text").otherwise("other").alias("warning"))


def jobs(spark, sf):
    r = runs(spark, sf)
    return r.groupBy("date").agg(F.when(F.sum("calls") % 5 == 0, "failed").otherwise("completed").alias("status"), F.count_if(F.col("hits") % 4 == 0).alias("topics_failed"))


def overlay(spark, sf):
    return an.failure_overlay(warnings(spark, sf), pipeline_events(spark, sf))


def totals(spark, sf):
    return an.window_totals(runs(spark, sf), overlay(spark, sf), jobs(spark, sf), ad.now(), DAYS)


def q_operational_alerts(spark, sf):
    return an.operational_alerts(totals(spark, sf), an.daily_trends(runs(spark, sf), ad.now(), DAYS), an.provider_failures(pipeline_events(spark, sf)), DAYS)


def log(spark, sf, event_type):
    e = events(spark, sf).filter(F.col("event_type") == event_type)
    return e.select(F.col("user_id").alias("client"), F.col("k").alias("story"), F.concat(F.lit(" Topic "), (F.col("k") % 10).cast("string")).alias("topic"), F.when(F.col("event_id") % 5 != 0, F.floor("value")).alias("story_count"), F.col("ts").alias("at"), "event_id")


def q_history_library(spark, sf):
    out = hi.history_library(log(spark, sf, "click"), log(spark, sf, "view"), log(spark, sf, "purchase"), log(spark, sf, "signup"), log(spark, sf, "error"))
    return out.select("client", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("searches", "viewed", "saved", "recent_searches")])


def q_append_pipeline_events(spark, sf):
    e = pipeline_events(spark, sf)
    text = F.concat(F.lit("call failed, token: abc"), F.col("k").cast("string"), F.lit(" from "), F.coalesce("provider", F.lit("none")))
    rows = e.select("id", F.repeat(F.col("event_type"), 30).alias("topic"), "provider", "code", text.alias("detail"), F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("api_key"), F.lit("x")).alias("meta"))
    return hy.sanitize_events(rows).select("id", "topic", "provider", "code", "detail", F.array_join(F.map_keys("meta"), ",").alias("meta_keys"))


_EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_RUNS = f"""{_EV}, runs AS (
  SELECT CAST(ts AS DATE) AS date, 't' || (user_id % 7) AS topic, count(*) AS articles, count(*) - count(DISTINCT (event_type, k)) AS duplicates, count(*) FILTER (event_type = 'signup') AS calls,
    count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS stories, CAST(floor(sum(CAST(value AS DECIMAL(20,6))) * 100) AS BIGINT) AS duration_ms, count(DISTINCT user_id) AS sources FROM ev GROUP BY ALL)"""
_PE = """pe AS (
  SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'news_provider_failure' WHEN 'purchase' THEN 'ai_request_failure' ELSE 'ai_request_retry' END AS kind, ts AS created_at,
    CASE WHEN k % 3 <> 0 THEN 'p' || (k % 3) END AS provider, CASE WHEN k % 7 <> 0 THEN 'c' || (k % 5) END AS code, event_type, k FROM ev WHERE event_type IN ('error', 'purchase', 'signup'))"""
_CAL = "cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date)"


def _rate(a: str, b: str) -> str:
    return sq.rnd(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0::DOUBLE END", 6)


_TREND = f"""{_RUNS}, {_CAL}, trend AS (
  SELECT date, CAST(coalesce(sum(articles), 0) AS BIGINT) AS articles, CAST(coalesce(sum(duplicates), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(stories), 0) AS BIGINT) AS stories, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits,
    {_rate('coalesce(sum(duplicates), 0)', 'coalesce(sum(articles), 0)')} AS duplicate_rate, {_rate('coalesce(sum(hits), 0)', '(coalesce(sum(calls), 0) + coalesce(sum(hits), 0))')} AS hit_rate,
    {_rate('coalesce(sum(duration_ms), 0)', 'count(topic)')} AS mean_ms, {_rate('coalesce(sum(sources), 0)', 'coalesce(sum(stories), 0)')} AS mean_sources, count(topic) AS briefings
  FROM cal LEFT JOIN runs USING (date) GROUP BY date)"""
_OVER = f"""{_PE}, said AS (
  SELECT date, count(*) FILTER (calls > 5) AS api_w, count(*) FILTER (calls <= 5 AND hits > 20) AS model_w FROM runs GROUP BY date), seen AS (
  SELECT CAST(created_at AS DATE) AS date, count(*) FILTER (kind = 'news_provider_failure') AS api_e, count(*) FILTER (kind = 'ai_request_failure') AS model_e FROM pe GROUP BY ALL), over_ AS (
  SELECT date, greatest(coalesce(api_w, 0), coalesce(api_e, 0)) AS api_failures, greatest(coalesce(model_w, 0), coalesce(model_e, 0)) AS model_failures FROM said FULL JOIN seen USING (date))"""
_JOBS = "jobs AS (SELECT date, CASE WHEN sum(calls) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, count(*) FILTER (hits % 4 = 0) AS topics_failed FROM runs GROUP BY date)"
_TOTAL = f"""{_TREND}, {_OVER}, {_JOBS}, total AS (
  SELECT r.*, f.*, j.* FROM (SELECT CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(stories) AS BIGINT) AS stories, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS briefings,
    {_rate('sum(duplicates)', 'sum(articles)')} AS duplicate_rate, {_rate('sum(hits)', '(sum(calls) + sum(hits))')} AS hit_rate, {_rate('sum(duration_ms)', 'count(*)')} AS mean_ms, {_rate('sum(sources)', 'sum(stories)')} AS mean_sources FROM runs) r,
  (SELECT CAST(sum(api_failures) AS BIGINT) AS api_failures, CAST(sum(model_failures) AS BIGINT) AS model_failures FROM over_) f,
  (SELECT count(*) FILTER (status = 'completed') AS jobs_completed, count(*) FILTER (status = 'failed') AS jobs_failed, CAST(sum(topics_failed) AS BIGINT) AS topics_failed FROM jobs) j)"""
_PF = "pf AS (SELECT CASE kind WHEN 'news_provider_failure' THEN 'news' ELSE 'ai' END AS kind, coalesce(provider, 'unknown') AS provider, count(*) AS n, first(code ORDER BY created_at, id) FILTER (code IS NOT NULL) AS last_code, first(code ORDER BY created_at DESC, id DESC) FILTER (code IS NOT NULL) AS newest_code FROM pe WHERE kind <> 'ai_request_retry' GROUP BY ALL)"
_LOG = "lg AS (SELECT user_id AS client, k AS story, ' Topic ' || (k % 10) AS topic, 'topic ' || (k % 10) AS topic_key, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS story_count, ts AS t_at, event_id, event_type FROM ev)"


def _searches(src: str) -> str:
    return f"""SELECT client, topic_key, max(t_at) AS searched_at, first(topic ORDER BY t_at DESC, event_id DESC) AS topic, first(story_count ORDER BY t_at DESC, event_id DESC) FILTER (story_count IS NOT NULL) AS story_count,
  CAST(row_number() OVER (PARTITION BY client ORDER BY max(t_at) DESC, topic_key) AS INTEGER) AS rn FROM {src} WHERE event_type = 'click' GROUP BY client, topic_key QUALIFY rn <= 50"""


def _views(src: str) -> str:
    return f"SELECT client, story, max(t_at) AS viewed_at, count(*) AS views, CAST(row_number() OVER (PARTITION BY client ORDER BY max(t_at) DESC, story) AS INTEGER) AS rn FROM {src} WHERE event_type = 'view' GROUP BY client, story QUALIFY rn <= 20"


_SAVED = """SELECT client, story, min(t_at) AS saved_at, CAST(row_number() OVER (PARTITION BY client ORDER BY min(t_at) DESC, story) AS INTEGER) AS rn
  FROM lg LEFT JOIN (SELECT client, story, max(t_at) AS removed_at FROM lg WHERE event_type = 'signup' GROUP BY ALL) g USING (client, story) WHERE event_type = 'purchase' AND (removed_at IS NULL OR t_at > removed_at) GROUP BY client, story QUALIFY rn <= 100"""
_LIVE = "lv AS (SELECT lg.* FROM lg LEFT JOIN (SELECT client, max(t_at) AS cleared_at FROM lg WHERE event_type = 'error' GROUP BY ALL) USING (client) WHERE cleared_at IS NULL OR t_at > cleared_at)"

_SAN = "coalesce(text, '')"
for _p, _r, _f in (
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ", "g"),
    (r"<<<\s*UNTRUSTED_[A-Z0-9_]+_(?:START|END)\s*>>>", "[UNTRUSTED_BOUNDARY_REDACTED]", "gi"),
    (r"(^|\n)\s*(?:system|assistant|developer|user)\s*:\s*", r"\1[role-mention]: ", "gi"),
    (r"```(?:system|assistant|json|xml|prompt)?", "` ` `", "gi"),
):
    _SAN = f"regexp_replace({'replace(' + _SAN + ', chr(13) || chr(10), chr(10))' if _f == 'g' else _SAN}, '{_p}', '{_r}', '{_f}')"
_SAN = rf"trim(regexp_replace(regexp_replace({_SAN}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_INJ = "|".join(f"(?:{p})" for p in hy.INJECTION)
_KEYS = "api[_-]?key|secret|token|password|authorization"
_RED1 = rf"""regexp_replace(regexp_replace(text, 'Bearer\s+[A-Za-z0-9\-._~+/]+=*', 'Bearer [redacted]', 'gi'), '\b({_KEYS})\s*[:=]\s*["'']?[^\s"'',}}]+', '\1=[redacted]', 'gi')"""

QUERIES = {
    "daily_trends": (lambda s, d: an.daily_trends(runs(s, d), ad.now(), DAYS).withColumn("date", F.col("date").cast("string")), f"WITH {_TREND} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM trend"),
    "failure_overlay": (lambda s, d: overlay(s, d).withColumn("date", F.col("date").cast("string")), f"WITH {_RUNS}, {_OVER} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM over_"),
    "topic_stats": (lambda s, d: an.topic_stats(runs(s, d)), f"WITH {_RUNS} SELECT topic, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(stories) AS BIGINT) AS stories, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS briefings, {_rate('sum(sources)', 'sum(stories)')} AS mean_sources FROM runs GROUP BY topic"),
    "most_covered_topics": (lambda s, d: an.most_covered_topics(runs(s, d)), f"WITH {_RUNS} SELECT topic, CAST(sum(stories) AS BIGINT) AS stories, count(*) AS briefings, CAST(sum(articles) AS BIGINT) AS articles FROM runs GROUP BY topic ORDER BY stories DESC, topic LIMIT 10"),
    "provider_failures": (lambda s, d: an.provider_failures(pipeline_events(s, d)), f"WITH {_EV}, {_PE}, {_PF} SELECT * FROM pf"),
    "window_totals": (totals, f"WITH {_TOTAL} SELECT * FROM total"),
    "operational_alerts": (
        q_operational_alerts,
        f"""WITH {_TOTAL}, {_PF}, t AS (SELECT count(*) AS n, first(calls ORDER BY date) AS calls0, last(calls ORDER BY date) AS calls1, first(mean_ms ORDER BY date) AS ms0, last(mean_ms ORDER BY date) AS ms1 FROM (SELECT * FROM trend ORDER BY date DESC LIMIT 3)),
x AS (SELECT total.*, t.*, (SELECT coalesce(sum(n), 0) FROM pf) AS failed FROM total, t), a AS (
  SELECT 'excessive_api_usage' AS kind, CASE WHEN NOT (api_failures >= 3 OR api_failures / greatest(1, briefings) >= 0.5) THEN 'info' WHEN api_failures >= 8 THEN 'critical' ELSE 'warning' END AS severity,
    CASE WHEN api_failures >= 3 OR api_failures / greatest(1, briefings) >= 0.5 THEN 'Excessive or failing news API usage' ELSE 'High article retrieval volume' END AS title,
    CASE WHEN api_failures >= 3 OR api_failures / greatest(1, briefings) >= 0.5 THEN 'apiFailures' ELSE 'articlesRetrieved' END AS metric, CAST(CASE WHEN api_failures >= 3 OR api_failures / greatest(1, briefings) >= 0.5 THEN api_failures ELSE articles END AS DOUBLE) AS value
  FROM x WHERE api_failures >= 3 OR api_failures / greatest(1, briefings) >= 0.5 OR articles / 31 >= 80
  UNION ALL SELECT 'excessive_ai_calls', CASE WHEN NOT (calls >= 40 AND hit_rate < 0.25) THEN 'info' WHEN calls >= 80 THEN 'critical' ELSE 'warning' END, CASE WHEN calls >= 40 AND hit_rate < 0.25 THEN 'Excessive AI calls' ELSE 'AI calls trending up' END, 'aiCalls', CASE WHEN calls >= 40 AND hit_rate < 0.25 THEN calls ELSE calls1 END
  FROM x WHERE (calls >= 40 AND hit_rate < 0.25) OR (n >= 2 AND calls1 > calls0 * 1.5 + 5)
  UNION ALL SELECT 'duplicate_news', CASE WHEN duplicate_rate >= 0.65 THEN 'critical' ELSE 'warning' END, 'High duplicate news rate', 'duplicateRate', duplicate_rate FROM x WHERE duplicate_rate >= 0.45
  UNION ALL SELECT 'slow_processing', CASE WHEN mean_ms >= 30000 THEN 'critical' WHEN mean_ms >= 15000 THEN 'warning' ELSE 'info' END, CASE WHEN mean_ms >= 15000 THEN 'Slow briefing generation' ELSE 'Processing time trending slower' END, 'averageBriefingGenerationMs', CASE WHEN mean_ms >= 15000 THEN mean_ms ELSE ms1 END
  FROM x WHERE mean_ms >= 15000 OR (n >= 2 AND ms0 > 0 AND ms1 > ms0 * 1.5)
  UNION ALL SELECT 'failed_providers', CASE WHEN failed + model_failures + jobs_failed >= 5 OR jobs_failed > 0 THEN 'critical' ELSE 'warning' END, 'Failed providers / jobs', 'failedProviders', failed + model_failures + jobs_failed FROM x WHERE failed + model_failures + jobs_failed > 0)
SELECT * FROM a UNION ALL SELECT 'none', 'info', 'No major pipeline anomalies detected in this window.', 'none', 0.0 WHERE NOT EXISTS (SELECT 1 FROM a)""",
    ),
    "run_metrics": (lambda s, d: an.run_metrics(runs(s, d))[0], f"WITH {_RUNS} SELECT CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(stories) AS BIGINT) AS stories, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS runs, {_rate('sum(duration_ms)', 'count(*)')} AS mean_ms, {_rate('sum(hits)', '(sum(hits) + sum(calls))')} AS hit_rate FROM runs"),
    "search_history": (lambda s, d: hi.search_history(log(s, d, "click")), f"WITH {_EV}, {_LOG} {_searches('lg')}"),
    "recently_viewed": (lambda s, d: hi.recently_viewed(log(s, d, "view")), f"WITH {_EV}, {_LOG} {_views('lg')}"),
    "saved_stories": (lambda s, d: hi.saved_stories(log(s, d, "purchase"), log(s, d, "signup")), f"WITH {_EV}, {_LOG} {_SAVED}"),
    "history_library": (
        q_history_library,
        f"""WITH {_EV}, {_LOG}, {_LIVE}, s AS ({_searches('lv')}), v AS ({_views('lv')}), k AS ({_SAVED}),
sl AS (SELECT client, string_agg(topic_key, ',' ORDER BY rn) AS searches, string_agg(topic_key, ',' ORDER BY rn) FILTER (rn <= 8) AS recent_searches FROM s GROUP BY client),
vl AS (SELECT client, string_agg(CAST(story AS VARCHAR), ',' ORDER BY rn) AS viewed FROM v GROUP BY client), kl AS (SELECT client, string_agg(CAST(story AS VARCHAR), ',' ORDER BY rn) AS saved FROM k GROUP BY client)
SELECT client, searches, viewed, saved, recent_searches FROM sl FULL JOIN vl USING (client) FULL JOIN kl USING (client)""",
    ),
    "sanitize_texts": (
        lambda s, d: hy.sanitize_texts(ad.table(s, d, "documents")),
        f"WITH x AS (SELECT source, coalesce(text, '') AS t, {_SAN} AS c FROM documents), y AS (SELECT source, t, CASE WHEN length(c) > 4000 THEN left(c, 4000) || '…[truncated]' ELSE c END AS s FROM x) SELECT source, count(*) AS n, count(*) FILTER (t <> s) AS changed, CAST(sum(length(s)) AS BIGINT) AS chars FROM y GROUP BY source",
    ),
    "flag_injection": (
        lambda s, d: hy.flag_injection(ad.table(s, d, "documents"), "text", "source"),
        rf"WITH x AS (SELECT source, regexp_matches(lower(text), '{_INJ}') AS i, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t FROM documents) SELECT source, count(*) AS n, count(*) FILTER (i) AS flagged, count(*) FILTER (t = '' OR i OR regexp_matches(t, '(?i)<<<\s*UNTRUSTED_') OR regexp_matches(t, '(?im)^\s*(system|assistant|developer)\s*:')) AS unsafe, {_rate('count(*) FILTER (i)', 'count(*)')} AS rate FROM x GROUP BY source",
    ),
    "redact_secrets": (
        lambda s, d: hy.redact_secrets(ad.table(s, d, "documents")),
        rf"WITH x AS (SELECT doc_id, {_RED1} AS t FROM documents), y AS (SELECT doc_id, left(nullif(CASE WHEN regexp_matches(t, '(?i)\b({_KEYS}|bearer)\b') THEN regexp_replace(t, '[A-Za-z0-9_\-]{{20,}}', '[redacted]', 'g') ELSE t END, ''), 280) AS detail FROM x) SELECT doc_id, detail, contains(detail, '[redacted]') AS has_redaction FROM y",
    ),
    "safe_urls": (lambda s, d: hy.safe_urls(ad.table(s, d, "pages"), "url"), f"SELECT {sq.host('url')} AS host, count(*) FILTER (regexp_matches(url, '^(?i:https?)://[^/?#\\s]') AND NOT contains(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '@')) AS safe, count(*) FILTER (NOT (regexp_matches(url, '^(?i:https?)://[^/?#\\s]') AND NOT contains(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '@'))) AS rejected FROM pages GROUP BY 1"),
    "append_pipeline_events": (q_append_pipeline_events, f"WITH {_EV}, {_PE} SELECT id, left(repeat(event_type, 30), 120) AS topic, provider, code, 'call failed, token=[redacted] from ' || coalesce(provider, 'none') AS detail, 'k' AS meta_keys FROM pe"),
}
