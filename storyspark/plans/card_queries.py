"""Registered queries of briefings, cards, coverage and model replies, with their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.operators import near_duplicates as nd
from storyspark.operators import replies as rp
from storyspark.plans import briefing as bf
from storyspark.plans import briefing_queries as bq
from storyspark.plans import sql_parts as sq
from storyspark.plans import story_queries as sy
from storyspark.plans.cutting import materialize, shared_dir
from storyspark.sources import snapshots


def _built(s, d):
    cache = s.createDataFrame([], "provider string, content_hash string, expires_at timestamp")
    return bf.build_briefings(sy.normalized(s, d), None, cache, sy.phrase(), ad.now())


def history(s, d):
    """Written and found snapshots: all topics on the 20th, the German one on the 28th, the English and French ones on the 30th; each without a part of the articles."""
    path = f"{shared_dir(s)}/snapshots-{uuid.uuid4().hex}"
    for at, known, topics in (("2024-01-20 00:00:00", "ordinal % 2 = 0", ["en", "fr", "de", "es"]), ("2024-01-28 00:00:00", "ordinal % 4 <> 0", ["de"]), ("2024-01-30 06:00:00", "ordinal % 5 <> 1", ["en", "fr"])):
        rows = bq.state_of(s, d, known, topics)
        snapshots.write_topic_snapshot(rows.withColumns({c: ad.now(at) for c in ("first_seen", "last_updated", "generated_at")}), path)
    return snapshots.read_snapshots(s, path)


def built_on_history(s, d):
    """With near duplicates collapsed, snapshots of several times, and every third of their results in the cache."""
    prior = materialize(history(s, d), "history")
    cache = prior.filter("cluster_no % 3 = 0").select(F.lit("extractive").alias("provider"), "content_hash", F.when(F.col("cluster_no") % 6 == 0, ad.now("2024-02-01")).otherwise(ad.now("2024-01-25")).alias("expires_at"))
    return bf.build_briefings(sy.normalized(s, d), prior, cache, sy.phrase(), ad.now(), sy.NEAR_CONFIG)


def q_story_cards(s, d):
    return _built(s, d)["cards"].select("topic", "rank", "cluster_id", "headline", "covered_by", F.array_join("urls", " ").alias("urls"), "importance", "primary_source", "status", F.md5("summary").alias("summary_md5"))


def q_build_briefings(s, d):
    b = built_on_history(s, d)
    return b["whats_new"].withColumn("highlights", F.size("highlights")).join(b["stats"], "topic")


def q_briefing_stats(s, d):
    return built_on_history(s, d)["stats"]


def q_coverage_sources(s, d):
    return nd.coverage_sources(_built(s, d)["cards"])


def q_comparable_stories(s, d):
    return nd.comparable_stories(q_coverage_sources(s, d))


def _facts(cards):
    return cards.withColumn("key_facts", F.split("summary", "[.!?] +"))


def q_compare_coverage(s, d):
    c = _built(s, d)["cards"]
    out = nd.compare_coverage(_facts(c), nd.coverage_sources(c))
    reports = F.array_join(F.transform("reports", lambda x: F.concat_ws("|", x.source, x.url, F.md5(x.detail))), " ")
    return out.select("cluster_no", F.md5(F.array_join("claims", "|")).alias("claims"), F.size("majority_facts").alias("n_majority"), F.array_join("sources", ",").alias("sources"), reports.alias("reports"), F.size("missing").alias("n_missing"))


def q_conflict_positions(s, d):
    c = _built(s, d)["cards"]
    position = lambda x: F.struct(F.upper(x).alias("source"), F.concat(F.lit("claim of "), x).alias("claim"))
    said = c.select("cluster_no", F.lit("issue").alias("issue"), F.transform(F.concat(F.split("covered_by", " · "), F.array(F.lit("nobody"))), position).alias("positions"))
    return nd.conflict_positions(said, nd.coverage_sources(c))


def replies(s, d):
    """Documents in the shape of model replies: sound, fenced, broken, with missing fields or wrong values."""
    doc = ad.table(s, d, "documents")
    k = F.col("doc_id") % 7
    head = F.concat(F.lit("Story "), F.col("doc_id").cast("string"))
    body = F.to_json(F.struct(F.when(k != 2, head).alias("headline"), F.when(k != 3, F.col("text")).alias("summary"), F.when(k == 4, "sure").when(k != 5, "High").alias("confidence")))
    reply = F.when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 6, F.concat(F.lit("Sorry: "), body)).otherwise(body)
    return doc.select(F.col("doc_id").alias("reply_id"), F.col("source").alias("provider"), reply.alias("reply"))


def q_validate_model_outputs(s, d):
    valid, bad = rp.validate_model_outputs(replies(s, d))
    return valid.select("reply_id", F.lit(None).cast("string").alias("reason"), "confidence").unionByName(bad.select("reply_id", "reason", F.lit(None).cast("string").alias("confidence")))


_INPUTS = f"""{sq.STORIES}, si AS (SELECT m.cluster_no, list(coalesce(snippet, '') ORDER BY ordinal <> representative, coalesce(epoch_us(published_at), 0) DESC, ordinal)[1:6] AS ds, list(source_name ORDER BY ordinal <> representative, coalesce(epoch_us(published_at), 0) DESC, ordinal)[1:6] AS ns FROM members m JOIN reps USING (cluster_no) GROUP BY ALL)
, sm AS (SELECT cluster_no, left(CASE WHEN len(list_filter(list_transform(ds, lambda x: trim(left(x, 2000))), lambda x: x <> '')) > 0 THEN array_to_string(list_filter(list_transform(ds, lambda x: trim(left(x, 2000))), lambda x: x <> '')[1:2], ' ') ELSE 'Reporting from ' || array_to_string(list_distinct(ns), ', ') || '.' END, 1200) AS summary FROM si)
, cut AS (SELECT *, row_number() OVER (PARTITION BY topic, rep_source ORDER BY rank) > 2 AS late FROM stories WHERE rank <= 30), pos AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY late, rank) AS position FROM cut)
, ul AS (SELECT cluster_no, list(url ORDER BY coalesce(epoch_us(published_at), 0) DESC, ordinal) AS us FROM members GROUP BY cluster_no)
, cards AS (SELECT p.*, replace(p.sources, ',', ' · ') AS covered_by, list_concat([p.rep_url], list_filter(us, lambda u: u <> p.rep_url)) AS urls, summary FROM pos p JOIN ul USING (cluster_no) JOIN sm USING (cluster_no) WHERE position <= 15)
, cs AS (SELECT cluster_no, k - 1 AS position, urls[k] AS url, CASE WHEN k = 1 THEN rep_source ELSE coalesce(string_split(covered_by, ' · ')[k], 'Source') END AS source FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS k FROM cards))"""
_STATS = f"""{sq.CLUSTERED}, n AS (SELECT topic, count(*) AS a FROM norm GROUP BY topic), m AS (SELECT topic, count(*) AS b, count(DISTINCT cluster_no) AS c FROM members GROUP BY topic)"""

QUERIES = {
    "story_cards": (q_story_cards, f"WITH RECURSIVE {_INPUTS} SELECT topic, CAST(rank AS INTEGER) AS rank, cluster_id, headline, covered_by, array_to_string(urls, ' ') AS urls, importance, rep_source AS primary_source, 'new' AS status, md5(summary) AS summary_md5 FROM cards"),
    "build_briefings": (q_build_briefings, None),
    "briefing_stats": (q_briefing_stats, None),
    "coverage_sources": (q_coverage_sources, f"WITH RECURSIVE {_INPUTS} SELECT cluster_no, CAST(position AS INTEGER) AS position, url, source FROM cs"),
    "comparable_stories": (q_comparable_stories, f"WITH RECURSIVE {_INPUTS} SELECT cluster_no, count(*) AS n, count(*) >= 2 AS comparable, CASE WHEN count(*) < 2 THEN 'fewer than two source articles' END AS reason FROM cs GROUP BY cluster_no"),
    "compare_coverage": (
        q_compare_coverage,
        f"""WITH RECURSIVE {_INPUTS}, ls AS (SELECT cluster_no, list({{'s': source, 'u': url}} ORDER BY position) AS s FROM cs GROUP BY cluster_no HAVING count(*) >= 2), cf AS (SELECT c.cluster_no, rep_source, summary, regexp_split_to_array(summary, '[.!?] +') AS kf, s FROM cards c JOIN ls USING (cluster_no))
SELECT cluster_no, md5(array_to_string(kf[1:6], '|')) AS claims, CAST(len(kf[1:4]) AS INTEGER) AS n_majority, array_to_string(list_transform(s, lambda x: x.s), ',') AS sources,
  array_to_string(list_transform(s, lambda x: x.s || '|' || x.u || '|' || md5(CASE WHEN x.s = rep_source THEN 'Primary coverage summary: ' || summary ELSE 'Also covering this event (see article).' END)), ' ') AS reports, CAST(CASE WHEN len(s) < 3 THEN 1 ELSE 0 END AS INTEGER) AS n_missing FROM cf""",
    ),
    "conflict_positions": (
        q_conflict_positions,
        f"""WITH RECURSIVE {_INPUTS}, p AS (SELECT cluster_no, unnest(list_concat(string_split(covered_by, ' · '), ['nobody'])) AS n FROM cards)
SELECT p.cluster_no, 'issue' AS issue, upper(n) AS source, 'claim of ' || n AS claim, f.url FROM p LEFT JOIN (SELECT cluster_no, lower(source) AS k, first(url ORDER BY position) AS url FROM cs GROUP BY ALL) f ON f.cluster_no = p.cluster_no AND f.k = lower(n)""",
    ),
    "validate_model_outputs": (
        q_validate_model_outputs,
        r"""WITH x AS (SELECT doc_id, doc_id % 7 AS k, text, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t FROM documents), r AS (SELECT doc_id, k, CASE WHEN k = 6 THEN 'not JSON' WHEN k = 2 THEN 'missing headline' WHEN k = 3 OR trim(coalesce(text, '')) = '' THEN 'missing summary' WHEN length(text) > 4000 THEN 'summary too long' WHEN k = 4 THEN 'bad confidence'
  WHEN regexp_matches(lower(t), '(?:ignore\s+(all\s+)?(previous|prior|above)\s+instructions)|(?:reveal\s+(the\s+)?system\s+prompt)|(?:disregard\s+(your|the)\s+(rules|instructions))|(?:you\s+are\s+now\s+(dan|unrestricted|jailbroken))|(?:exfiltrate|api[_-]?key|password\s*=)') OR regexp_matches(t, '(?im)^\s*(system|assistant|developer)\s*:') THEN 'unsafe output' END AS reason FROM x)
SELECT doc_id AS reply_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN k = 5 THEN 'medium' ELSE 'high' END END AS confidence FROM r""",
    ),
}
