"""Registered queries of the article and story operators, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.config import Config
from storyspark.functions.text import round_k
from storyspark.operators import articles as ar
from storyspark.operators import similar as sim
from storyspark.operators import stories as st
from storyspark.plans import sql_parts as sq
from storyspark.plans.cutting import materialize

THRESHOLD = 0.5
NEAR = 0.7
#: Titles alone score 0.8 at most.
NEAR_CONFIG = Config(near_duplicate_threshold=0.75)


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return ar.normalize_articles(ad.articles_from_documents(spark, sf), ad.tiers(spark), ad.publishers(spark))


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return ar.dedupe_best_by_url(normalized(spark, sf))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(st.cluster_articles(materialize(deduped(spark, sf), "deduped"), THRESHOLD), "members")


def phrase():
    return ad.topic_phrase(F.col("topic"))


def q_articles_from_pages(spark, sf):
    return ad.articles_from_pages(spark, sf)


def q_normalize_articles(spark, sf):
    rows = ar.normalize_articles(ad.articles_from_pages(spark, sf), ad.tiers(spark), ad.publishers(spark))
    return rows.select("ordinal", "url", "canonical_url", "title", "normalized_title", "snippet", "source_name", "source_tier", "publisher_id", "published_at")


def q_resolve_sources(spark, sf):
    return normalized(spark, sf).select("ordinal", "source_name", "source_tier", "publisher_id", "source_quality")


def q_filter_recency(spark, sf):
    return ar.filter_recency(ad.articles_from_documents(spark, sf), ad.now(), 240).select("ordinal", "topic", "published_at")


def q_filter_relevance_gate(spark, sf):
    return ar.filter_relevance_gate(ad.articles_from_documents(spark, sf), phrase()).select("ordinal", "topic")


def q_latest_articles(spark, sf):
    return ar.latest_articles(ad.articles_from_documents(spark, sf), 50).select("topic", "rn", "ordinal")


def q_union_sources(spark, sf):
    found = {"documents": ad.articles_from_documents(spark, sf), "pages": ad.articles_from_pages(spark, sf)}
    return ar.union_sources(found)[1]


def q_ingest_articles(spark, sf):
    found = {"documents": ad.articles_from_documents(spark, sf)}
    return ar.ingest_articles(found, phrase(), ad.now()).select("topic", "rn", "ordinal")


def q_dedupe_first_seen(spark, sf):
    return ar.dedupe_first_seen(ad.articles_from_documents(spark, sf)).select("ordinal", "url")


def q_dedupe_best_by_url(spark, sf):
    return deduped(spark, sf).select("ordinal", "canonical_url", "source_tier")


def q_near_duplicate_pairs(spark, sf):
    pairs = sim.similar_pairs(deduped(spark, sf), NEAR, sim.headline(), within=["source_name"])
    return pairs.select("a", "b", round_k(F.col("score")).alias("score"))


def q_similar_pairs(spark, sf):
    return sim.similar_pairs(deduped(spark, sf), THRESHOLD).select("a", "b", round_k(F.col("score")).alias("score"))


def q_cluster_articles(spark, sf):
    return members(spark, sf).select("ordinal", "topic", "cluster_no")


def q_cluster_cohesion(spark, sf):
    return st.cluster_cohesion(members(spark, sf))


def q_pick_representative(spark, sf):
    return st.pick_representative(members(spark, sf))


def q_pick_headline(spark, sf):
    m = members(spark, sf)
    return st.pick_headline(m, st.pick_representative(m))


def q_build_clusters(spark, sf):
    out = st.build_clusters(members(spark, sf))
    return out.select("topic", "cluster_id", "representative", "headline", F.array_join("sources", ",").alias("sources"), "source_count", "article_count", "first_published_at", "latest_published_at", F.array_join(F.transform("articles", lambda a: a.ordinal.cast("string")), ",").alias("article_ids"))


def q_score_clusters(spark, sf):
    return st.score_clusters(members(spark, sf), phrase(), ad.now())


def _part(column):
    return lambda spark, sf: q_score_clusters(spark, sf).select("cluster_no", column)


def q_assess_verification(spark, sf):
    m = members(spark, sf)
    out = st.assess_verification(m, st.cluster_cohesion(m), ad.now())
    return out.select("cluster_no", "source_count", "independent_count", "source_diversity", "source_recency", "source_quality", "confirms_event", "first_reporter", "level", "label", "detail", "icon", F.array_join("signals", "|").alias("signals"), F.array_join(F.transform("publishers", lambda p: p.id), "|").alias("publishers"))


def q_mark_contested(spark, sf):
    m = members(spark, sf)
    hot = m.filter("source_tier = 1").select("cluster_no").distinct()
    return st.assess_verification(m, st.cluster_cohesion(m), ad.now(), contested=hot).select("cluster_no", "level", "label", "icon", F.size("signals").alias("n_signals"))


def q_process_articles(spark, sf):
    out = st.process_articles(normalized(spark, sf), phrase(), ad.now())
    return out.select("topic", "rank", "cluster_id", "headline", "importance", "freshness", "similarity_score", "independent_count", "level", "article_count")


def q_select_diverse_topn(spark, sf):
    ranked = st.process_articles(normalized(spark, sf), phrase(), ad.now(), top=60)
    return st.select_diverse_topn(ranked, 15).select("topic", "position", "rank", "cluster_id", "rep_source")


def q_dedupe_stats(spark, sf):
    return _stats(spark, sf, Config())


def _stats(spark, sf, cfg):
    n = materialize(normalized(spark, sf), "normalized")
    exact, after = st.distinct_articles(n, cfg)
    c = st.cluster_articles(after, cfg.cluster_threshold).select("topic", "cluster_no").distinct()
    return ar.dedupe_stats(n, exact, after, c)


def q_dedupe_stats_near(spark, sf):
    """With a threshold that headlines reach."""
    return _stats(spark, sf, NEAR_CONFIG)


def q_process_articles_near(spark, sf):
    out = st.process_articles(normalized(spark, sf), phrase(), ad.now(), NEAR_CONFIG)
    return out.select("topic", "rank", "cluster_id", "headline", "importance", "freshness", "similarity_score", "independent_count", "level", "article_count")


_SIGNALS = """array_to_string(list_filter([{hot} CASE WHEN independent_count <= 1 THEN 'Currently reported by a single source' WHEN independent_count >= 3 AND similarity_score >= 0.35 THEN 'Reported by ' || independent_count || ' independent sources' WHEN independent_count >= 2 AND similarity_score >= 0.35 THEN 'Multiple sources confirm the event' END,
  CASE WHEN first_reporter IS NOT NULL THEN 'First reported by ' || first_reporter END,
  CASE WHEN source_count > independent_count THEN source_count || ' named outlets mapped to ' || independent_count || ' independent publishers' END], lambda x: x IS NOT NULL), '|')"""
_NEAR = lambda part: part.replace(sq.DEDUPED, sq.near_deduped(NEAR_CONFIG.near_duplicate_threshold))
_DETAIL = "CASE WHEN independent_count >= 2 THEN independent_count || ' independent sources' ELSE 'Only one source currently available' END"
_GATE = f"""
gate AS (SELECT *, (contains({sq.TEXT}, lower({sq.PHRASE})) OR {sq.RELEVANCE} > 0) AS rel FROM {{src}})
, gated AS (SELECT * FROM gate QUALIFY count(*) FILTER (rel) OVER (PARTITION BY topic) < ceil(count(*) OVER (PARTITION BY topic) / 2) OR rel)"""
_PAGES = rf"""
pg AS (SELECT page_id AS ordinal, url, {sq.strip_html("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
  left({sq.strip_html("array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), ' ')")}, 300) AS snippet, nullif(regexp_extract(html, '<img[^>]* src="(https?://[^"]*)"', 1), '') AS image_url,
  {sq.host('url')} AS source_name, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS topic, e.ts AS published_at
FROM pages p JOIN events e ON p.page_id = e.event_id)"""

QUERIES = {
    "articles_from_pages": (q_articles_from_pages, f"WITH {_PAGES} SELECT * FROM pg"),
    "normalize_articles": (q_normalize_articles, f"WITH {_PAGES} SELECT ordinal, url, {sq.canonical('url')} AS canonical_url, title, {sq.headline('title')} AS normalized_title, nullif(trim(snippet), '') AS snippet, source_name, 3 AS source_tier, source_name AS publisher_id, published_at FROM pg WHERE title <> ''"),
    "resolve_sources": (q_resolve_sources, f"WITH {sq.NORMALIZED} SELECT ordinal, source_name, source_tier, publisher_id, {sq.tier_score('source_tier')} AS source_quality FROM norm"),
    "filter_recency": (q_filter_recency, f"WITH {sq.ARTICLES} SELECT ordinal, topic, published_at FROM art WHERE published_at IS NULL OR published_at >= {sq.NOW_TS} - INTERVAL 240 HOUR"),
    "filter_relevance_gate": (q_filter_relevance_gate, f"WITH {sq.ARTICLES}, {_GATE.format(src='art')} SELECT ordinal, topic FROM gated"),
    "latest_articles": (q_latest_articles, f"WITH {sq.ARTICLES} SELECT topic, CAST(rn AS INTEGER) AS rn, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY coalesce(published_at, TIMESTAMP '1970-01-01') DESC, ordinal) AS rn FROM art) WHERE rn <= 50"),
    "union_sources": (q_union_sources, f"WITH {sq.ARTICLES}, {_PAGES} SELECT 'documents' AS provider, count(*) AS articles, 'ok' AS status FROM art UNION ALL SELECT 'pages', count(*), 'ok' FROM pg"),
    "ingest_articles": (
        q_ingest_articles,
        f"""WITH {sq.ARTICLES}, first AS (SELECT * FROM art WHERE published_at IS NULL OR true QUALIFY row_number() OVER (PARTITION BY {sq.canonical('url')} ORDER BY ordinal) = 1)
, fresh AS (SELECT * FROM first WHERE published_at IS NULL OR published_at >= {sq.NOW_TS} - INTERVAL 48 HOUR), {_GATE.format(src='fresh')}
SELECT topic, CAST(rn AS INTEGER) AS rn, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY coalesce(published_at, TIMESTAMP '1970-01-01') DESC, ordinal) AS rn FROM gated) WHERE rn <= 50""",
    ),
    "dedupe_first_seen": (q_dedupe_first_seen, f"WITH {sq.ARTICLES} SELECT ordinal, url FROM art QUALIFY row_number() OVER (PARTITION BY {sq.canonical('url')} ORDER BY ordinal) = 1"),
    "dedupe_best_by_url": (q_dedupe_best_by_url, f"WITH {sq.DEDUPED} SELECT ordinal, canonical_url, source_tier FROM dedup"),
    "near_duplicate_pairs": (
        q_near_duplicate_pairs,
        f"""WITH {sq.PAIRED}, hp AS (SELECT a.ordinal AS a, b.ordinal AS b, {sq.title_score('a', 'b')} * 0.7::DOUBLE + {sq.significant_score('a', 'b')} * 0.1::DOUBLE AS score FROM feat a JOIN feat b ON a.source_name = b.source_name AND a.ordinal < b.ordinal)
SELECT a, b, {sq.rnd('score')} AS score FROM hp WHERE score >= 0.7::DOUBLE""",
    ),
    "similar_pairs": (q_similar_pairs, f"WITH {sq.PAIRED} SELECT a, b, {sq.rnd('score')} AS score FROM pairs"),
    "cluster_articles": (q_cluster_articles, f"WITH RECURSIVE {sq.CLUSTERED} SELECT ordinal, topic, cluster_no FROM members"),
    "cluster_cohesion": (q_cluster_cohesion, f"WITH RECURSIVE {sq.SCORED} SELECT cluster_no, similarity_score FROM cohesion"),
    "pick_representative": (q_pick_representative, f"WITH RECURSIVE {sq.SCORED} SELECT * FROM reps"),
    "pick_headline": (q_pick_headline, f"WITH RECURSIVE {sq.SCORED} {sq.HEADLINES} SELECT * FROM heads"),
    "build_clusters": (q_build_clusters, f"WITH RECURSIVE {sq.STORIES} SELECT topic, cluster_id, representative, headline, sources, source_count, article_count, first_published_at, latest_published_at, article_ids FROM stories"),
    "score_clusters": (q_score_clusters, f"WITH RECURSIVE {sq.SCORED} SELECT * FROM scores"),
    "score_relevance": (_part("relevance"), f"WITH RECURSIVE {sq.SCORED} SELECT cluster_no, relevance FROM scores"),
    "score_freshness": (_part("freshness"), f"WITH RECURSIVE {sq.SCORED} SELECT cluster_no, freshness FROM scores"),
    "score_source_diversity": (_part("diversity"), f"WITH RECURSIVE {sq.SCORED} SELECT cluster_no, diversity FROM scores"),
    "score_source_quality": (_part("quality"), f"WITH RECURSIVE {sq.SCORED} SELECT cluster_no, quality FROM scores"),
    "score_importance": (_part("importance"), f"WITH RECURSIVE {sq.SCORED} SELECT cluster_no, importance FROM scores"),
    "assess_verification": (
        q_assess_verification,
        f"""WITH RECURSIVE {sq.SCORED} SELECT cluster_no, source_count, independent_count, {sq.rnd('least(1.0::DOUBLE, independent_count / 5)')} AS source_diversity, {sq.rnd(sq.FRESHNESS)} AS source_recency, {sq.rnd('quality')} AS source_quality,
  independent_count >= 2 AND similarity_score >= 0.35 AS confirms_event, first_reporter, {sq.LEVEL} AS level, CASE WHEN independent_count >= 2 THEN 'Multiple sources' ELSE 'Limited reporting' END AS label, {_DETAIL} AS detail,
  CASE WHEN independent_count >= 2 THEN 'check' ELSE 'warning' END AS icon, {_SIGNALS.format(hot='')} AS signals, (SELECT string_agg(publisher_id, '|' ORDER BY o, publisher_id) FROM pubs WHERE pubs.cluster_no = verif.cluster_no) AS publishers FROM verif""",
    ),
    "mark_contested": (
        q_mark_contested,
        f"""WITH RECURSIVE {sq.SCORED}, hot AS (SELECT DISTINCT cluster_no, true AS hot FROM members WHERE source_tier = 1), v AS (SELECT verif.*, coalesce(hot, false) AS hot FROM verif LEFT JOIN hot USING (cluster_no))
SELECT cluster_no, CASE WHEN hot THEN 'contested' ELSE {sq.LEVEL} END AS level, CASE WHEN hot THEN 'Sources diverge' WHEN independent_count >= 2 THEN 'Multiple sources' ELSE 'Limited reporting' END AS label,
  CASE WHEN hot OR independent_count < 2 THEN 'warning' ELSE 'check' END AS icon, CAST(len(string_split({_SIGNALS.format(hot="CASE WHEN hot THEN 'Sources disagree on key details' END,")}, '|')) AS INTEGER) AS n_signals FROM v""",
    ),
    "process_articles_near": (q_process_articles_near, f"WITH RECURSIVE {_NEAR(sq.STORIES)} SELECT topic, CAST(rank AS INTEGER) AS rank, cluster_id, headline, importance, freshness, similarity_score, independent_count, {sq.LEVEL} AS level, article_count FROM stories WHERE rank <= 15"),
    "dedupe_stats_near": (
        q_dedupe_stats_near,
        f"""WITH RECURSIVE {_NEAR(sq.CLUSTERED)} SELECT topic, n AS after_normalize, n - e AS exact_removed, e - d AS near_removed, d AS after_dedupe, c AS clusters, greatest(0, d - c) AS collapsed, {sq.rnd('c / n', 3)} AS compression_ratio
FROM (SELECT topic, count(*) AS n FROM norm GROUP BY topic) JOIN (SELECT topic, count(*) AS e FROM exact GROUP BY topic) USING (topic) JOIN (SELECT topic, count(*) AS d, count(DISTINCT cluster_no) AS c FROM members GROUP BY topic) USING (topic)""",
    ),
    "process_articles": (q_process_articles, f"WITH RECURSIVE {sq.STORIES} SELECT topic, CAST(rank AS INTEGER) AS rank, cluster_id, headline, importance, freshness, similarity_score, independent_count, {sq.LEVEL} AS level, article_count FROM stories WHERE rank <= 15"),
    "select_diverse_topn": (
        q_select_diverse_topn,
        f"""WITH RECURSIVE {sq.STORIES}, cut AS (SELECT *, row_number() OVER (PARTITION BY topic, rep_source ORDER BY rank) > 2 AS late FROM stories WHERE rank <= 60), pos AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY late, rank) AS position FROM cut)
SELECT topic, CAST(position AS INTEGER) AS position, CAST(rank AS INTEGER) AS rank, cluster_id, rep_source FROM pos WHERE position <= 15""",
    ),
    "dedupe_stats": (
        q_dedupe_stats,
        f"""WITH RECURSIVE {sq.CLUSTERED} SELECT topic, n AS after_normalize, n - d AS exact_removed, CAST(0 AS BIGINT) AS near_removed, d AS after_dedupe, c AS clusters, greatest(0, d - c) AS collapsed, {sq.rnd('c / n', 3)} AS compression_ratio
FROM (SELECT topic, count(*) AS n FROM norm GROUP BY topic) JOIN (SELECT topic, count(*) AS d, count(DISTINCT cluster_no) AS c FROM members GROUP BY topic) USING (topic)""",
    ),
}
