"""Daily briefings of all topics in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.config import Config
from storyspark.operators import briefings as br
from storyspark.operators import changes as ch
from storyspark.operators import stories as st
from storyspark.operators.articles import dedupe_stats
from storyspark.plans.cutting import materialize
from storyspark.sources.snapshots import snapshots_as_of


def build_briefings(normalized: DataFrame, prior: DataFrame | None, cache: DataFrame, phrase: Column, now: Column, cfg: Config = Config(), ttl_hours: int = 168) -> dict[str, DataFrame]:
    """cards, whats_new, stats, plan, changes and the next snapshot of every topic: stories, changes, reuse, diverse choice, extractive summaries.

    prior: snapshots (``read_snapshots``: topic, generated_at and story states) of any times, or None; a topic is compared
    with its latest one at or before ``now`` and within the TTL, and its label counts from that one's time. cache:
    provider, content_hash, expires_at. Topics are one key of one plan; nothing loops over them.
    """
    exact, after = st.distinct_articles(normalized, cfg)
    members = materialize(st.cluster_articles(after, cfg.cluster_threshold), "members")
    cohesion = materialize(st.cluster_cohesion(members), "cohesion")
    seen = st.assess_verification(members, cohesion, now, cfg).select("cluster_no", "independent_count", "level")
    whole = st.build_clusters(members, cfg).join(st.score_clusters(members, phrase, now, cfg), "cluster_no").join(cohesion, "cluster_no").join(seen, "cluster_no")
    ranked = materialize(st.rank_stories(whole, 2 * cfg.max_stories), "ranked")
    state = ch.story_state(members).join(ranked.select("cluster_no", "headline", "rank"), "cluster_no")
    state = materialize(state, "state")
    topics = state.select("topic").distinct()
    if prior is None:
        blank = state.select("topic", "cluster_no", "urls", "sources", "headline", "published_at", "content_hash", "stable_id", now.alias("first_seen"), now.alias("last_updated")).limit(0)
        prior = blank.withColumn("generated_at", now)
    prior = materialize(snapshots_as_of(prior, topics.withColumn("run_at", now), ttl_hours).drop("run_at"), "prior")
    compared = topics.join(prior.groupBy("topic").agg(F.max("generated_at").alias("generated_at")), "topic", "left")
    changes = materialize(ch.classify_changes(state, prior, ch.match_prior_stories(state, prior), now), "changes")
    plan = ch.plan_result_reuse(changes.join(state.select("cluster_no", "content_hash", "rank"), "cluster_no"), cache, "extractive", now)
    chosen = materialize(st.select_diverse_topn(ranked, cfg.max_stories), "chosen")
    reps = st.pick_representative(members, cfg)
    summaries = br.extractive_summary(br.summary_inputs(members, reps, cfg.summary_articles))
    cards = materialize(br.story_cards(chosen, summaries, changes), "cards")
    clusters = members.select("topic", "cluster_no").distinct()
    stats = briefing_stats(dedupe_stats(normalized, exact, after, clusters), plan.join(state.select("cluster_no", "topic"), "cluster_no"))
    snapshot = ch.snapshot_from_changes(changes, state).drop("rank").withColumn("generated_at", now)
    return {"cards": cards, "whats_new": ch.whats_new(cards, compared, now), "stats": stats, "plan": plan, "changes": changes, "state": state, "prior": prior, "snapshot": snapshot}


def briefing_stats(dedupe: DataFrame, plan: DataFrame) -> DataFrame:
    """Per topic: articles, duplicates removed (exact, near and collapsed), clusters, calls, hits.

    plan: topic, decision.
    """
    by = plan.groupBy("topic").agg(F.count_if(F.col("decision") == "compute").alias("calls"), F.count_if(F.col("decision") != "compute").alias("hits"))
    out = dedupe.join(by, "topic", "left").na.fill(0)
    return out.select("topic", F.col("after_normalize").alias("articles"), (F.col("exact_removed") + F.col("near_removed") + F.col("collapsed")).alias("duplicates_removed"), "clusters", "calls", "hits")
