"""Change tracking between snapshots of a topic's stories, and reuse of earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.functions.text import headline_unicode, short_hash
from storyspark.plans.cutting import discard, materialize


def story_state(members: DataFrame) -> DataFrame:
    """topic, cluster_no, urls, sources, published_at, stable_id, content_hash of each cluster."""
    content = F.concat_ws("\x1f", "canonical_url", "title", F.coalesce("snippet", F.lit("")))
    by = members.groupBy("topic", "cluster_no").agg(F.array_sort(F.collect_set("canonical_url")).alias("urls"), F.array_sort(F.collect_set("source_name")).alias("sources"), F.max("published_at").alias("published_at"), F.array_sort(F.collect_list(content)).alias("content"))
    return by.select("topic", "cluster_no", "urls", "sources", "published_at", short_hash(F.array_join("urls", "|")).alias("stable_id"), content_hash(F.col("topic"), F.col("content")).alias("content_hash"))


def content_hash(topic: Column, content: Column) -> Column:
    """24 hex digits over the topic and the sorted contents; equal content, equal hash."""
    return short_hash(F.concat_ws("\x1e", topic, F.array_join(content, "\x1e")), 24)


def prior_pairs(current: DataFrame, prior: DataFrame) -> DataFrame:
    """cluster_no, prior_no, shared, overlap (Jaccard), of_smaller: pairs of one topic with a common url."""
    c = current.select("topic", "cluster_no", F.size("urls").alias("n"), F.explode("urls").alias("url"))
    p = prior.select("topic", F.col("cluster_no").alias("prior_no"), F.size("urls").alias("m"), F.explode("urls").alias("url"))
    by = c.join(p, ["topic", "url"]).groupBy("topic", "cluster_no", "prior_no", "n", "m").agg(F.count("*").alias("shared"))
    return by.select("topic", "cluster_no", "prior_no", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("overlap"), (F.col("shared") / F.least("n", "m")).alias("of_smaller"))


def match_prior_stories(current: DataFrame, prior: DataFrame, min_overlap: float = 0.25) -> DataFrame:
    """cluster_no, prior_no, overlap: in rank order, each story takes the free prior one of highest overlap.

    Accepted at ``min_overlap``, or with half of the smaller set in common; equal overlaps go to the smaller
    prior_no. A story whose best free prior one is not accepted takes none. current has rank (ties go by
    cluster_no); stories without one take no part.

    Decided in rounds of joins, so that no task holds a group: a story settles once no earlier story that is
    still open can take its best prior one. The first open story of a topic always can, and in an
    order without relation to the overlaps the rounds grow with the logarithm of the stories (Blelloch et al. 2012).
    """
    good = (F.col("overlap") >= min_overlap) | (F.col("of_smaller") >= 0.5)
    ranked = current.filter("rank is not null").select("cluster_no", "rank")
    pairs = prior_pairs(current, prior).join(ranked, "cluster_no")
    open_ = materialize(pairs.select("cluster_no", "prior_no", "overlap", good.alias("good"), F.struct("rank", "cluster_no").alias("turn")), "open")
    taken = open_.select("cluster_no", "prior_no", "overlap").limit(0)
    while not open_.isEmpty():
        best = open_.groupBy("cluster_no", "turn").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "prior_no", "overlap", "good")).alias("b")).select("cluster_no", "turn", "b.*")
        first = open_.filter("good").groupBy("prior_no").agg(F.min("turn").alias("first"))
        sure = F.col("first").isNull() | (F.col("first") >= F.col("turn"))
        settled = materialize(best.join(first, "prior_no", "left").filter(sure).select("cluster_no", "prior_no", "overlap", "good"), "settled")
        now = settled.filter("good").select("cluster_no", "prior_no", "overlap")
        taken = materialize(taken.unionByName(now), "taken")
        rest = open_.join(settled.select("cluster_no"), "cluster_no", "left_anti").join(now.select("prior_no"), "prior_no", "left_anti")
        after = materialize(rest, "open")
        discard(open_)
        open_ = after
    return taken


def material_change_flags(matched: DataFrame) -> DataFrame:
    """Adds what changed between current (urls, sources, headline, published_at, content_hash) and p_ columns.

    With both hashes a change is material if they differ or coverage changed; without, also by headline
    or by newer coverage with new urls.
    """

    def names(c: str) -> Column:
        return F.array_distinct(F.filter(F.transform(c, lambda s: F.lower(F.trim(s))), lambda s: s != ""))

    out = matched.withColumns(
        {
            "urls_added": F.array_except("urls", "p_urls"),
            "urls_removed": F.array_except("p_urls", "urls"),
            "sources_added": F.array_except(names("sources"), names("p_sources")),
            "sources_removed": F.array_except(names("p_sources"), names("sources")),
            "headline_changed": headline_unicode(F.col("headline")) != headline_unicode(F.col("p_headline")),
            "hash_changed": F.coalesce(F.col("content_hash") != F.col("p_content_hash"), F.lit(False)),
            "newer_coverage": F.coalesce(F.col("published_at") > F.col("p_published_at"), F.lit(False)),
        }
    )
    coverage = (F.size("urls_added") > 0) | (F.size("sources_added") > 0) | (F.size("sources_removed") > 0)
    hashes = F.col("content_hash").isNotNull() & F.col("p_content_hash").isNotNull()
    loose = F.col("hash_changed") | F.col("headline_changed") | coverage | (F.col("newer_coverage") & (F.size("urls_added") > 0))
    return out.withColumn("material", F.when(hashes, F.col("hash_changed") | coverage).otherwise(loose))


def change_summary() -> Column:
    """What changed, as sentences; of a material change."""
    n = F.size("urls_added")
    parts = F.array_compact(
        F.array(
            F.when(F.col("headline_changed"), F.concat(F.lit('Headline evolved: "'), "p_headline", F.lit('" → "'), "headline", F.lit('"'))),
            F.when(F.size("sources_added") > 0, F.concat(F.lit("New source coverage: "), F.array_join("sources_added", ", "))),
            F.when(F.size("sources_removed") > 0, F.concat(F.lit("No longer covered by: "), F.array_join("sources_removed", ", "))),
            F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " new article added").otherwise(" new articles added"))),
            F.when(F.col("newer_coverage") & ~F.col("headline_changed") & (n == 0), "Newer reporting timestamps since last briefing"),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ". ")).when(F.col("hash_changed"), "Story content changed since last briefing").otherwise("Story updated since last briefing")


def classify_changes(current: DataFrame, prior: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """new, updated or ongoing for each current story, with inherited id and dates.

    prior has cluster_no, urls, sources, headline, published_at, content_hash, stable_id, first_seen, last_updated.
    """
    p = prior.select(F.col("cluster_no").alias("prior_no"), *[F.col(c).alias(f"p_{c}") for c in ("urls", "sources", "headline", "published_at", "content_hash", "stable_id", "first_seen", "last_updated")])
    flagged = material_change_flags(current.join(matches.select("cluster_no", "prior_no"), "cluster_no", "left").join(p, "prior_no", "left"))
    known = F.col("prior_no").isNotNull()
    material = ~known | F.col("material")
    return flagged.select(
        "topic", "cluster_no", "headline",
        F.when(~known, "new").when(F.col("material"), "updated").otherwise("ongoing").alias("status"),
        F.coalesce("p_stable_id", "stable_id").alias("stable_id"),
        F.coalesce("p_first_seen", now).alias("first_seen"),
        F.when(material, now).otherwise(F.col("p_last_updated")).alias("last_updated"),
        material.alias("material"),
        F.when(~known, "First seen in this briefing").when(F.col("material"), change_summary()).alias("change_summary"),
        "prior_no",
    )


def whats_new(cards: DataFrame, compared: DataFrame, now: Column) -> DataFrame:
    """Per topic: a label by the age of the compared snapshot, counts by status, new and updated headlines in order.

    cards: topic, rank, headline, status; compared: topic, generated_at.
    """
    by = cards.groupBy("topic").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "updated", "ongoing")],
        F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != "ongoing", F.struct("rank", "headline")))), lambda x: x.headline).alias("highlights"),
    )
    h = (F.unix_micros(now) - F.unix_micros("generated_at")) / 3.6e9
    rounded = F.floor(h + 0.5).cast("int").cast("string")
    label = (
        F.when(F.col("generated_at").isNull(), "What's new (first briefing for this topic)")
        .when((h >= 18) & (h < 40), "What's new since yesterday")
        .when(h >= 40, F.concat(F.lit("What's new since "), F.greatest(F.lit(2), F.floor(h / 24 + 0.5)).cast("int").cast("string"), F.lit(" days ago")))
        .when(h >= 1, F.concat(F.lit("What's new since your last briefing ("), rounded, F.lit("h ago)")))
        .otherwise("What's new since your last briefing")
    )
    return by.join(compared, "topic", "left").select("topic", label.alias("label"), "n_new", "n_updated", "n_ongoing", "highlights")


def snapshot_from_changes(changes: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that the next comparison takes as prior."""
    c = changes.select("cluster_no", "headline", F.col("stable_id").alias("sid"), "first_seen", "last_updated")
    return state.drop("headline").join(c, "cluster_no").drop("stable_id").withColumnRenamed("sid", "stable_id")


def plan_result_reuse(changes: DataFrame, cache: DataFrame, provider: str, now: Column, force: bool = False) -> DataFrame:
    """decision for each story: reuse_prior, cache_hit, compute, or duplicate_in_batch.

    changes: cluster_no, content_hash, prior_no, material, rank; cache: provider, content_hash, expires_at.
    ``force`` skips the cache only. Of stories with one hash to compute the first by rank computes.
    """
    live = cache.filter((F.col("provider") == provider) & (F.col("expires_at") > now)).select("content_hash").distinct().withColumn("cached", F.lit(not force))
    rows = changes.join(live, "content_hash", "left")
    first = F.when(F.col("prior_no").isNotNull() & ~F.col("material"), "reuse_prior").when(F.coalesce("cached", F.lit(False)), "cache_hit").otherwise("compute")
    rows = rows.withColumn("decision", first)
    nth = F.row_number().over(Window.partitionBy("content_hash", "decision").orderBy("rank", "cluster_no"))
    return rows.withColumn("decision", F.when((F.col("decision") == "compute") & (nth > 1), "duplicate_in_batch").otherwise(F.col("decision"))).select("cluster_no", "content_hash", "decision")

