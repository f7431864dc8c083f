"""Daily briefings, personalised feeds and delivery plans, for all topics and clients at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.config import Config
from storyspark.functions.text import clamp01, normalize_topic, round_k
from storyspark.operators.articles import relevance
from storyspark.operators.components import connected_components
from storyspark.operators.stories import freshness
from storyspark.plans.cutting import materialize


def summary_inputs(members: DataFrame, representatives: DataFrame, max_articles: int = 6) -> DataFrame:
    """Per cluster its articles, representative first, then newest first; ``max_articles`` of them, fields cut."""
    rows = members.join(representatives.select("cluster_no", "representative"), "cluster_no")
    order = F.struct((F.col("ordinal") != F.col("representative")).alias("r"), (-F.coalesce(F.unix_micros("published_at"), F.lit(0))).alias("t"), "ordinal", F.substring("source_name", 1, 120).alias("source"), F.substring("title", 1, 400).alias("title"), F.substring(F.coalesce("snippet", F.lit("")), 1, 2000).alias("description"), "url")
    listed = F.slice(F.array_sort(F.collect_list(order)), 1, max_articles)
    return rows.groupBy("topic", "cluster_no").agg(F.transform(listed, lambda a: F.struct(a.source.alias("source"), a.title.alias("title"), a.description.alias("description"), a.url.alias("url"))).alias("articles"))


def extractive_summary(inputs: DataFrame) -> DataFrame:
    """The first two descriptions that aren't blank, joined; else the sources. 1,200 characters at most, low confidence."""
    said = F.slice(F.filter(F.transform("articles", lambda a: F.trim(a.description)), lambda d: d != ""), 1, 2)
    names = F.array_distinct(F.transform("articles", lambda a: a.source))
    text = F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise(F.concat(F.lit("Reporting from "), F.array_join(names, ", "), F.lit(".")))
    return inputs.select("topic", "cluster_no", F.substring(text, 1, 1200).alias("summary"), F.lit("low").alias("confidence"), F.size("articles").alias("n_articles"))


def story_cards(stories: DataFrame, summaries: DataFrame, changes: DataFrame) -> DataFrame:
    """The final wide row: headline, summary, sources as "A · B", urls with the primary first, scores, change."""
    urls = F.concat(F.array("rep_url"), F.array_except(F.transform("articles", lambda a: a.url), F.array("rep_url")))
    out = stories.join(summaries.select("cluster_no", "summary", "confidence"), "cluster_no").join(changes.select("cluster_no", "status", "stable_id"), "cluster_no", "left")
    return out.select("topic", "rank", "cluster_no", "cluster_id", "headline", "summary", "confidence", F.array_join("sources", " · ").alias("covered_by"), urls.alias("urls"), "importance", "freshness", "diversity", "relevance", "status", "stable_id", F.col("rep_source").alias("primary_source"))


def subscribed_topics(user_topics: DataFrame, frequencies: list[str]) -> DataFrame:
    """Distinct normalised topics over clients, with the label of the most frequent subscription, ties first seen."""
    order = F.when(F.col("frequency") == "twice_daily", 0).when(F.col("frequency") == "daily", 1).otherwise(2)
    rows = user_topics.filter(F.col("frequency").isin(frequencies))
    return rows.groupBy(normalize_topic(F.col("topic")).alias("topic_key")).agg(F.min_by("topic", F.struct(order.alias("f"), F.col("created_at").alias("c"), F.col("client").alias("i"))).alias("label"), F.count_distinct("client").alias("clients"))


def pending_topics(topics: DataFrame, stored: DataFrame, date: Column, force: bool = False) -> DataFrame:
    """topic_key, status for a date: created where nothing is stored (or ``force``), else skipped_existing."""
    have = stored.filter(F.col("date") == date).select("topic_key").distinct().withColumn("have", F.lit(True))
    out = topics.join(have, "topic_key", "left")
    return out.select("topic_key", F.when(F.col("have").isNull() | F.lit(force), "created").otherwise("skipped_existing").alias("status"))


def job_summary(results: DataFrame) -> DataFrame:
    """Per run: processed, created, skipped, failed."""
    return results.groupBy("run_id").agg(F.count("*").alias("processed"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("created", "created"), ("skipped_existing", "skipped"), ("failed", "failed"))])


def topic_weights(user_topics: DataFrame) -> DataFrame:
    """Adds priority, 1 down to 0.3 over a client's topics, and the boost of the frequency."""
    n = F.count("*").over(Window.partitionBy("client"))
    priority = F.when(n <= 1, 1.0).otherwise(round_k(F.lit(1.0) - F.col("sort_order") / F.greatest(n - 1, F.lit(1)) * 0.7))
    boost = F.when(F.col("frequency") == "twice_daily", 1.0).when(F.col("frequency") == "daily", 0.9).otherwise(0.7)
    return user_topics.withColumns({"priority": priority, "boost": boost})


def score_feed(user_topics: DataFrame, cards: DataFrame, now: Column, cfg: Config = Config()) -> DataFrame:
    """Each client's topics with their stories, scored.

    cards: topic_key, cluster_no, headline, summary, importance, published_at, diversity. The join
    is on the topic; stories are broadcast only if Spark finds them small. urls go with them if cards has them.
    """
    rows = topic_weights(user_topics).withColumn("topic_key", normalize_topic(F.col("topic"))).join(cards, "topic_key")
    fit = clamp01(F.greatest(relevance(F.col("topic"), F.col("headline"), F.col("summary")), F.col("importance")))
    total = fit * 0.28 + freshness(F.col("published_at"), now, cfg) * 0.22 + clamp01(F.col("importance")) * 0.22 + clamp01(F.col("diversity")) * 0.1 + F.col("priority") * 0.12 * F.col("boost") + F.col("boost") * 0.06
    return rows.select("client", "topic_key", "cluster_no", "headline", *[c for c in ("urls",) if c in cards.columns], "importance", "priority", round_k(clamp01(total)).alias("score"))


FEED = ["client", "topic_key", "cluster_no", "score", "priority", "importance"]


def _merged_feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept stories, from a feed's stories in the order of group, topic and story; held are the kept ones of one group."""
    group, kept, holders, schema = None, [], {}, None

    def matches(row: dict, other: dict, shared: int) -> bool:
        return shared / len(row["urls"] | other["urls"]) >= 0.25 or row["headline"] == other["headline"]

    for b in batches:
        out = []
        schema = pa.schema([b.schema.field(c) for c in FEED] + [("also", pa.list_(b.schema.field("topic_key").type))])  # keys of any type
        for row in b.to_pylist():
            if row["node"] != group:
                out += kept
                group, kept, holders = row["node"], [], {}
            row |= {"urls": set(row["urls"]), "also": []}
            shared = Counter(k for u in row["urls"] for k in holders.get(u, ()))
            at = min((k for k, n in shared.items() if matches(row, kept[k], n)), default=None)
            if at is not None and not row["score"] > kept[at]["score"]:
                kept[at]["also"].append(row["topic_key"])
                continue
            if at is None:
                at = len(kept)
                kept.append(row)
            else:
                row["also"] = [*kept[at]["also"], kept[at]["topic_key"]]
                for u in kept[at]["urls"]:
                    holders[u].discard(at)
                kept[at] = row
            for u in row["urls"]:
                holders.setdefault(u, set()).add(at)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=schema)


def dedupe_feed(scored: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """Per client, stories with a url overlap merge, greedily in topic order; the higher score wins, the loser's topic is noted.

    Only stories that a chain of common urls connects can merge, so components of a client's stories are
    walked in sorted order; a task holds the stories kept so far of one component. All others pass as they are.

    stories: topic_key, cluster_no, urls, one row for a story, where these are the same for all clients; scored needs no urls
    then. Each story's urls are looked through once, and only those of several stories meet the clients.
    """
    node = F.struct("client", "topic_key", "cluster_no")
    if stories is None:
        urls = scored.select(node.alias("node"), "client", F.explode("urls").alias("u")).distinct()
    else:
        listed = stories.select("topic_key", "cluster_no", F.explode("urls").alias("u")).distinct()
        common = materialize(listed.join(listed.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").drop("n").hint("merge"), "u"), "common_urls")
        urls = scored.join(common, ["topic_key", "cluster_no"]).select(node.alias("node"), "client", "u")
    least = urls.groupBy("client", "u").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    edges = urls.join(least, ["client", "u"]).select("node", "least")
    comp = materialize(connected_components(edges, "node", "least").select("node.*", F.col("component").alias("node")), "feed_groups")
    keys = ["client", "topic_key", "cluster_no"]
    met = scored.join(comp, keys)
    if stories is not None:
        met = met.drop("urls").join(stories.select("topic_key", "cluster_no", "urls"), ["topic_key", "cluster_no"])
    met = met.select("node", *keys, "headline", "urls", "score", "priority", "importance")
    merged = met.repartition("node").sortWithinPartitions("node", "topic_key", "cluster_no").mapInArrow(_merged_feed, T.StructType([met.schema[c] for c in FEED] + [T.StructField("also", T.ArrayType(met.schema["topic_key"].dataType))]))
    plain = scored.join(comp, keys, "left_anti").select(*FEED, F.array().cast(T.ArrayType(met.schema["topic_key"].dataType)).alias("also"))
    return plain.unionByName(merged)


def rank_feed(feed: DataFrame, n: int = 30) -> DataFrame:
    w = Window.partitionBy("client").orderBy(F.desc("score"), F.desc("priority"), F.desc("importance"), "topic_key", "cluster_no")
    return feed.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def due_subscriptions(subs: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """Active subscriptions with their local date and time, and whether that is at or past delivery time.

    zones lists the valid zone names; any other zone counts as UTC.
    """
    rows = subs.filter("active").join(F.broadcast(zones.select("zone").withColumn("known", F.lit(True))), "zone", "left")
    local = F.from_utc_timestamp(now, F.when(F.col("known"), F.col("zone")).otherwise("UTC"))
    minute = F.hour(local) * 60 + F.minute(local)
    return rows.select("subscription_id", "client", "zone", local.cast("date").alias("local_date"), F.hour(local).alias("local_hour"), (minute >= F.col("delivery_hour") * 60 + F.col("delivery_minute")).alias("due"))


def subscription_topics(subs: DataFrame, own: DataFrame, user_topics: DataFrame) -> DataFrame:
    """A subscription's own topics, else all topics of its client; distinct by normalised topic."""
    mine = own.select("subscription_id", normalize_topic(F.col("topic")).alias("topic_key"))
    rest = subs.join(own.select("subscription_id").distinct(), "subscription_id", "left_anti").join(user_topics.select("client", normalize_topic(F.col("topic")).alias("topic_key")), "client").select("subscription_id", "topic_key")
    return mine.unionByName(rest).distinct()


def plan_deliveries(due: DataFrame, topics: DataFrame, briefings: DataFrame, log: DataFrame, cfg: Config = Config(), force: bool = False) -> DataFrame:
    """subscription_id, topic_key, status: not_due (topic ``*``), no_briefing, skipped_duplicate, failed, or send.

    briefings: topic_key, date; log: subscription_id, topic_key, date, status, attempts. ``force`` overrides
    the log.
    """
    late = due.filter(~F.col("due")).select("subscription_id", F.lit("*").alias("topic_key"), F.lit("not_due").alias("status"))
    rows = due.filter("due").join(topics, "subscription_id").join(briefings.select("topic_key", F.col("date").alias("local_date")).distinct().withColumn("have", F.lit(True)), ["topic_key", "local_date"], "left")
    rows = rows.join(log.select("subscription_id", "topic_key", F.col("date").alias("local_date"), F.col("status").alias("was"), "attempts"), ["subscription_id", "topic_key", "local_date"], "left")
    status = F.when(F.col("have").isNull(), "no_briefing").when(F.lit(force), "send").when(F.col("was") == "sent", "skipped_duplicate").when(F.coalesce("attempts", F.lit(0)) >= cfg.send_attempts, "failed").otherwise("send")
    return late.unionByName(rows.select("subscription_id", "topic_key", status.alias("status")))


def apply_delivery_results(log: DataFrame, results: DataFrame) -> DataFrame:
    """The log with one attempt each folded in: status, attempts + 1, time; one row for (subscription, topic, date)."""
    keys = ["subscription_id", "topic_key", "date"]
    r = results.groupBy(*keys).agg(F.max_by("status", "at").alias("r_status"), F.count("*").alias("tries"), F.max("at").alias("r_at"))
    both = log.join(r, keys, "full")
    return both.select(*keys, F.coalesce("r_status", "status").alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("tries", F.lit(0))).alias("attempts"), F.coalesce("r_at", "at").alias("at"))
