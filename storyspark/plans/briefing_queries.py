"""Registered queries of change tracking, summaries, feeds and deliveries, with their check SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.operators import articles as ar
from storyspark.operators import briefings as br
from storyspark.operators import changes as ch
from storyspark.operators import stories as st
from storyspark.plans import sql_parts as sq
from storyspark.plans import story_queries as sy
from storyspark.plans.cutting import materialize

ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Tokyo"]


def _members(s, d, before=None):
    rows = sy.normalized(s, d)
    if before:
        ids = ad.table(s, d, "events").filter(F.col("ts") < F.lit(before).cast("timestamp_ntz")).select(F.col("event_id").alias("ordinal"))
        rows = rows.join(ids, "ordinal", "left_semi")
    return materialize(st.cluster_articles(materialize(ar.dedupe_best_by_url(rows), "deduped"), sy.THRESHOLD), "members")


def _state(members):
    reps = st.pick_representative(members).select("cluster_no", F.col("rep_title").alias("headline"))
    return materialize(ch.story_state(members).join(reps, "cluster_no"), "state")


def state_of(s, d, known, topics=None):
    """Story states of the articles that meet a condition, of some topics only if these are given."""
    rows = ar.dedupe_best_by_url(sy.normalized(s, d).filter(known))
    rows = materialize(rows if topics is None else rows.filter(F.col("topic").isin(topics)), "deduped")
    return _state(materialize(st.cluster_articles(rows, sy.THRESHOLD), "members"))


def both_states(s, d):
    now = _state(_members(s, d))
    prior = _state(_members(s, d, ad.SNAPSHOT_NOW)).withColumns({"first_seen": ad.now(ad.SNAPSHOT_NOW), "last_updated": ad.now(ad.SNAPSHOT_NOW)})
    return now.withColumn("rank", F.col("cluster_no")), prior


def _pairs(s, d):
    return ch.prior_pairs(*both_states(s, d))


def q_prior_pairs(s, d):
    return _pairs(s, d).select("topic", "cluster_no", "prior_no", "shared", ch_round("overlap"), ch_round("of_smaller"))


def ch_round(c):
    return st.round_k(F.col(c), 6).alias(c)


def q_match_prior_stories(s, d):
    return ch.match_prior_stories(*both_states(s, d)).select("cluster_no", "prior_no", ch_round("overlap"))


def _flags(now, prior):
    pairs = ch.prior_pairs(now, prior).filter("overlap >= 0.25").select("cluster_no", "prior_no")
    p = prior.select(F.col("cluster_no").alias("prior_no"), *[F.col(c).alias(f"p_{c}") for c in ("urls", "sources", "headline", "published_at", "content_hash")])
    return ch.material_change_flags(now.join(pairs, "cluster_no").join(p, "prior_no"))


def q_material_change_flags(s, d):
    return _flags(*both_states(s, d)).select("cluster_no", "prior_no", *[F.size(c).alias(c) for c in ("urls_added", "urls_removed", "sources_added", "sources_removed")], "headline_changed", "hash_changed", "newer_coverage", "material", ch.change_summary().alias("summary"))


def classified(s, d):
    now, prior = both_states(s, d)
    return ch.classify_changes(now, prior, ch.match_prior_stories(now, prior), ad.now()), now


def q_classify_changes(s, d):
    return classified(s, d)[0]


def q_whats_new(s, d):
    cards = classified(s, d)[0].withColumn("rank", F.col("cluster_no"))
    compared = cards.select("topic").distinct().withColumn("generated_at", ad.now(ad.SNAPSHOT_NOW))
    return ch.whats_new(cards, compared, ad.now()).withColumn("highlights", F.size("highlights"))


def q_snapshot_from_cards(s, d):
    c, now = classified(s, d)
    return ch.snapshot_from_changes(c, now).select("topic", "cluster_no", "stable_id", "headline", "first_seen", "last_updated", F.size("urls").alias("n_urls"))


def q_plan_result_reuse(s, d):
    now, prior = both_states(s, d)
    f = _flags(now, prior)
    rows = f.select("cluster_no", "content_hash", "prior_no", "material").withColumn("rank", F.col("cluster_no"))
    cache = prior.filter("cluster_no % 3 = 0").select((F.concat(F.lit("p"), (F.col("cluster_no") % 2).cast("string"))).alias("provider"), "content_hash", F.when(F.col("cluster_no") % 6 == 0, ad.now("2024-02-01")).otherwise(ad.now("2024-01-25")).alias("expires_at"))
    return ch.plan_result_reuse(rows, cache, "p0", ad.now())


def q_content_hash(s, d):
    return _state(_members(s, d)).select("cluster_no", "content_hash", "stable_id")


def _inputs(s, d):
    m = _members(s, d)
    return br.summary_inputs(m, st.pick_representative(m))


def q_summary_inputs(s, d):
    return _inputs(s, d).select("cluster_no", F.size("articles").alias("n"), F.array_join(F.transform("articles", lambda a: a.url), " ").alias("urls"), F.md5(F.array_join(F.transform("articles", lambda a: F.concat_ws("|", a.source, a.title, a.description)), "\n")).alias("digest"))


def user_topics(s, d):
    e = ad.table(s, d, "events").groupBy(F.col("user_id").alias("client"), "event_type").agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
    topic = F.when(F.col("event_type") == "click", "en").when(F.col("event_type") == "view", "fr").when(F.col("event_type") == "purchase", "de").when(F.col("event_type") == "signup", "es").otherwise(" It  news")
    order = F.row_number().over(Window.partitionBy("client").orderBy("created_at", "event_type")) - 1
    freq = F.when(F.col("client") % 3 == 0, "daily").when(F.col("client") % 3 == 1, "twice_daily").otherwise("weekly")
    return e.select("client", topic.alias("topic"), "created_at", order.alias("sort_order"), freq.alias("frequency"))


def cards(s, d):
    out = materialize(st.process_articles(sy.normalized(s, d), sy.phrase(), ad.now()), "cards")
    return out.select(F.col("topic").alias("topic_key"), "cluster_no", "headline", F.lit("").alias("summary"), "importance", F.col("latest_published_at").alias("published_at"), "diversity", F.transform("articles", lambda a: a.url).alias("urls"))


def q_score_feed(s, d):
    return br.score_feed(user_topics(s, d), cards(s, d), ad.now()).drop("urls", "headline")


def q_rank_feed(s, d):
    return br.rank_feed(br.score_feed(user_topics(s, d), cards(s, d), ad.now())).select("client", "position", "topic_key", "cluster_no", "score")


def q_dedupe_feed(s, d):
    stories = cards(s, d)
    return br.dedupe_feed(br.score_feed(user_topics(s, d), stories.drop("urls"), ad.now()), stories).select("client", "topic_key", "cluster_no", "score", F.array_join("also", ",").alias("also"))


def q_pending_topics(s, d):
    topics = br.subscribed_topics(user_topics(s, d), ["daily", "twice_daily", "weekly"]).select("topic_key")
    stored = topics.filter(F.col("topic_key").isin("en", "de")).withColumn("date", F.lit("2024-01-31").cast("date"))
    return br.pending_topics(topics, stored, F.lit("2024-01-31").cast("date"))


def q_job_summary(s, d):
    e = ad.table(s, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped_existing").otherwise("created")
    return br.job_summary(e.select(F.col("ts").cast("date").cast("string").alias("run_id"), status.alias("status")))


def subs(s, d):
    zone = F.when(F.col("c_nationkey") % 5 == 4, "Not/AZone")
    for i, z in enumerate(ZONES):
        zone = zone.when(F.col("c_nationkey") % 5 == i, z)
    return ad.table(s, d, "customer").select(F.col("c_custkey").alias("subscription_id"), F.col("c_custkey").alias("client"), zone.alias("zone"), (F.col("c_custkey") % 24).alias("delivery_hour"), F.lit(0).alias("delivery_minute"), (F.col("c_custkey") % 10 != 0).alias("active"))


def due(s, d):
    return br.due_subscriptions(subs(s, d), s.createDataFrame([(z,) for z in ZONES], "zone string"), ad.now())


def own_topics(s, d):
    return ad.table(s, d, "orders").select(F.col("o_custkey").alias("subscription_id"), F.col("o_orderpriority").alias("topic"))


def all_topics(s, d):
    return br.subscription_topics(subs(s, d), own_topics(s, d), user_topics(s, d))


def _latest_orders(s, d):
    o = ad.table(s, d, "orders")
    by = o.groupBy(F.col("o_custkey").alias("subscription_id"), F.lower("o_orderpriority").alias("topic_key")).agg(F.max_by(F.struct("o_orderstatus", "o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    status = F.when(F.col("o.o_orderstatus") == "F", "sent").when(F.col("o.o_orderstatus") == "P", "failed").otherwise("pending")
    return by.select("subscription_id", "topic_key", status.alias("status"), (F.col("o.o_orderkey") % 5).cast("int").alias("attempts"))


def q_plan_deliveries(s, d):
    dd = due(s, d)
    log = _latest_orders(s, d).join(dd.select("subscription_id", F.col("local_date").alias("date")), "subscription_id")
    topics = materialize(all_topics(s, d), "topics")
    briefings = topics.filter(F.col("topic_key") != "5-low").select("topic_key").distinct().join(dd.select(F.col("local_date").alias("date")).distinct())
    return br.plan_deliveries(dd, topics, briefings, log)


def q_apply_delivery_results(s, d):
    date = F.lit("2024-01-31")
    log = _latest_orders(s, d).withColumns({"date": date, "at": ad.now()})
    o = ad.table(s, d, "orders").filter("o_orderkey % 7 = 0 or o_totalprice > 100000")
    results = o.select(F.col("o_custkey").alias("subscription_id"), F.lower("o_orderpriority").alias("topic_key"), date.alias("date"), F.when(F.col("o_orderstatus") == "F", "sent").otherwise("failed").alias("status"), F.timestamp_seconds(F.col("o_orderkey")).alias("at"))
    return br.apply_delivery_results(log, results)


_P = re.sub(r"\b(art|norm|dedup|feat|scored|pairs|edges|reach|comp|members)\b", r"\1_p", sq.CLUSTERED).replace("ON d.doc_id = e.event_id", f"ON d.doc_id = e.event_id WHERE e.ts < TIMESTAMP '{ad.SNAPSHOT_NOW}'")


def _st(m, name):
    rep = f"first(title ORDER BY {sq.tier_score('source_tier')} DESC, coalesce(epoch_us(published_at), 0) DESC, length(coalesce(snippet, '')) DESC, ordinal)"
    return f"""{name} AS (SELECT topic, cluster_no, list_sort(list_distinct(list(canonical_url))) AS urls, list_sort(list_distinct(list(source_name))) AS sources, max(published_at) AS published_at, {rep} AS headline,
  left(sha256(array_to_string(list_sort(list_distinct(list(canonical_url))), '|')), 16) AS stable_id,
  left(sha256(topic || chr(30) || string_agg(canonical_url || chr(31) || title || chr(31) || coalesce(snippet, ''), chr(30) ORDER BY canonical_url || chr(31) || title || chr(31) || coalesce(snippet, ''))), 24) AS content_hash FROM {m} GROUP BY topic, cluster_no)"""


_PAIRS = f"""{sq.CLUSTERED}, {_P.strip()}, {_st('members', 'cur')}, {_st('members_p', 'prv')},
pp AS (SELECT c.topic, c.cluster_no, p.cluster_no AS prior_no, len(list_intersect(c.urls, p.urls)) AS shared, len(list_intersect(c.urls, p.urls)) / (len(c.urls) + len(p.urls) - len(list_intersect(c.urls, p.urls))) AS overlap, len(list_intersect(c.urls, p.urls)) / least(len(c.urls), len(p.urls)) AS of_smaller
  FROM cur c JOIN prv p ON c.topic = p.topic AND list_has_any(c.urls, p.urls))"""
_HU = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_FLAGS = f"""{_PAIRS}, fl AS (SELECT c.cluster_no, p.cluster_no AS prior_no, c.content_hash, list_filter(c.urls, lambda u: NOT list_contains(p.urls, u)) AS ua, list_filter(p.urls, lambda u: NOT list_contains(c.urls, u)) AS ur,
  list_filter(c.sources, lambda u: NOT list_contains(p.sources, u)) AS sa, list_filter(p.sources, lambda u: NOT list_contains(c.sources, u)) AS sr, {_HU.format('c.headline')} <> {_HU.format('p.headline')} AS headline_changed,
  c.content_hash <> p.content_hash AS hash_changed, coalesce(c.published_at > p.published_at, false) AS newer_coverage, c.headline AS ch, p.headline AS ph FROM pp JOIN cur c ON pp.cluster_no = c.cluster_no JOIN prv p ON pp.prior_no = p.cluster_no WHERE overlap >= 0.25),
fm AS (SELECT *, hash_changed OR len(ua) > 0 OR len(sa) > 0 OR len(sr) > 0 AS material, list_filter([CASE WHEN headline_changed THEN 'Headline evolved: "' || ph || '" → "' || ch || '"' END, CASE WHEN len(sa) > 0 THEN 'New source coverage: ' || array_to_string(sa, ', ') END, CASE WHEN len(sr) > 0 THEN 'No longer covered by: ' || array_to_string(sr, ', ') END,
  CASE WHEN len(ua) > 0 THEN len(ua) || CASE WHEN len(ua) = 1 THEN ' new article added' ELSE ' new articles added' END END, CASE WHEN newer_coverage AND NOT headline_changed AND len(ua) = 0 THEN 'Newer reporting timestamps since last briefing' END], lambda x: x IS NOT NULL) AS parts FROM fl)"""
#: Each topic's stories take their prior ones in turn: a fold over the topic with the prior ones that are taken.
_MATCHED = f"""{_PAIRS}, cand AS (
  SELECT topic, cluster_no, list({{'p': prior_no, 'o': overlap, 'g': overlap >= 0.25 OR of_smaller >= 0.5}} ORDER BY overlap DESC, prior_no) AS cs, row_number() OVER (PARTITION BY topic ORDER BY cluster_no) AS k FROM pp GROUP BY topic, cluster_no
), mw(topic, k, cluster_no, used, pick) AS (
  SELECT DISTINCT topic, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(p BIGINT, o DOUBLE, g BOOLEAN)) FROM cand
  UNION ALL
  SELECT topic, k, cluster_no, CASE WHEN pick.g THEN list_append(used, pick.p) ELSE used END, pick
  FROM (SELECT c.topic, c.k, c.cluster_no, mw.used, list_filter(c.cs, lambda x: NOT list_contains(mw.used, x.p))[1] AS pick FROM mw JOIN cand c ON c.topic = mw.topic AND c.k = mw.k + 1)
), mt AS (SELECT cluster_no, pick.p AS prior_no, pick.o AS overlap FROM mw WHERE pick.g)"""
CLASSIFIED = (
    _FLAGS.replace(_PAIRS, _MATCHED).replace("FROM pp JOIN cur c ON pp.cluster_no = c.cluster_no JOIN prv p ON pp.prior_no = p.cluster_no WHERE overlap >= 0.25", "FROM mt JOIN cur c ON mt.cluster_no = c.cluster_no JOIN prv p ON mt.prior_no = p.cluster_no")
    + f""", cl AS (
  SELECT c.topic, c.cluster_no, c.headline, CASE WHEN fm.prior_no IS NULL THEN 'new' WHEN material THEN 'updated' ELSE 'ongoing' END AS status, coalesce(p.stable_id, c.stable_id) AS stable_id,
    CASE WHEN fm.prior_no IS NULL THEN {sq.NOW_TS} ELSE TIMESTAMP '{ad.SNAPSHOT_NOW}' END AS first_seen, CASE WHEN fm.prior_no IS NULL OR material THEN {sq.NOW_TS} ELSE TIMESTAMP '{ad.SNAPSHOT_NOW}' END AS last_updated,
    fm.prior_no IS NULL OR material AS material, CASE WHEN fm.prior_no IS NULL THEN 'First seen in this briefing' WHEN material THEN CASE WHEN len(parts) > 0 THEN array_to_string(parts, '. ') WHEN hash_changed THEN 'Story content changed since last briefing' ELSE 'Story updated since last briefing' END END AS change_summary,
    fm.prior_no, len(c.urls) AS n_urls
  FROM cur c LEFT JOIN fm ON fm.cluster_no = c.cluster_no LEFT JOIN prv p ON p.cluster_no = fm.prior_no)"""
)
_INPUTS = f"""{sq.SCORED}, si AS (SELECT m.topic, m.cluster_no, list({{'source': left(source_name, 120), 'title': left(title, 400), 'description': left(coalesce(snippet, ''), 2000), 'url': url}} ORDER BY ordinal <> representative, coalesce(epoch_us(published_at), 0) DESC, ordinal)[1:6] AS articles FROM members m JOIN reps USING (cluster_no) GROUP BY ALL)"""
_UT = """ut AS (SELECT user_id AS client, CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'fr' WHEN 'purchase' THEN 'de' WHEN 'signup' THEN 'es' ELSE ' It  news' END AS topic, min(ts) AS created_at,
  row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) - 1 AS sort_order, CASE user_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'twice_daily' ELSE 'weekly' END AS frequency FROM events GROUP BY user_id, event_type)"""
_KEY = sq.squeeze("lower(topic)")
_WEIGHTS = f"""{_UT}, wt AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY client) <= 1 THEN 1.0::DOUBLE ELSE {sq.rnd('1.0::DOUBLE - sort_order / greatest(count(*) OVER (PARTITION BY client) - 1, 1) * 0.7::DOUBLE')} END AS priority, CASE frequency WHEN 'twice_daily' THEN 1.0::DOUBLE WHEN 'daily' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS boost FROM ut)"""
_TT = "list_filter(regexp_split_to_array(topic_key, '[^a-z0-9]+'), lambda t: length(t) > 2)"
_FEED = f"""{sq.STORIES}, {_WEIGHTS}, fd AS (
  SELECT client, topic_key, cluster_no, importance, priority, {sq.rnd("least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(rel, importance) * 0.28::DOUBLE + fresh * 0.22::DOUBLE + importance * 0.22::DOUBLE + diversity * 0.1::DOUBLE + priority * 0.12::DOUBLE * boost + boost * 0.06::DOUBLE))")} AS score FROM (
    SELECT w.client, w.topic_key, c.cluster_no, c.importance, c.diversity, w.priority, w.boost, {sq.FRESHNESS.replace('latest', 'c.latest_published_at')} AS fresh,
      CASE WHEN len({_TT}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({_TT}, lambda t: contains(lower(c.headline || ' '), t))) / len({_TT}) END AS rel
    FROM (SELECT *, {_KEY} AS topic_key FROM wt) w JOIN (SELECT * FROM stories WHERE rank <= 15) c ON w.topic_key = c.topic))"""
_SUBS = """sb AS (SELECT c_custkey AS subscription_id, c_custkey AS client, CASE c_nationkey % 5 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/Berlin' WHEN 3 THEN 'Asia/Tokyo' ELSE 'Not/AZone' END AS zone, c_custkey % 24 AS delivery_hour,
  TIMESTAMP '2024-01-31 00:00:00' + to_hours(CASE c_nationkey % 5 WHEN 1 THEN -5 WHEN 2 THEN 1 WHEN 3 THEN 9 ELSE 0 END) AS local FROM customer WHERE c_custkey % 10 <> 0),
du AS (SELECT subscription_id, client, zone, CAST(local AS DATE) AS local_date, CAST(hour(local) AS INTEGER) AS local_hour, hour(local) * 60 + minute(local) >= delivery_hour * 60 AS due FROM sb)"""
_TOPICS = f"""tp AS (SELECT DISTINCT o_custkey AS subscription_id, lower(o_orderpriority) AS topic_key FROM orders UNION SELECT c_custkey, {_KEY} FROM customer JOIN ut ON c_custkey = client WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))"""
_LATEST = "lo AS (SELECT o_custkey AS subscription_id, lower(o_orderpriority) AS topic_key, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, CAST(o_orderkey % 5 AS INTEGER) AS attempts FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"

QUERIES = {
    "prior_pairs": (q_prior_pairs, f"WITH RECURSIVE {_PAIRS} SELECT topic, cluster_no, prior_no, shared, {sq.rnd('overlap', 6)} AS overlap, {sq.rnd('of_smaller', 6)} AS of_smaller FROM pp"),
    "match_prior_stories": (q_match_prior_stories, f"WITH RECURSIVE {_MATCHED} SELECT cluster_no, prior_no, {sq.rnd('overlap', 6)} AS overlap FROM mt"),
    "material_change_flags": (
        q_material_change_flags,
        f"WITH RECURSIVE {_FLAGS} SELECT cluster_no, prior_no, CAST(len(ua) AS INTEGER) AS urls_added, CAST(len(ur) AS INTEGER) AS urls_removed, CAST(len(sa) AS INTEGER) AS sources_added, CAST(len(sr) AS INTEGER) AS sources_removed, headline_changed, hash_changed, newer_coverage, material, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '. ') WHEN hash_changed THEN 'Story content changed since last briefing' ELSE 'Story updated since last briefing' END AS summary FROM fm",
    ),
    "classify_changes": (q_classify_changes, f"WITH RECURSIVE {CLASSIFIED} SELECT * EXCLUDE (n_urls) FROM cl"),
    "whats_new": (
        q_whats_new,
        f"WITH RECURSIVE {CLASSIFIED} SELECT topic, 'What''s new since ' || CAST(floor(date_diff('hour', TIMESTAMP '{ad.SNAPSHOT_NOW}', {sq.NOW_TS}) / 24 + 0.5) AS INTEGER) || ' days ago' AS label, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'updated') AS n_updated, count(*) FILTER (status = 'ongoing') AS n_ongoing, CAST(count(*) FILTER (status <> 'ongoing') AS INTEGER) AS highlights FROM cl GROUP BY topic",
    ),
    "snapshot_from_cards": (q_snapshot_from_cards, f"WITH RECURSIVE {CLASSIFIED} SELECT topic, cluster_no, stable_id, headline, first_seen, last_updated, CAST(n_urls AS INTEGER) AS n_urls FROM cl"),
    "plan_result_reuse": (
        q_plan_result_reuse,
        f"""WITH RECURSIVE {_FLAGS}, cache AS (SELECT DISTINCT content_hash FROM prv WHERE cluster_no % 6 = 0), dec AS (SELECT cluster_no, prior_no, content_hash, CASE WHEN NOT material THEN 'reuse_prior' WHEN content_hash IN (SELECT content_hash FROM cache) THEN 'cache_hit' ELSE 'compute' END AS d FROM fm)
SELECT cluster_no, content_hash, CASE WHEN d = 'compute' AND row_number() OVER (PARTITION BY content_hash, d ORDER BY cluster_no) > 1 THEN 'duplicate_in_batch' ELSE d END AS decision FROM dec""",
    ),
    "content_hash": (q_content_hash, f"WITH RECURSIVE {sq.CLUSTERED}, {_st('members', 'cur')} SELECT cluster_no, content_hash, stable_id FROM cur"),
    "summary_inputs": (q_summary_inputs, f"WITH RECURSIVE {_INPUTS} SELECT cluster_no, CAST(len(articles) AS INTEGER) AS n, array_to_string(list_transform(articles, lambda a: a.url), ' ') AS urls, md5(array_to_string(list_transform(articles, lambda a: a.source || '|' || a.title || '|' || a.description), chr(10))) AS digest FROM si"),
    "extractive_summary": (
        lambda s, d: br.extractive_summary(_inputs(s, d)),
        f"""WITH RECURSIVE {_INPUTS}, x AS (SELECT *, list_filter(list_transform(articles, lambda a: trim(a.description)), lambda t: t <> '')[1:2] AS said FROM si)
SELECT topic, cluster_no, left(CASE WHEN len(said) > 0 THEN array_to_string(said, ' ') ELSE 'Reporting from ' || array_to_string(list_distinct(list_transform(articles, lambda a: a.source)), ', ') || '.' END, 1200) AS summary, 'low' AS confidence, CAST(len(articles) AS INTEGER) AS n_articles FROM x""",
    ),
    "subscribed_topics": (
        lambda s, d: br.subscribed_topics(user_topics(s, d), ["daily", "twice_daily"]),
        f"WITH {_UT} SELECT {_KEY} AS topic_key, first(topic ORDER BY CASE frequency WHEN 'twice_daily' THEN 0 WHEN 'daily' THEN 1 ELSE 2 END, created_at, client) AS label, count(DISTINCT client) AS clients FROM ut WHERE frequency IN ('daily', 'twice_daily') GROUP BY 1",
    ),
    "pending_topics": (q_pending_topics, f"WITH {_UT} SELECT DISTINCT {_KEY} AS topic_key, CASE WHEN {_KEY} IN ('en', 'de') THEN 'skipped_existing' ELSE 'created' END AS status FROM ut"),
    "job_summary": (q_job_summary, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS processed, count(*) FILTER (event_type NOT IN ('error', 'view')) AS created, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1"),
    "topic_weights": (lambda s, d: br.topic_weights(user_topics(s, d)).select("client", "topic", "priority", "boost"), f"WITH {_WEIGHTS} SELECT client, topic, priority, boost FROM wt"),
    "score_feed": (q_score_feed, f"WITH RECURSIVE {_FEED} SELECT * FROM fd"),
    "rank_feed": (q_rank_feed, f"WITH RECURSIVE {_FEED} SELECT client, CAST(row_number() OVER (PARTITION BY client ORDER BY score DESC, priority DESC, importance DESC, topic_key, cluster_no) AS INTEGER) AS position, topic_key, cluster_no, score FROM fd QUALIFY position <= 30"),
    "dedupe_feed": (
        q_dedupe_feed,
        f"""WITH RECURSIVE {_FEED}, us AS (SELECT cluster_no, list_distinct(list(url)) AS u FROM members GROUP BY cluster_no), fr AS (
  SELECT client, {{'t': topic_key, 'c': cluster_no, 's': score, 'u': u, 'h': headline}} AS me, row_number() OVER (PARTITION BY client ORDER BY topic_key, cluster_no) AS k FROM fd JOIN us USING (cluster_no) JOIN (SELECT cluster_no, headline FROM stories) USING (cluster_no)
), fw(client, k, kept) AS (
  SELECT client, k, [{{'m': me, 'also': CAST([] AS VARCHAR[])}}] FROM fr WHERE k = 1
  UNION ALL
  SELECT client, k, CASE WHEN f IS NULL THEN list_append(kept, {{'m': me, 'also': CAST([] AS VARCHAR[])}}) ELSE list_transform(kept, lambda x, i: CASE WHEN i <> f THEN x WHEN me.s > x.m.s THEN {{'m': me, 'also': list_append(x.also, x.m.t)}} ELSE {{'m': x.m, 'also': list_append(x.also, me.t)}} END) END
  FROM (SELECT r.client, r.k, r.me, w.kept, list_filter(range(1, len(w.kept) + 1), lambda i: list_has_any(w.kept[i].m.u, r.me.u) AND (w.kept[i].m.h = r.me.h OR len(list_intersect(w.kept[i].m.u, r.me.u)) / len(list_distinct(list_concat(w.kept[i].m.u, r.me.u))) >= 0.25))[1] AS f FROM fw w JOIN fr r ON r.client = w.client AND r.k = w.k + 1)
) SELECT client, x.m.t AS topic_key, x.m.c AS cluster_no, x.m.s AS score, array_to_string(x.also, ',') AS also FROM (SELECT client, unnest(arg_max(kept, k)) AS x FROM fw GROUP BY client)""",
    ),
    "due_subscriptions": (lambda s, d: due(s, d).withColumn("local_date", F.col("local_date").cast("string")), f"WITH {_SUBS} SELECT * REPLACE (CAST(local_date AS VARCHAR) AS local_date) FROM du"),
    "subscription_topics": (all_topics, f"WITH {_UT}, {_TOPICS} SELECT * FROM tp"),
    "plan_deliveries": (
        q_plan_deliveries,
        f"""WITH {_UT}, {_SUBS}, {_TOPICS}, {_LATEST} SELECT subscription_id, '*' AS topic_key, 'not_due' AS status FROM du WHERE NOT due UNION ALL
SELECT d.subscription_id, t.topic_key, CASE WHEN t.topic_key = '5-low' THEN 'no_briefing' WHEN l.status = 'sent' THEN 'skipped_duplicate' WHEN coalesce(attempts, 0) >= 3 THEN 'failed' ELSE 'send' END FROM du d JOIN tp t USING (subscription_id) LEFT JOIN lo l ON l.subscription_id = d.subscription_id AND l.topic_key = t.topic_key WHERE due""",
    ),
    "apply_delivery_results": (
        q_apply_delivery_results,
        f"""WITH {_LATEST}, r AS (SELECT o_custkey AS subscription_id, lower(o_orderpriority) AS topic_key, first(CASE o_orderstatus WHEN 'F' THEN 'sent' ELSE 'failed' END ORDER BY o_orderkey DESC) AS rs, count(*) AS tries, TIMESTAMP '1970-01-01' + to_seconds(max(o_orderkey)) AS r_at FROM orders WHERE o_orderkey % 7 = 0 OR o_totalprice > 100000 GROUP BY ALL)
SELECT subscription_id, topic_key, '2024-01-31' AS date, coalesce(rs, status) AS status, coalesce(attempts, 0) + coalesce(tries, 0) AS attempts, coalesce(r_at, TIMESTAMP '{ad.NOW}') AS at FROM lo FULL JOIN r USING (subscription_id, topic_key)""",
    ),
}
