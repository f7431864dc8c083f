"""Greedy operators against plain walks over whole sources, topics and clients, on the smallest tables."""

import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.operators import briefings as br
from storyspark.operators import changes as ch
from storyspark.operators import near_duplicates as nd
from storyspark.operators import similar as sim
from storyspark.operators import stories as st
from storyspark.plans import briefing_queries as bq
from storyspark.plans import card_queries as cq
from storyspark.plans import story_queries as sy

SF = "/root/testdata/sf0.001"


def plain_collapse(rows, near):
    """The ordinals that stay after one walk over all rows of each source."""
    kept = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.ordinal):
        mine = (r.source_quality, len(r.snippet or ""), r.published_at.timestamp() if r.published_at else 0)
        for slot in kept[r.source_name]:
            if tuple(sorted((slot[0], r.ordinal))) in near:
                if mine > slot[1]:
                    slot[:] = [r.ordinal, mine]
                break
        else:
            kept[r.source_name].append([r.ordinal, mine])
    return sorted(o for slots in kept.values() for o, _ in slots)


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_collapse_of_near_duplicates(spark, threshold):
    """One walk over all rows of a source, where the operator walks components of classes."""
    articles = sy.deduped(spark, SF)
    near = {(r.a, r.b) for r in sim.similar_pairs(articles, threshold, sim.headline(), within=["source_name"]).collect()}
    assert near
    want = plain_collapse(articles.collect(), near)
    got = sorted(r.ordinal for r in nd.collapse_near_duplicates(articles, threshold).collect())
    assert got == want and len(got) < articles.count()


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.8])
def test_collapse_of_many_copies(spark, threshold):
    """Equal titles, titles that differ by a word, titles of stop words alone, rows without a source or time, ties."""
    rng = random.Random(5)
    words = "river bridge council harbour engine market".split()
    titles = [" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(12)] + ["the of", ""]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(titles), rng.choice([None, "", "x", "xy"]), rng.randint(1, 2), rng.choice([None, datetime(2024, 1, rng.randint(1, 3))])) for i in range(150)]
    articles = spark.createDataFrame(rows, "ordinal long, source_name string, title string, snippet string, source_quality int, published_at timestamp")
    near = {(r.a, r.b) for r in sim.similar_pairs(articles, threshold, sim.headline(), within=["source_name"]).collect()}
    no_source = sorted(r[0] for r in rows if r[1] is None)
    want = plain_collapse([r for r in articles.collect() if r.source_name], near)
    assert sorted(r.ordinal for r in nd.collapse_near_duplicates(articles, threshold).collect()) == sorted(want + no_source)
    assert nd.collapse_near_duplicates(articles.limit(0), threshold).isEmpty()


def rows_of_one_source(seed, n):
    """Titles that differ by a word or two, so that one component holds most rows, with copies and preferences in no order."""
    rng = random.Random(seed)
    words = "river bridge council harbour engine market signal garden".split()
    return [(i, "a", " ".join(rng.sample(words, rng.randint(3, 5))), None, rng.randint(1, 2), None) for i in range(n)]


ROWS = "ordinal long, source_name string, title string, snippet string, source_quality int, published_at timestamp"


@pytest.mark.parametrize(("seed", "rounds"), [(1, 40), (3, 1)])
def test_large_components_in_rounds(spark, monkeypatch, seed, rounds):
    """As one walk does; with a round alone the rest is walked."""
    monkeypatch.setattr(nd, "LARGE", 20)
    articles = spark.createDataFrame(rows_of_one_source(seed, 150), ROWS)
    near = {(r.a, r.b) for r in sim.similar_pairs(articles, 0.5, sim.headline(), within=["source_name"]).collect()}
    want, calls = plain_collapse(articles.collect(), near), []
    decide = nd.decide_in_rounds
    monkeypatch.setattr(nd, "decide_in_rounds", lambda *a: calls.append(a) or decide(*a))
    assert sorted(r.ordinal for r in nd.collapse_near_duplicates(articles, 0.5, rounds=rounds).collect()) == want
    assert calls and len(want) < 140
    still = decide(*calls[0])[1]
    assert still.isEmpty() == (rounds > 1)


@pytest.mark.parametrize("order", ["random", "rising", "falling"])
def test_rounds_against_walks(spark, order):
    """Random links in many groups: few rounds where preferences have no order, one clique, a star, a chain."""
    rng = random.Random(8)
    groups = [(100, {(i, j) for i in range(100) for j in range(i) if rng.random() < 0.05}), (14, {(i, j) for i in range(14) for j in range(i)}), (60, {(i, 0) for i in range(1, 60)}), (12, {(i, i - 1) for i in range(1, 12)})]
    rows, edges, worth, at = [], [], {}, 0
    for n, links in groups:
        for i in range(n):
            worth[at + i] = {"random": rng.randint(0, 50), "rising": i, "falling": -i}[order]
        rows += [(at, at + i) for i in range(n)]
        edges += [(at + i, at + j, worth[at + i] > worth[at + j]) for i, j in links]
        at += n
    near, slots, lost = {(j, i) for i, j, _ in edges}, [], []
    for _, r in rows:
        at = next((k for k, h in enumerate(slots) if (h, r) in near or (r, h) in near), None)
        if at is None:
            slots.append(r)
        elif worth[r] > worth[slots[at]]:
            lost.append(slots[at])
            slots[at] = r
        else:
            lost.append(r)
    gone, still = nd.decide_in_rounds(spark.createDataFrame(rows, "group long, ordinal long"), spark.createDataFrame(edges, "later long, earlier long, preferred boolean"), 40)
    assert still.isEmpty() and sorted(r.ordinal for r in gone.collect()) == sorted(lost)


def plain_matches(now, prior, least=0.25):
    """In rank order within a topic, the free prior story of highest overlap, from the urls alone."""
    out, used = [], set()
    for c in sorted(now, key=lambda r: (r.topic, r["rank"])):
        best = None
        for p in sorted((p for p in prior if p.topic == c.topic and p.cluster_no not in used), key=lambda p: p.cluster_no):
            shared = len(set(c.urls) & set(p.urls))
            overlap = shared / len(set(c.urls) | set(p.urls))
            if shared and (best is None or overlap > best[0]):
                best = overlap, shared / min(len(c.urls), len(p.urls)), p.cluster_no
        if best and (best[0] >= least or best[1] >= 0.5):
            used.add(best[2])
            out.append((c.cluster_no, best[2], round(best[0], 9)))
    return sorted(out)


def test_matches_of_many_rivals(spark):
    """Stories of one topic that share few urls, so that each has many rivals and many overlaps are equal."""
    rng = random.Random(7)
    shape = "topic string, cluster_no long, rank int, urls array<string>"

    def stories(n: int, urls: int) -> list:
        return [(rng.choice("xxxy"), i, i * 7 % n, sorted(rng.sample([f"u{k}" for k in range(urls)], rng.randint(1, 5)))) for i in range(n)]

    current = spark.createDataFrame([*stories(80, 25), ("x", 99, None, ["u1"])], shape)
    prior = spark.createDataFrame(stories(60, 25), shape)
    want = plain_matches([r for r in current.collect() if r["rank"] is not None], prior.collect())
    assert sorted((r.cluster_no, r.prior_no, round(r.overlap, 9)) for r in ch.match_prior_stories(current, prior).collect()) == want
    assert len(want) > 30
    assert ch.match_prior_stories(current.limit(0), prior).isEmpty()


def test_matches_and_changes(spark):
    current, prior = bq.both_states(spark, SF)
    # stories of all three kinds: some prior ones are missing, some had other content
    prior = prior.filter("cluster_no % 3 <> 0").withColumn("content_hash", F.when(F.col("cluster_no") % 5 == 0, "other").otherwise(F.col("content_hash")))
    now, before = current.collect(), prior.collect()
    matches = ch.match_prior_stories(current, prior)
    want = plain_matches(now, before)
    assert sorted((r.cluster_no, r.prior_no, round(r.overlap, 9)) for r in matches.collect()) == want and want
    of, old = {c: p for c, p, _ in want}, {p.cluster_no: p for p in before}
    changes = {r.cluster_no: r for r in ch.classify_changes(current, prior, matches, ad.now()).collect()}
    assert set(changes) == {r.cluster_no for r in now}
    for c in now:
        r, p = changes[c.cluster_no], old.get(of.get(c.cluster_no))
        if p is None:
            assert (r.status, r.prior_no, r.stable_id) == ("new", None, c.stable_id)
            continue
        names = lambda x: {s.strip().lower() for s in x} - {""}
        coverage = bool(set(c.urls) - set(p.urls)) or names(c.sources) != names(p.sources)
        material = c.content_hash != p.content_hash or coverage
        assert (r.status, r.stable_id, r.first_seen) == ("updated" if material else "ongoing", p.stable_id, p.first_seen)
    assert {"new", "updated", "ongoing"} == {r.status for r in changes.values()}


def test_feed(spark):
    scored = br.score_feed(bq.user_topics(spark, SF), bq.cards(spark, SF), ad.now())
    # a second topic for every third story, so that urls meet
    twice = scored.unionByName(scored.filter("cluster_no % 3 = 0").withColumns({"topic_key": F.concat(F.lit("z"), "topic_key"), "score": F.col("score") + F.when(F.col("cluster_no") % 2 == 0, 0.01).otherwise(-0.01)}))
    got = check_feed(twice)
    assert any(x[4] for x in got)


def test_feed_of_many_rivals(spark):
    """One client with most of the stories, which share few urls and scores."""
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2]), f"t{i % 9}", i, rng.choice("abc"), sorted(rng.sample([f"u{k}" for k in range(60)], rng.randint(0, 4))), rng.randint(1, 4) / 4, 0.5, 0.5) for i in range(160)]
    got = check_feed(spark.createDataFrame(rows, "client long, topic_key string, cluster_no long, headline string, urls array<string>, score double, priority double, importance double"))
    assert len(got) < 150 and any(len(x[4]) > 1 for x in got)


def check_feed(scored):
    want = []
    by = defaultdict(list)
    for r in scored.collect():
        by[r.client].append(r.asDict())
    for client, rows in by.items():
        kept = []
        for row in sorted(rows, key=lambda r: (r["topic_key"], r["cluster_no"])):
            row["also"] = []
            for k in kept:
                shared = set(row["urls"]) & set(k["urls"])
                if shared and (len(shared) / len(set(row["urls"]) | set(k["urls"])) >= 0.25 or row["headline"] == k["headline"]):
                    if row["score"] > k["score"]:
                        row["also"] = k["also"] + [k["topic_key"]]
                        k.clear()
                        k.update(row)
                    else:
                        k["also"] = k["also"] + [row["topic_key"]]
                    break
            else:
                kept.append(row)
        want += [(client, k["topic_key"], k["cluster_no"], round(k["score"], 9), tuple(k["also"])) for k in kept]
    got = [(r.client, r.topic_key, r.cluster_no, round(r.score, 9), tuple(r.also)) for r in br.dedupe_feed(scored).collect()]
    assert sorted(got) == sorted(want)
    return got


def test_briefings_on_their_history(spark):
    """Statuses against plain matches with each topic's snapshot, labels by that snapshot's own time, counts by topic."""
    b = cq.built_on_history(spark, SF)
    now = datetime(2024, 1, 31)
    state, prior = b["state"].collect(), b["prior"].collect()
    times = {r.topic: r.generated_at for r in prior}
    assert times == {"en": datetime(2024, 1, 30, 6), "fr": datetime(2024, 1, 30, 6), "de": datetime(2024, 1, 28)}  # the Spanish one is too old
    of = {c: p for c, p, _ in plain_matches(state, prior)}
    by, old = {r.cluster_no: r for r in state}, {r.cluster_no: r for r in prior}
    names = lambda x: {s.strip().lower() for s in x} - {""}

    def status(c):
        p = old.get(of.get(c.cluster_no))
        if p is None:
            return "new"
        return "updated" if c.content_hash != p.content_hash or set(c.urls) - set(p.urls) or names(c.sources) != names(p.sources) else "ongoing"

    want = {c: status(r) for c, r in by.items()}
    assert {r.cluster_no: r.status for r in b["changes"].collect()} == want and {"new", "updated", "ongoing"} == set(want.values())
    cards = b["cards"].collect()
    assert all(r.status == want[r.cluster_no] for r in cards)
    for r in b["whats_new"].collect():
        label = {"en": "What's new since yesterday", "fr": "What's new since yesterday", "de": "What's new since 3 days ago", "es": "What's new (first briefing for this topic)"}[r.topic]
        mine = [c.status for c in cards if c.topic == r.topic]
        assert (r.label, r.n_new, r.n_updated, r.n_ongoing) == (label, *[mine.count(s) for s in ("new", "updated", "ongoing")])
    exact, after = st.distinct_articles(sy.normalized(spark, SF), sy.NEAR_CONFIG)
    near = {(r.a, r.b) for r in sim.similar_pairs(exact, 0.75, sim.headline(), within=["source_name"]).collect()}
    assert sorted(r.ordinal for r in after.collect()) == plain_collapse(exact.collect(), near)
    decided = {r.cluster_no: r.decision for r in b["plan"].collect()}
    stats = {r.topic: r for r in b["stats"].collect()}
    for topic, r in stats.items():
        mine = [decided[c] for c, s in by.items() if s.topic == topic]
        assert (r.calls, r.hits) == (mine.count("compute"), len(mine) - mine.count("compute"))
    snapshot = {r.cluster_no: r for r in b["snapshot"].collect()}
    assert set(snapshot) == set(by) and {r.generated_at for r in snapshot.values()} == {now}
    assert all(snapshot[c].stable_id == old[p].stable_id for c, p in of.items())
