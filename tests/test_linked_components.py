"""Clusters found from titles against those of all linked pairs."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from storyspark.operators import briefings as br
from storyspark.operators import similar as sim
from storyspark.operators import stories as st
from storyspark.plans import briefing_queries as bq

SCHEMA = "ordinal long, topic string, title string, snippet string"


def plain(rows, pairs):
    of = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


@pytest.mark.parametrize(("words", "least"), [(12, 0), (60, 3), (60, 5)])
def test_clusters_equal_those_of_all_pairs(spark, words, least):
    """With titles of one token and without, with links that only snippets decide, and with titles of stop words alone."""
    r = random.Random(words + least)
    vocabulary = [f"word{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(words)]
    text = lambda a, b: " ".join(r.choice(vocabulary) for _ in range(r.randint(a, b)))
    rows = [(1000 - i, r.choice(["en", "fr"]), text(least, least + 4) if i % 20 else "The of", r.choice([None, "", text(1, 12)])) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    for threshold in (0.4, 0.5, 0.6):
        want = plain(rows, [(p.a, p.b) for p in sim.similar_pairs(df, threshold).collect()])
        assert {x.ordinal: x.cluster_no for x in st.cluster_articles(df, threshold).collect()} == want
        assert len(set(want.values())) > 3


def test_a_frequent_title_is_not_paired(spark, monkeypatch):
    """Rows of one title with a snippet each make no pairs, and a null topic links with none, as in SQL."""
    rows = spark.range(20_000).select(F.col("id").alias("ordinal"), F.lit("en").alias("topic"), F.lit("Rocket launch draws crowds").alias("title"), F.concat(F.lit("seen from place"), "id").alias("snippet"))
    odd = spark.createDataFrame([(30_000 + i, None, "Rocket launch draws crowds", "here") for i in range(3)], SCHEMA)
    monkeypatch.setattr(st, "similar_pairs", lambda *a, **b: pytest.fail("all pairs were asked for"))
    got = st.cluster_articles(rows.unionByName(odd), 0.5).groupBy("cluster_no").count().collect()
    assert {(x.cluster_no, x["count"]) for x in got} == {(0, 20_000), (30_000, 1), (30_001, 1), (30_002, 1)}


def test_cohesion_by_few_large_blocks(spark, monkeypatch):
    """A row is sent once for each block, so blocks are few; values on both sides of FREQUENT, copies, and empty sets."""
    r = random.Random(4)
    text = lambda n: " ".join(f"word{chr(97 + min(25, int(r.expovariate(0.2))))}x" for _ in range(r.randint(0, n)))
    rows = [(i, i // 150, text(5), r.choice([None, "", text(20)])) for i in range(200)] + [(300 + i, 0, "Rocket launch", "copy") for i in range(9)]
    members = spark.createDataFrame(rows, "ordinal long, cluster_no long, title string, snippet string")
    whole = sorted(st.cluster_cohesion(members, dataclasses.replace(sim.lexical(), matrix=None)).collect())
    for block, split, most in ((16, 2, 1000), (16, 2, 40), (512, 8, 1000)):
        for name, value in (("COHESION_BLOCK", block), ("COHESION_SPLIT", split), ("COHESION_ROWS", most)):
            monkeypatch.setattr(st, name, value)
        assert sorted(st.cluster_cohesion(members).collect()) == whole


def test_feed_with_urls_from_stories(spark):
    """As with urls in every client's row."""
    r = random.Random(5)
    stories = [(t, i, r.choice(["A", "B"]), sorted({f"u{r.randint(0, 30)}" for _ in range(r.randint(0, 6))})) for t in "ab" for i in range(12)]
    rows = [(c, *s, r.random(), 1.0, 0.1) for c in range(6) for s in stories if r.random() < 0.7]
    df = spark.createDataFrame(rows, "client int, topic_key string, cluster_no int, headline string, urls array<string>, score double, priority double, importance double")
    apart = spark.createDataFrame(stories, "topic_key string, cluster_no int, headline string, urls array<string>")
    want = sorted(map(str, br.dedupe_feed(df).collect()))
    assert sorted(map(str, br.dedupe_feed(df.drop("urls"), apart).collect())) == want and 0 < len(want) < len(rows)


def test_each_state_is_built_once(spark, monkeypatch):
    """The plan takes its cache from the states that it compares."""
    built, state = [], bq._state
    monkeypatch.setattr(bq, "_state", lambda m: built.append(1) or state(m))
    bq.q_plan_result_reuse(spark, "/root/testdata/sf0.001")
    assert len(built) == 2
