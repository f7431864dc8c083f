"""Inputs that operators met badly before: nulls, repeats, text keys, hot keys, interrupted writes."""

import dataclasses
import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from storyspark.operators import briefings as br
from storyspark.operators import limits
from storyspark.operators import near_duplicates as nd
from storyspark.operators import similar as sim
from storyspark.operators import stories as st
from storyspark.sources import commit_log as cl
from storyspark.sources import feeds
from storyspark.sources import snapshots as sn
from storyspark.streaming import stateful as sf

T0 = dt.datetime(2024, 1, 1)


def test_answer_urls_with_nulls_repeats_control_characters_and_credentials(spark):
    answers = [(1, None), (2, "first \x01text https://a.example/1."), (2, "second https://b.example/x end"), (3, "https://u:p@evil.example/x, and https://c.example/"), (4, "none at all"), (None, "https://n.example/"), (5, "")]
    allowed = [(2, "http://www.a.example/1"), (2, "https://a.example/1?utm_source=q"), (3, "https://u:p@evil.example/x"), (3, None), (None, "https://n.example/"), (3, "https://c.example")]
    got = nd.filter_answer_urls(spark.createDataFrame(answers, "answer_id long, answer string"), spark.createDataFrame(allowed, "answer_id long, url string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, None, 0), (2, "first \x01text https://a.example/1.", 0), (2, "second [link omitted] end", 1), (3, "[link omitted], and https://c.example/", 1), (4, "none at all", 0), (None, "https://n.example/", 0), (5, "", 0)], key=str
    )
    assert nd.filter_answer_urls(got.select("answer_id", "answer").limit(0), spark.createDataFrame(allowed, "answer_id long, url string")).count() == 0


def plain_limits(rows, limit, window):
    out, state = [], {}
    for key, at, i in sorted(((k, a, i) for k, i, a in rows if a is not None), key=lambda x: (str(x[0]), x[1], x[2])):
        start, n = state.get(key, (None, 0))
        if start is None or (at - start).total_seconds() >= window:
            start, n = at, 0
        state[key] = (start, n + 1)
        left = start + dt.timedelta(seconds=window) - at
        out.append((key, i, at, n + 1, n + 1 > limit, max(1, -(-int(left.total_seconds() * 1_000_000) // 1_000_000)) if n + 1 > limit else 0))
    return sorted(out, key=str)


def test_limits_of_a_hot_text_key_over_many_blocks(spark):
    r = random.Random(4)
    rows = [("hot", f"r{i:05}", T0 + dt.timedelta(seconds=r.choice([0, 0, 1]) + i // 3, microseconds=r.randrange(10**6))) for i in range(4000)]
    rows += [(f"k{i % 50}", f"s{i:05}", T0 + dt.timedelta(seconds=r.randrange(5000))) for i in range(600)] + [(None, "n", T0), (None, "m", T0), ("k1", "x", None)]
    df = spark.createDataFrame(rows, "key string, id string, at timestamp").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = limits.flag_over_limit(df, 5, 60)
        got = sorted(map(tuple, out.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_limits(rows, 5, 60) and any(x[4] for x in got)
    long = limits.flag_over_limit(df, 100, 86_400)  # one window over all blocks
    assert sorted(map(tuple, long.collect()), key=str) == plain_limits(rows, 100, 86_400)
    assert limits.flag_over_limit(df.limit(0), 5, 60).count() == 0


def test_a_hot_key_uses_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), "id", (F.timestamp_seconds(F.col("id") * 3)).alias("at"))
    small = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1000"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        tasks = limits.flag_over_limit(rows, 2, 9).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert sum(t["count"] for t in tasks) == 20_000 and len(tasks) > 1


def test_feed_of_text_clients(spark):
    rows = [("c1", "ai", 1, "A", ["u1", "u2"], 0.5, 1.0, 0.1), ("c1", "b", 2, "B", ["u1", "u2"], 0.9, 1.0, 0.1), ("c2", "ai", 1, "A", ["u1"], 0.5, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "client string, topic_key string, cluster_no int, headline string, urls array<string>, score double, priority double, importance double")
    got = br.dedupe_feed(df)
    assert sorted((r.client, r.topic_key, r.cluster_no, list(r.also)) for r in got.collect()) == [("c1", "b", 2, ["ai"]), ("c2", "ai", 1, [])]
    assert br.dedupe_feed(df.limit(0)).count() == 0


def snapshot(spark, topic, at, v):
    return spark.createDataFrame([(topic, at, v)], "topic string, generated_at timestamp, v int")


def test_a_writer_that_dies_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    assert sn.read_topic_snapshot(spark, path) is None
    sn.write_topic_snapshot(snapshot(spark, "en", T0, 1), path)
    with monkeypatch.context() as m:
        m.setattr(cl, "create_once", lambda *a: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            sn.write_topic_snapshot(snapshot(spark, "en", T0 + dt.timedelta(1), 2), path)
    assert [r.v for r in sn.read_topic_snapshot(spark, path).collect()] == [1]
    sn.write_topic_snapshot(snapshot(spark, "fr", T0, 3), path)
    assert sorted(r.v for r in sn.read_topic_snapshot(spark, path).collect()) == [1, 3]
    assert not list(tmp_path.glob("snap/_log/*.tmp"))


def test_concurrent_writers_all_survive(spark, tmp_path):
    path = str(tmp_path / "snap")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: sn.write_topic_snapshot(snapshot(spark, f"t{i}", T0, i), path), range(12)))
    assert sorted(r.v for r in sn.read_topic_snapshot(spark, path).collect()) == list(range(12))
    assert cl.versions(spark, path) == list(range(1, 13))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sn.merge_state(spark.createDataFrame([(i % 3, i)], "k int, v int"), ["k"], lambda d: sf.latest_state(d, ["k"], ["v"]), str(tmp_path / "state"), 2), range(9)))
    assert sorted(map(tuple, sn.read_state(spark, str(tmp_path / "state")).select("k", "v").collect())) == [(0, 6), (1, 7), (2, 8)]


def test_old_versions_go_and_snapshots_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cl, "KEPT", 3)
    monkeypatch.setattr(sn, "MERGE_AFTER", 4)
    path = str(tmp_path / "snap")
    for day in range(9):
        sn.write_topic_snapshot(snapshot(spark, "en", T0 + dt.timedelta(day), day), path)
    assert len(cl.versions(spark, path)) == 3 and len(list(tmp_path.glob("snap/data/*"))) <= 10
    assert sorted(r.v for r in sn.read_snapshots(spark, path).collect()) == list(range(9))
    runs = spark.createDataFrame([("en", T0 + dt.timedelta(days=d, hours=5)) for d in (0, 4, 20)] + [("fr", T0)], "topic string, run_at timestamp")
    assert sorted((r.run_at.day, r.v) for r in sn.snapshots_as_of(sn.read_snapshots(spark, path), runs, 48).collect()) == [(1, 0), (5, 4)]
    sn.expire_snapshots(spark, path, F.lit("2024-01-06").cast("timestamp"))
    assert sorted(r.v for r in sn.read_snapshots(spark, path).collect()) == [5, 6, 7, 8]


def test_keyed_state_writes_only_the_buckets_of_a_batch(spark, tmp_path):
    path, merge = str(tmp_path / "state"), lambda d: sf.latest_state(d, ["k"], ["at"])
    sn.merge_state(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("at")), ["k"], merge, path, 64)
    before = cl.state(spark, path)[1]
    sn.merge_state(spark.createDataFrame([(7, 2)], "k long, at int"), ["k"], merge, path, 64)
    after = cl.state(spark, path)[1]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and spark.read.parquet(f"{path}/{after[changed[0]]}").count() < 100
    got = sn.read_state(spark, path)
    assert got.count() == 2000 and got.filter("at = 2").count() == 1


def plain_clusters(rows, pairs):
    of = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.85])
def test_clusters_and_cohesion_of_copies_equal_those_of_all_pairs(spark, threshold):
    """At the higher thresholds copies without a snippet aren't linked with each other."""
    r = random.Random(6)
    words = "apple launch rocket market storm vote chips bank".split()
    texts = [(" ".join(r.choice(words) for _ in range(r.randint(0, 5))), r.choice([None, "", "storm market falls"])) for _ in range(25)]
    rows = [(i, r.choice(["en", "fr"]), *r.choice(texts)) for i in range(160)]
    df = spark.createDataFrame(rows, "ordinal long, topic string, title string, snippet string")
    pairs = [(p.a, p.b) for p in sim.similar_pairs(df, threshold).collect()]
    want = plain_clusters(rows, pairs)
    members = st.cluster_articles(df, threshold)
    assert {x.ordinal: x.cluster_no for x in members.collect()} == want and members.columns == [*df.columns, "cluster_no"]
    s = members.select("cluster_no", "ordinal", F.struct(*[c.alias(n) for n, c in sim.lexical().columns.items()]).alias("s")).alias("x")
    every = s.join(s.alias("y"), F.col("x.cluster_no") == F.col("y.cluster_no")).filter("x.ordinal < y.ordinal")
    mean = {m.c: m.m for m in every.groupBy(F.col("x.cluster_no").alias("c")).agg(F.avg(sim.lexical_score(F.col("x.s"), F.col("y.s"))).alias("m")).collect()}
    for metric in (sim.lexical(), dataclasses.replace(sim.lexical(), matrix=None)):
        got = {x.cluster_no: x.similarity_score for x in st.cluster_cohesion(members, metric).collect()}
        assert set(got) == set(want.values()) and all(abs(v - mean.get(c, 1.0)) < 1e-4 for c, v in got.items())


def test_ten_thousand_copies_cluster_in_proportion(spark):
    copies = spark.range(10_000).select(F.col("id").alias("ordinal"), F.lit("en").alias("topic"), F.lit("Rocket launch draws crowds").alias("title"), F.lit("at the coast").alias("snippet"))
    members = st.cluster_articles(copies, 0.5)
    assert [(x.cluster_no, x["count"]) for x in members.groupBy("cluster_no").count().collect()] == [(0, 10_000)]
    assert [x.similarity_score for x in st.cluster_cohesion(members).collect()] == [1.0]
    assert sim.copy_classes(copies, sim.lexical()).select("class").distinct().count() == 1


def test_feeds_as_a_stream_feed_the_other_streams(spark, tmp_path):
    """Two landings, one file malformed, one url twice: what has landed is read once, and a bad file is told and skipped."""
    item = lambda i, u: f"<item><title>Story {i} - Wire</title><link>https://a.example/{u}</link><pubDate>Mon, {i + 1} Jan 2024 08:00:00 +0000</pubDate></item>"
    folder, out = tmp_path / "feeds", str(tmp_path / "out")
    folder.mkdir()

    def land(name, text):
        (folder / name).write_text(text)

    def run(df, name):
        q = df.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/{name}-cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/{name}").collect()

    land("ai.xml", "<rss><channel>" + "".join(item(i, i) for i in range(4)) + "<item><title></title></item></channel></rss>")
    land("broken.xml", "<rss><channel><item><title>cut off")
    articles, problems = feeds.stream_feed_dir(spark, str(folder), 3)
    assert sorted((r.topic, r.position, r.title) for r in run(articles, "a")) == [("ai", i, f"Story {i}") for i in range(3)]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in run(problems, "p")] == [("broken.xml", "unclosed item")]
    land("space.xml", "<rss><channel>" + item(7, 1) + item(8, 8) + "</channel></rss>")
    land("none.xml", "hello")
    assert sorted((r.topic, r.title) for r in run(articles, "a")) == [("ai", f"Story {i}") for i in range(3)] + [("space", "Story 7"), ("space", "Story 8")]
    assert sorted(r.reason for r in run(problems, "p")) == ["no feed", "unclosed item"]
    fresh = sf.stream_dedupe_articles(articles, at="published_at")
    assert sorted(r.canonical_url for r in run(fresh, "d")) == [f"https://a.example/{i}" for i in (0, 1, 2, 8)]
    batch = feeds.scan_feed_dir(spark, str(folder), 3)
    assert sorted(map(str, batch.collect())) == sorted(map(str, run(articles, "a")))
