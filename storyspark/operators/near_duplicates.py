"""Greedy collapse of near-duplicate headlines, and coverage and citation helpers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import canonical_url, valid_http_url
from storyspark.operators.components import connected_components
from storyspark.operators.similar import Metric, headline, similar_pairs
from storyspark.plans.cutting import discard, materialize


def _losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that another stands for, from rows and their linked classes in the order of group, row, class.

    A row comes first without a class, then once for each class that it is linked with. Held are the rows that
    stand for a slot at the moment, by class; a loser leaves at once.
    """
    group, slots, of_class, row, found = None, [], {}, None, None

    def settle() -> list[int]:
        ordinal, cls, mine = row
        if found is None:
            slots.append(row)
            heapq.heappush(of_class.setdefault(cls, []), len(slots) - 1)
            return []
        if mine <= slots[found][2]:
            return [ordinal]
        loser, slots[found] = slots[found][0], row
        heapq.heappush(of_class.setdefault(cls, []), found)
        return [loser]

    def first_slot(cls: int) -> int | None:
        heap = of_class.get(cls, [])
        while heap and slots[heap[0]][1] != cls:  # its row has been displaced by one of another class
            heapq.heappop(heap)
        return heap[0] if heap else None

    for b in batches:
        gone = []
        for r in b.to_pylist():
            if r["linked"] is None:
                gone += settle() if row else []
                if r["group"] != group:
                    group, slots, of_class = r["group"], [], {}
                row, found = (r["ordinal"], r["class"], (r["source_quality"], r["snippet_length"], r["at"])), None
            elif (slot := first_slot(r["linked"])) is not None and (found is None or slot < found):
                found = slot
        yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["ordinal"])
    if row:
        yield pa.RecordBatch.from_arrays([pa.array(settle(), pa.int64())], names=["ordinal"])


#: A component of more rows is decided in rounds, if its rows have at most so many links each; and how many rounds it gets.
LARGE, PAIRS_A_ROW, ROUNDS = 100_000, 64, 40


def decide_in_rounds(rows: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(ordinal) of the rows that another stands for, and (group, ordinal) of those that are still open after ``rounds``.

    rows: group (its least ordinal), ordinal; edges: later, earlier (linked rows), and whether the later one is preferred.

    A slot's number is its opener's ordinal, ``until`` the row that takes a row's place in it. A settled row stands
    for its slot at the time of a later one for sure unless a preferred open row in between is linked with it. A row
    takes the first slot where that is sure and which no open earlier neighbour can undercut, is lost once
    a sure slot comes before all whose row it would displace, and opens its own once no earlier neighbour is open.
    The first open row of a component always settles, so every round decides some.
    """
    no_number = F.lit(None).cast("long")
    nodes = materialize(rows.select("group", "ordinal", F.lit(True).alias("open"), no_number.alias("slot"), no_number.alias("until"), F.col("group").alias("least")), "nodes")
    edges, gone = materialize(edges, "edges"), rows.select("ordinal").limit(0)
    for _ in range(rounds):
        if nodes.filter("open").isEmpty():
            break
        met = edges.join(nodes.withColumnRenamed("ordinal", "earlier").drop("group"), "earlier")
        threat = met.filter("preferred and not open").groupBy("earlier").agg(F.min("later").alias("threat")).withColumnRenamed("earlier", "threatened")
        met = met.join(threat, F.col("earlier") == F.col("threatened"), "left")
        stands = ~F.col("open") & (F.col("until").isNull() | (F.col("until") > F.col("later")))
        sure = F.col("threat").isNull() | (F.col("threat") >= F.col("later"))
        per = met.groupBy("later").agg(
            F.min(F.when(stands, F.struct("slot", "earlier", "preferred", sure.alias("sure")))).alias("best"),
            F.min(F.when(stands & sure, F.col("slot"))).alias("safe"),
            F.min(F.when(F.col("preferred") & (F.col("open") | stands), F.when(F.col("open"), F.col("least")).otherwise(F.col("slot")))).alias("beats"),
            F.min(F.when(F.col("open"), F.col("least"))).alias("floor"),
            F.min(F.when(F.col("open"), F.col("least")).otherwise(F.col("slot"))).alias("bound"),
        )
        now = nodes.filter("open").select("group", "ordinal", "least").join(per, F.col("ordinal") == F.col("later"), "left")
        joins = F.col("best").isNotNull() & F.col("best.sure") & (F.col("floor").isNull() | (F.col("best.slot") <= F.col("floor")))
        opens = F.col("best").isNull() & F.col("floor").isNull()
        loses = F.coalesce(F.col("beats").isNull() | (F.col("safe") < F.col("beats")), F.lit(False)) & F.col("safe").isNotNull()
        outcome = F.when(opens, "opens").when(loses, "lost").when(~F.coalesce(joins, F.lit(False)), "open").when(F.col("best.preferred"), "displaces").otherwise("lost")
        step = now.withColumn("outcome", outcome).select(
            "group", "ordinal", "outcome",
            F.when(F.col("outcome") == "opens", F.col("ordinal")).when(F.col("outcome") == "displaces", F.col("best.slot")).alias("slot"),
            F.when(F.col("outcome") == "displaces", F.col("best.earlier")).alias("over"),
            F.greatest("least", F.least("ordinal", "bound")).alias("least"),
        )
        step = materialize(step, "step")
        over = step.filter("over is not null").select(F.col("over").alias("ordinal"), F.col("ordinal").alias("by"))
        gone = gone.unionByName(step.filter("outcome = 'lost'").select("ordinal")).unionByName(over.select("ordinal"))
        held = nodes.filter("not open").join(over, "ordinal", "left").select("group", "ordinal", "open", "slot", F.coalesce("until", "by").alias("until"), "least")
        fresh = step.filter("outcome <> 'lost'").select("group", "ordinal", (F.col("outcome") == "open").alias("open"), "slot", no_number.alias("until"), "least")
        after = materialize(held.unionByName(fresh), "nodes")
        left = edges.join(after.filter("open").select(F.col("ordinal").alias("later")), "later", "left_semi").join(after.select(F.col("ordinal").alias("earlier")), "earlier", "left_semi")
        left = materialize(left, "edges")
        discard(nodes)
        discard(edges)
        nodes, edges = after, left
    return gone, nodes.filter("open").select("group", "ordinal")


def _rounds_of_large_groups(members: DataFrame, links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame] | None:
    """The large groups that rounds decide, and their rows that another stands for; None where there is no such group."""
    copies = members.groupBy("group", "class").agg(F.count("*").alias("n"))
    linked = links.join(copies.select(F.col("class").alias("linked"), F.col("n").alias("of_linked")), "linked").groupBy("class").agg(F.sum("of_linked").alias("near"))
    sizes = copies.join(linked, "class", "left").groupBy("group").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.coalesce("near", F.lit(0))).alias("links"))
    large = materialize(sizes.filter((F.col("rows") > LARGE) & (F.col("links") <= F.col("rows") * 2 * PAIRS_A_ROW)).select("group"), "large")
    if large.isEmpty():
        return None
    rows = materialize(members.join(large, "group", "left_semi").withColumn("worth", F.struct("source_quality", "snippet_length", "at")), "large_members")
    later = rows.select(F.col("ordinal").alias("later"), "class", F.col("worth").alias("later_worth"))
    earlier = rows.select(F.col("ordinal").alias("earlier"), F.col("class").alias("linked"), F.col("worth").alias("earlier_worth"))
    edges = later.join(links, "class").join(earlier, "linked").filter("later > earlier").select("later", "earlier", (F.col("later_worth") > F.col("earlier_worth")).alias("preferred"))
    gone, still = decide_in_rounds(rows, edges, rounds)
    unfinished = materialize(still.select("group").distinct(), "unfinished")
    mine = rows.select("ordinal", "group").join(unfinished, "group", "left_anti")
    return large.join(unfinished, "group", "left_anti"), gone.join(mine.select("ordinal"), "ordinal", "left_semi")


def collapse_near_duplicates(articles: DataFrame, threshold: float = 0.85, metric: Metric | None = None, rounds: int = ROUNDS) -> DataFrame:
    """articles without those that a near-duplicate headline of the same source stands for.

    In ordinal order, a row joins the first kept row it is a near-duplicate of; the preferred of the two (tier,
    snippet length, time) is compared from then on. With titles alone a score is
    0.8 at most, so the default threshold collapses nothing: pass one.

    Rows of one source that are equal to the metric are one class: the exact join pairs classes, and copies are
    never paired with each other. Components of classes are walked in sorted order; a task holds the rows that
    stand for others at the moment, not a component's rows or pairs. Large components are decided in rounds of joins,
    many rows at a time, if that takes at most PAIRS_A_ROW links of rows for each row; one that ``rounds`` don't finish
    is walked. Rows without a source pass as they are.
    """
    metric = metric or headline()
    if metric.overlap(threshold) > 1:  # no two sets share more than all of their tokens
        return articles
    tokens = articles.filter("source_name is not null").select(
        "source_name",
        "ordinal",
        "source_quality",
        F.length(F.coalesce("snippet", F.lit(""))).alias("snippet_length"),
        F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("at"),
        F.struct(*[c.alias(n) for n, c in metric.columns.items()]).alias("s"),
    )
    parts = [F.array_sort(F.col(f"s.{f.name}")) if f.dataType.typeName() == "array" else F.col(f"s.{f.name}") for f in tokens.schema["s"].dataType]
    rows = materialize(tokens.withColumn("key", F.sha2(F.to_json(F.struct(*parts)), 256)), "titles")
    classes = materialize(rows.groupBy("source_name", "key").agg(F.min("ordinal").alias("class"), F.count("*").alias("n")), "classes")
    firsts = rows.join(classes.select(F.col("class").alias("ordinal"), "n"), "ordinal")
    pairs = materialize(similar_pairs(firsts, threshold, replace(metric, columns={n: F.col(f"s.{n}") for n in metric.columns}), within=["source_name"]).select("a", "b"), "near_pairs")
    own = firsts.filter(F.col("n") > 1).filter(metric.score(F.col("s"), F.col("s")) >= threshold).select(F.col("ordinal").alias("class"), F.col("ordinal").alias("linked"))
    links = materialize(pairs.toDF("class", "linked").unionByName(pairs.toDF("linked", "class")).unionByName(own), "links")
    comp = connected_components(pairs, "a", "b").toDF("class", "group")
    groups = links.select("class").distinct().join(comp, "class", "left").select("class", F.coalesce("group", "class").alias("group"))
    members = materialize(rows.join(classes, ["source_name", "key"]).join(groups, "class").select("group", "ordinal", "class", "source_quality", "snippet_length", "at"), "members")
    lost = _rounds_of_large_groups(members, links, rounds)
    if lost is not None:
        settled, gone_in_rounds = lost
        members = members.join(settled, "group", "left_anti")
    met = members.withColumn("linked", F.lit(None).cast("long")).unionByName(members.select("group", "ordinal", "class").join(links, "class"), allowMissingColumns=True)
    gone = met.repartition("group").sortWithinPartitions("group", "ordinal", "linked").mapInArrow(_losers, "ordinal long")
    if lost is not None:
        gone = gone.unionByName(gone_in_rounds)
    return articles.join(gone, "ordinal", "left_anti")


#: Label wording, and verbs that attribute it.
FORBIDDEN = r"(?i)(?<![A-Za-z0-9_])(left[- ]wing|right[- ]wing|far[- ]left|far[- ]right|the left|the right|liberal media|conservative media|biased|unbiased|bias|partisan|propaganda)(?![A-Za-z0-9_])"
ATTRIBUTED = r"(?i)(?<![A-Za-z0-9_])(says|said|writes|wrote|according to|quoted|reports that)(?![A-Za-z0-9_])"


def scrub_labels(df: DataFrame, text: str, forbidden: str = FORBIDDEN, attributed: str = ATTRIBUTED) -> DataFrame:
    """Adds scrubbed, and dropped, the number of sentences with label wording and no attribution verb."""
    sentences = F.split(F.col(text), r"(?<=[.!?])\s+")
    keep = F.filter(sentences, lambda s: ~s.rlike(forbidden) | s.rlike(attributed))
    hit = F.col(text).rlike(forbidden)
    return df.withColumns({"scrubbed": F.when(hit, F.btrim(F.array_join(keep, " "))).otherwise(F.col(text)), "dropped": F.when(hit, F.size(sentences) - F.size(keep)).otherwise(0)})


def coverage_sources(cards: DataFrame) -> DataFrame:
    """cluster_no, position, url, source: distinct urls of a story, the primary first, sources by position of "A · B"."""
    names = F.split("covered_by", " · ")
    rows = cards.select("cluster_no", "primary_source", names.alias("names"), F.posexplode("urls").alias("position", "url"))
    source = F.when(F.col("position") == 0, F.col("primary_source")).otherwise(F.coalesce(F.get("names", F.col("position")), F.lit("Source")))
    first = rows.withColumn("source", source).groupBy("cluster_no", "url").agg(F.min(F.struct("position", "source")).alias("f"))
    return first.select("cluster_no", "f.position", "url", "f.source")


def comparable_stories(sources: DataFrame) -> DataFrame:
    """cluster_no, n, comparable, reason: two source articles or more can be compared."""
    by = sources.groupBy("cluster_no").agg(F.count("*").alias("n"))
    return by.withColumns({"comparable": F.col("n") >= 2, "reason": F.when(F.col("n") < 2, "fewer than two source articles")})


def citation_ids(answers: DataFrame) -> DataFrame:
    """answer_id, citation: ids like S1 or S1.2 in brackets in an answer, once each."""
    ids = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(S[0-9]+(?:\.[0-9]+)?)\]"), 1))
    return answers.select("answer_id", F.explode(ids).alias("citation"))


def insufficient_answers(answers: DataFrame) -> DataFrame:
    """Adds insufficient: the answer says that context is missing, or is blank."""
    said = r"(?i)(not enough|insufficient|no relevant|do(?:es)? not (?:contain|include|have)|don't have)[^.]{0,40}(information|context|coverage|stor(?:y|ies)|articles?)"
    return answers.withColumn("insufficient", (F.trim(F.coalesce("answer", F.lit(""))) == "") | F.coalesce(F.col("answer").rlike(said), F.lit(False)))


#: A url in an answer, and the marks after it that are not part of it.
ANSWER_URL = r"(?i:https?)://[^\s\]>'\"]+"
URL_TAIL = r"[.,);]*"


def filter_answer_urls(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answer_id, answer, omitted: urls that aren't allowed for an answer become ``[link omitted]``, closing punctuation kept.

    answers: answer_id, answer; allowed: answer_id, url. Urls compare as written or canonical; one with credentials is
    never allowed, on either side. Each answer is one row of its own, whatever its id: a null one stays null, and
    answers of one id have its urls in common.
    """

    def safe(url: Column) -> Column:
        u = F.trim(url)
        return F.when(valid_http_url(u) & ~F.contains(F.regexp_extract(u, "^[^:]+://([^/?#]*)", 1), F.lit("@")), u)

    known = allowed.select("answer_id", safe(F.col("url")).alias("url")).filter("url is not null")
    known = known.groupBy("answer_id").agg(F.array_union(F.collect_set("url"), F.collect_set(canonical_url(F.col("url")))).alias("known"))

    def shown(url: Column, after: Column) -> Column:
        tail = F.regexp_extract(url, f"({URL_TAIL})$", 1)
        bare = safe(F.left(url, F.length(url) - F.length(tail)))
        fine = F.array_contains("known", bare) | F.array_contains("known", canonical_url(bare))
        keeps = F.coalesce(bare.isNotNull() & fine, F.lit(False))
        return F.struct(F.concat(F.when(keeps, url).otherwise(F.concat(F.lit("[link omitted]"), tail)), after).alias("text"), (~keeps).alias("gone"))

    urls, between = F.regexp_extract_all("answer", F.lit(f"({ANSWER_URL})"), 1), F.split("answer", ANSWER_URL, -1)
    rows = answers.select("answer_id", "answer").join(known.withColumnRenamed("answer_id", "of"), F.col("answer_id").eqNullSafe(F.col("of")), "left").withColumn("between", between)
    rows = rows.withColumn("urls", F.zip_with(urls, F.slice("between", 2, F.size(urls)), shown))
    text = F.concat(F.get("between", F.lit(0)), F.array_join(F.transform("urls", lambda x: x.text), ""))
    return rows.select("answer_id", F.when(F.col("answer").isNotNull(), text).alias("answer"), F.coalesce(F.size(F.filter("urls", lambda x: x.gone)), F.lit(0)).cast("long").alias("omitted"))


def compare_coverage(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for a comparable story: common claims (6), majority facts (4), a report per source, what is missing.

    cards: cluster_no, key_facts, summary, primary_source; sources as coverage_sources gives them. Every claim
    stands for all sources; stories with fewer than two sources are left out.
    """
    listed = sources.groupBy("cluster_no").agg(F.array_sort(F.collect_list(F.struct("position", "source", "url"))).alias("s")).filter(F.size("s") >= 2)
    rows = cards.select("cluster_no", "key_facts", "summary", "primary_source").join(listed, "cluster_no")
    detail = lambda x: F.when(x.source == F.col("primary_source"), F.concat(F.lit("Primary coverage summary: "), F.col("summary"))).otherwise("Also covering this event (see article).")
    return rows.select(
        "cluster_no",
        F.slice("key_facts", 1, 6).alias("claims"),
        F.slice("key_facts", 1, 4).alias("majority_facts"),
        F.transform("s", lambda x: x.source).alias("sources"),
        F.transform("s", lambda x: F.struct(x.source.alias("source"), x.url.alias("url"), detail(x).alias("detail"))).alias("reports"),
        F.when(F.size("s") < 3, F.array(F.lit("Limited outlet set — additional independent sources may add detail."))).otherwise(F.array().cast("array<string>")).alias("missing"),
    )


def conflict_positions(disagreements: DataFrame, sources: DataFrame) -> DataFrame:
    """cluster_no, issue, source, claim, url: each position with the url of its source, by name without case.

    disagreements: cluster_no, issue, positions (array of source, claim). Of several urls of a source the first counts.
    """
    rows = disagreements.select("cluster_no", "issue", F.explode("positions").alias("p")).select("cluster_no", "issue", "p.source", "p.claim", F.lower("p.source").alias("key"))
    first = sources.groupBy("cluster_no", F.lower("source").alias("key")).agg(F.min_by("url", "position").alias("url"))
    return rows.join(first, ["cluster_no", "key"], "left").select("cluster_no", "issue", "source", "claim", "url")
