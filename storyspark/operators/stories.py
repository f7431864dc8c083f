"""Story clusters: components over similar pairs, cohesion, representatives, scores, ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.config import Config
from storyspark.functions.text import clamp01, round_k, short_hash, similarity_tokens
from storyspark.operators.articles import dedupe_best_by_url, relevance, tier_score
from storyspark.operators.components import connected_components
from storyspark.operators.near_duplicates import collapse_near_duplicates
from storyspark.operators.similar import Metric, copy_classes, equality_key, lexical, linked_components, links_by_title, similar_pairs
from storyspark.plans.cutting import materialize



def cluster_articles(df: DataFrame, threshold: float, metric: Metric | None = None) -> DataFrame:
    """df with cluster_no, the least ordinal of its component within its topic; singletons are clusters.

    Where titles can tell, clusters are found without all linked pairs (``linked_components``), which grow with the square of
    a frequent title. Else rows of a topic that are equal to the metric are one class, searched once and never paired with each
    other, so the work grows with the different texts. Copies that don't reach the threshold with each other still
    meet in a class that both are linked to.
    """
    metric = metric or lexical()
    if links_by_title(metric, threshold):
        number = linked_components(df, threshold, metric)
        return df.join(number, F.col("ordinal") == F.col("id"), "left").withColumn("cluster_no", F.coalesce("component", "ordinal")).drop("id", "component")
    classes = materialize(copy_classes(df, metric), "copies")
    firsts = df.join(classes.filter("id = class").select(F.col("id").alias("ordinal")), "ordinal", "left_semi")
    found = connected_components(similar_pairs(firsts, threshold, metric), "a", "b")
    own = F.when(F.col("alike") >= threshold, F.col("class")).otherwise(F.col("id"))
    number = classes.join(found, F.col("class") == F.col("node"), "left").select("id", F.coalesce("component", own).alias("cluster_no"))
    return df.join(number, F.col("ordinal") == F.col("id"), "left").drop("id")


#: Rows of each side that are worked out at once, the most rows of a block, and the blocks at least of a cluster that has the rows for them.
COHESION_BLOCK, COHESION_ROWS, COHESION_SPLIT = 512, 32_768, 8
#: A value that more cells than this share goes through a product of matrices, others cell by cell.
FREQUENT = 2_000


def _postings(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Values, where each one's rows start and how many there are, the rows, and the number of rows of a block."""
    order = np.argsort(codes, kind="stable")
    values, start, count = np.unique(codes[order], return_index=True, return_counts=True)
    return values, start, count, rows[order], n


def _shared(left: tuple, right: tuple) -> np.ndarray:
    """How many values each row of the one side has in common with each of the other, from their postings."""
    (a, a_start, a_count, a_rows, n), (b, b_start, b_count, b_rows, m) = left, right
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    cells = a_count[i] * b_count[j]
    out = np.zeros((n, m), np.float32)
    if (often := cells > FREQUENT).any():
        sides = []
        for k, start, count, rows, size in ((i[often], a_start, a_count, a_rows, n), (j[often], b_start, b_count, b_rows, m)):
            x = np.zeros((size, len(k)), np.float32)
            for at, (s, c) in enumerate(zip(start[k], count[k], strict=True)):
                x[rows[s : s + c], at] = 1
            sides.append(x)
        out = sides[0] @ sides[1].T
    i, j, cells = i[~often], j[~often], cells[~often]
    if len(cells):
        of, at = np.repeat(np.arange(len(cells)), cells), np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        up, along = np.divmod(at, b_count[j][of])
        met = a_rows[a_start[i][of] + up] * m + b_rows[b_start[j][of] + along]
        out += np.bincount(met, minlength=n * m).reshape(n, m)
    return out


def _blocks(t: pa.Table, names: list[str], sets: list[str]) -> Iterator[tuple[dict, dict, np.ndarray]]:
    """Of COHESION_BLOCK rows at a time: postings of the sets, sizes of sets and flags, and how many members a row stands for."""
    n, held = t.num_rows, {}
    for c in names:
        x = t[c].combine_chunks()
        held[c] = x.to_numpy(zero_copy_only=False)
        if c in sets:
            ends = np.cumsum(lengths := pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64))
            held[c] = (lengths, ends - lengths, x.flatten().to_numpy(zero_copy_only=False))
    copies = t["n"].to_numpy()
    for s in range(0, n, COHESION_BLOCK):
        size, lists, sides = min(COHESION_BLOCK, n - s), {}, {}
        for c in names:
            if c not in sets:
                sides[c] = held[c][s : s + size]
                continue
            lengths, starts, codes = held[c]
            sides[c] = lengths[s : s + size]
            first = starts[s]
            lists[c] = _postings(codes[first : first + sides[c].sum()], np.repeat(np.arange(size), sides[c]), size)
        yield lists, sides, copies[s : s + size]


def _coded(t: pa.Table, sets: list[str]) -> pa.Table:
    """The table with numbers for the values of its sets."""
    for c in sets:
        x = t[c].combine_chunks()
        codes = x.flatten().dictionary_encode().indices
        lengths = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        t = t.set_column(t.column_names.index(c), c, pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), codes))
    return t


def _tile_sum(t: pa.Table, names: list[str], matrix: Callable) -> tuple[int, int]:
    """The sum of the scores of a tile's pairs of members, in units of 1e-9, and their number; a row stands for n members."""
    low, high = t["low"][0].as_py(), t["high"][0].as_py()
    sets = [c for c in names if pa.types.is_list(t.schema.field(c).type) or pa.types.is_large_list(t.schema.field(c).type)]
    t = _coded(t, sets)
    left = list(_blocks(t.filter(pc.equal(t["mine"], low)), names, sets))
    right = left if low == high else list(_blocks(t.filter(pc.equal(t["mine"], high)), names, sets))
    total = count = 0
    for i, (a, a_side, n) in enumerate(left):
        for j in range(i if low == high else 0, len(right)):
            b, b_side, m = right[j]
            score = matrix(a_side, b_side, {c: _shared(a[c], b[c]).astype(float) for c in sets})
            units = np.floor(score * 1e9 + 0.5).astype(np.int64)
            pairs = n[:, None] * m[None, :]
            if low == high and i == j:
                pairs = np.triu(pairs, 1)
                np.fill_diagonal(pairs, n * (n - 1) // 2)
            many = int(pairs.sum())
            # a unit is below 2^30, so the sum of few pairs fits
            total += int((units * pairs).sum()) if many < 2**32 else sum(int(u) * int(p) for u, p in zip(units.ravel(), pairs.ravel(), strict=True))
            count += many
    return total, count


def cluster_cohesion(members: DataFrame, metric: Metric | None = None) -> DataFrame:
    """cluster_no, similarity_score: mean over all pairs of members, not only linked ones; 1 for one member.

    The definition asks for the square of a cluster. Members that are equal to the metric are one row with their
    number. Rows are dealt into blocks, any two of which make a tile, so no task holds a whole cluster; within a tile
    COHESION_BLOCK rows meet as many at a time: frequent values by a product of matrices, others cell by cell. A row is sent
    once for each block, and blocks hold up to COHESION_ROWS rows. A metric without a ``matrix`` is worked out pair by pair.
    """
    metric = metric or lexical()
    every = members.select("cluster_no", "ordinal", F.struct(*[c.alias(n) for n, c in metric.columns.items()]).alias("s"))
    every = every.groupBy("cluster_no", equality_key("s", every.schema["s"].dataType).alias("key")).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"), F.first("s").alias("s"))
    whole = every.groupBy("cluster_no").agg(F.sum("n").alias("members")).filter("members > 1").drop("members")
    every = materialize(every.join(whole, "cluster_no").drop("key"), "distinct_members")
    rows = every.select("cluster_no", "ordinal", "n", "s.*")
    least = F.least(F.ceil(F.count("*") / COHESION_BLOCK), F.lit(COHESION_SPLIT))
    sizes = rows.groupBy("cluster_no").agg(F.greatest(least, F.ceil(F.count("*") / COHESION_ROWS)).cast("int").alias("blocks"))
    if metric.matrix is None:
        left, right = (every.select("cluster_no", F.col("ordinal").alias(x), F.col("s").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        pairs = left.join(right, "cluster_no").filter(F.col("a") <= F.col("b"))
        times = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
        score = round_k(metric.score(F.col("sa"), F.col("sb")), 9).cast("decimal(10,9)")
        sums = pairs.withColumn("times", times).groupBy("cluster_no").agg(F.sum(score * F.col("times").cast("decimal(19,0)")).cast("double").alias("total"), F.sum("times").alias("pairs"))
    else:
        placed = rows.join(sizes, "cluster_no").withColumn("mine", F.pmod(F.xxhash64("ordinal"), F.col("blocks")).cast("int"))
        sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.select("cluster_no", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "ordinal", "n", *metric.columns)

        names, matrix = list(metric.columns), metric.matrix

        def tile(t: pa.Table) -> pa.Table:
            total, pairs = _tile_sum(t, names, matrix)
            return pa.table({"cluster_no": t["cluster_no"].combine_chunks()[:1], "total": [str(total)], "pairs": pa.array([pairs], pa.int64())})

        # tiles take time and few bytes, so tasks go by number
        dealt = sent.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster_no", "low", "high")
        tiles = dealt.groupBy("cluster_no", "low", "high").applyInArrow(tile, T.StructType([members.schema["cluster_no"], T.StructField("total", T.StringType()), T.StructField("pairs", T.LongType())]))
        sums = tiles.groupBy("cluster_no").agg((F.sum(F.col("total").cast("decimal(38,0)")) / F.lit(10**9)).cast("double").alias("total"), F.sum("pairs").alias("pairs"))
    mean = sums.select("cluster_no", round_k(F.col("total") / F.col("pairs")).alias("mean"))
    return members.select("cluster_no").distinct().join(mean, "cluster_no", "left").select("cluster_no", F.coalesce("mean", F.lit(1.0)).alias("similarity_score"))


def _rep_order(cfg: Config) -> Column:
    """Best last: tier, newest, longest snippet, first row."""
    return F.struct(
        tier_score(F.col("source_tier"), cfg).alias("q"), F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), F.length(F.coalesce("snippet", F.lit(""))).alias("l"), (-F.col("ordinal")).alias("o")
    )


def pick_representative(members: DataFrame, cfg: Config = Config()) -> DataFrame:
    """cluster_no with ordinal, title, url and source of its representative."""
    best = members.groupBy("cluster_no").agg(F.max_by(F.struct("ordinal", "title", "url", "source_name"), _rep_order(cfg)).alias("r"))
    return best.select("cluster_no", F.col("r.ordinal").alias("representative"), F.col("r.title").alias("rep_title"), F.col("r.url").alias("rep_url"), F.col("r.source_name").alias("rep_source"))


def pick_headline(members: DataFrame, representatives: DataFrame, cfg: Config = Config()) -> DataFrame:
    """cluster_no, headline: the title closest to what members share, the representative's within 0.05 of it."""
    rows = members.select("cluster_no", "ordinal", "title", tier_score(F.col("source_tier"), cfg).alias("tier"), similarity_tokens(F.col("title")).alias("tokens"))
    sizes = rows.groupBy("cluster_no").agg(F.count("*").alias("n"))
    seen = rows.select("cluster_no", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("cluster_no", "token").agg(F.count("*").alias("df"))
    shared = seen.join(sizes, "cluster_no").filter(F.col("df") >= F.greatest(F.lit(1), F.ceil(F.col("n") / 2)))
    shared = shared.groupBy("cluster_no").agg(F.collect_set("token").alias("shared"))
    joined = rows.join(sizes, "cluster_no").join(shared, "cluster_no", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    overlap = F.when(F.size("shared") == 0, 0.0).otherwise(F.size(F.filter("tokens", lambda t: F.array_contains("shared", t))) / F.size("shared"))
    short = F.least(F.lit(1.0), F.lit(12.0) / F.greatest(F.size("tokens"), F.lit(1)))
    scored = joined.withColumn("score", overlap * 0.55 + short * 0.25 + F.col("tier") * 0.2)
    order = F.struct(F.col("score").alias("s"), (-F.col("ordinal")).alias("o"))
    best = scored.groupBy("cluster_no").agg(F.max("n").alias("n"), F.max_by("title", order).alias("best_title"), F.max("score").alias("best"))
    own = scored.join(representatives.select("cluster_no", F.col("representative").alias("ordinal"), "rep_title"), ["cluster_no", "ordinal"]).select("cluster_no", "rep_title", F.col("score").alias("own"))
    keeps = (F.col("n") == 1) | (F.col("own") >= F.col("best") - 0.05)
    return best.join(own, "cluster_no").select("cluster_no", F.when(keeps, F.col("rep_title")).otherwise(F.col("best_title")).alias("headline"))


def build_clusters(members: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for a cluster: id, representative, headline, articles newest first, sources, dates, counts."""
    reps = materialize(pick_representative(members, cfg), "representatives")
    newest = F.struct((-F.coalesce(F.unix_micros("published_at"), F.lit(0))).alias("t"), "ordinal", "url", "title", "source_name", "published_at")
    grouped = members.groupBy("topic", "cluster_no").agg(
        short_hash(F.array_join(F.array_sort(F.collect_list("canonical_url")), "|")).alias("cluster_id"),
        F.transform(F.array_sort(F.collect_list(newest)), lambda a: F.struct(a.ordinal.alias("ordinal"), a.url.alias("url"), a.title.alias("title"), a.source_name.alias("source_name"), a.published_at.alias("published_at"))).alias("articles"),
        F.array_sort(F.collect_set("source_name")).alias("sources"),
        F.min("published_at").alias("first_published_at"),
        F.max("published_at").alias("latest_published_at"),
        F.count("*").alias("article_count"),
    )
    out = grouped.join(reps, "cluster_no").join(pick_headline(members, reps, cfg), "cluster_no")
    related = F.filter("articles", lambda a: a.ordinal != F.col("representative"))
    return out.withColumns({"related": related, "source_count": F.size("sources")})


def freshness(latest: Column, now: Column, cfg: Config) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(latest)) / 3.6e9)
    return F.when(latest.isNull(), 0.15).otherwise(clamp01(F.pow(F.lit(0.5), hours / cfg.half_life_hours)))


def score_clusters(members: DataFrame, phrase: Column, now: Column, cfg: Config = Config()) -> DataFrame:
    """cluster_no, relevance, freshness, diversity, quality, importance: four parts and their weighted sum.

    Quality is the mean over a cluster's sources of their best tier, by two grouped maxima.
    """
    source = F.lower(F.trim("source_name"))
    per = members.groupBy("cluster_no", source.alias("source")).agg(F.max(tier_score(F.col("source_tier"), cfg)).alias("best"), F.max("published_at").alias("latest"), F.max(relevance(phrase, F.col("title"), F.col("snippet"))).alias("relevance"))
    by = per.groupBy("cluster_no").agg(F.max("relevance").alias("relevance"), F.max("latest").alias("latest"), F.count_if(F.col("source") != "").alias("sources"), (F.sum(F.col("best").cast("decimal(20,6)")).cast("double") / F.count("*")).alias("quality"))
    parts = by.select("cluster_no", "relevance", freshness(F.col("latest"), now, cfg).alias("freshness"), F.least(F.lit(1.0), F.col("sources") / cfg.diversity_saturation).alias("diversity"), "quality")
    total = cfg.weight_relevance + cfg.weight_freshness + cfg.weight_diversity + cfg.weight_quality
    w = [x / total for x in (cfg.weight_relevance, cfg.weight_freshness, cfg.weight_diversity, cfg.weight_quality)]
    importance = clamp01(F.col("relevance") * w[0] + F.col("freshness") * w[1] + F.col("diversity") * w[2] + F.col("quality") * w[3])
    return parts.select("cluster_no", *[round_k(F.col(c)).alias(c) for c in ("relevance", "freshness", "diversity", "quality")], round_k(importance).alias("importance"))


def assess_verification(members: DataFrame, cohesion: DataFrame, now: Column, cfg: Config = Config(), contested: DataFrame | None = None, multi: int = 2, strong: int = 3) -> DataFrame:
    """Support of each cluster by independent publishers: counts, scores, level, signals, explanation, publishers.

    ``contested``: cluster_no of clusters with attributed disagreements; they are level contested. The level is
    not tied to similarity, only confirms_event is (0.35 or more).
    """
    order = F.struct(tier_score(F.col("source_tier"), cfg).alias("q"), (-F.col("ordinal")).alias("o"))
    pubs = members.groupBy("cluster_no", "publisher_id").agg(F.max_by(F.struct(F.col("source_name").alias("name"), "source_tier"), order).alias("p"), F.max(tier_score(F.col("source_tier"), cfg)).alias("q"), F.min("ordinal").alias("o"))
    by_pub = pubs.groupBy("cluster_no").agg(
        F.count("*").alias("independent_count"),
        (F.sum(F.col("q").cast("decimal(20,6)")).cast("double") / F.count("*")).alias("quality"),
        F.transform(F.array_sort(F.collect_list(F.struct("o", "publisher_id", F.col("p.name").alias("name"), F.col("p.source_tier").alias("tier")))), lambda x: F.struct(x.publisher_id.alias("id"), x["name"].alias("name"), x.tier.alias("tier"))).alias("publishers"),
    )
    first = F.struct(F.col("published_at").isNull().alias("u"), F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), F.col("ordinal").alias("o"))
    by = members.groupBy("cluster_no").agg(F.count_distinct(F.nullif(F.trim("source_name"), F.lit(""))).alias("source_count"), F.max("published_at").alias("latest"), F.min_by("source_name", first).alias("first_reporter"))
    rows = by.join(by_pub, "cluster_no").join(cohesion, "cluster_no")
    if contested is None:
        rows = rows.withColumn("contested", F.lit(False))
    else:
        rows = rows.join(contested.select("cluster_no").distinct().withColumn("contested", F.lit(True)), "cluster_no", "left").na.fill(False, ["contested"])
    n, hot = F.col("independent_count"), F.col("contested")
    confirms = (n >= multi) & (F.col("similarity_score") >= 0.35)
    level = F.when(hot, "contested").when(n >= strong, "well_supported").when(n >= multi, "confirmed").otherwise("limited")
    label = F.when(hot, "Sources diverge").when(n >= multi, "Multiple sources").otherwise("Limited reporting")
    detail = F.when(hot, "Outlets disagree on one or more key details").when(n >= multi, F.concat(n.cast("string"), F.lit(" independent sources"))).otherwise("Only one source currently available")
    signals = F.array_compact(
        F.array(
            F.when(hot, "Sources disagree on key details"),
            F.when(n <= 1, "Currently reported by a single source").when(confirms & (n >= strong), F.concat(F.lit("Reported by "), n.cast("string"), F.lit(" independent sources"))).when(confirms, "Multiple sources confirm the event"),
            F.when(F.col("first_reporter").isNotNull(), F.concat(F.lit("First reported by "), F.col("first_reporter"))),
            F.when(F.col("source_count") > n, F.concat(F.col("source_count").cast("string"), F.lit(" named outlets mapped to "), n.cast("string"), F.lit(" independent publishers"))),
        )
    )
    return rows.select(
        "cluster_no", "source_count", "independent_count",
        round_k(F.least(F.lit(1.0), n / cfg.diversity_saturation)).alias("source_diversity"),
        round_k(freshness(F.col("latest"), now, cfg)).alias("source_recency"),
        round_k(F.col("quality")).alias("source_quality"),
        confirms.alias("confirms_event"), "first_reporter", level.alias("level"), label.alias("label"), detail.alias("detail"),
        F.when(level.isin("contested", "limited"), "warning").otherwise("check").alias("icon"), signals.alias("signals"), "publishers",
    )


def rank_stories(clusters: DataFrame, n: int) -> DataFrame:
    """The first n of each topic by importance, freshness, independent sources, sources, id."""
    w = Window.partitionBy("topic").orderBy(F.desc("importance"), F.desc("freshness"), F.desc("independent_count"), F.desc("source_count"), "cluster_id")
    return clusters.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def select_diverse_topn(stories: DataFrame, n: int, per_source: int = 2) -> DataFrame:
    """In rank order at most ``per_source`` stories of a primary source; what was put off fills up to n."""
    nth = F.row_number().over(Window.partitionBy("topic", "rep_source").orderBy("rank"))
    late = stories.withColumn("late", nth > per_source)
    w = Window.partitionBy("topic").orderBy("late", "rank")
    return late.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).drop("late")


def distinct_articles(normalized: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Rows left by exact de-duplication, and those of them left by the collapse of near-duplicate headlines of one source."""
    exact = materialize(dedupe_best_by_url(normalized), "deduped")
    after = collapse_near_duplicates(exact, cfg.near_duplicate_threshold)
    return exact, exact if after is exact else materialize(after, "collapsed")


def process_articles(normalized: DataFrame, phrase: Column, now: Column, cfg: Config = Config(), top: int | None = None) -> DataFrame:
    """The flagship: exact and near de-duplication, clusters, scores, verification, rank; one row for a story."""
    members = materialize(cluster_articles(distinct_articles(normalized, cfg)[1], cfg.cluster_threshold), "members")
    cohesion = materialize(cluster_cohesion(members), "cohesion")
    seen = assess_verification(members, cohesion, now, cfg).select("cluster_no", "independent_count", "confirms_event", "level", "first_reporter")
    whole = build_clusters(members, cfg).join(score_clusters(members, phrase, now, cfg), "cluster_no").join(cohesion, "cluster_no").join(seen, "cluster_no")
    return rank_stories(whole, top or cfg.max_stories)
