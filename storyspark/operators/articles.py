"""Articles: normalising, filters, exact de-duplication, source quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.config import Config
from storyspark.functions.text import canonical_url, headline_ascii, host_of, normalize_topic, safe_rate, topic_tokens, valid_http_url, round_k


def tier_score(tier: Column, cfg: Config) -> Column:
    one, two, three = cfg.tier_scores
    return F.when(tier == 1, one).when(tier == 2, two).otherwise(three)


def _first_by_order(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct("ord", value), "ord").alias("v"))


def _lookup(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row: the table as a map from key to (ord, value). For configuration tables only."""
    entries = _first_by_order(df, key, value).agg(F.map_from_entries(F.collect_list(F.struct(key, "v"))).alias(name))
    return F.broadcast(entries)


def suffixes(host: Column) -> Column:
    """a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def resolve_sources(df: DataFrame, tiers: DataFrame, publishers: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds source_tier (a set one stays), publisher_id, source_quality.

    Tier: host as listed, else the first listed domain that the host is under, else the source's
    name as listed, else 3. Publisher: by name, by host, by domain in the order listed, else the
    host, the name, "unknown". The two tables are configuration and travel as one row of maps.
    """
    host, name = host_of(F.col("url")), F.lower(F.trim("source_name"))
    t = tiers.filter(F.col("match_kind") == "domain").select(F.col("value").alias("k"), "tier", "ord")
    a = tiers.filter(F.col("match_kind") == "alias").select(F.col("value").alias("k"), "tier", "ord")
    p = publishers.select(F.lower("name").alias("k"), "publisher_id", "ord")
    out = df.crossJoin(_lookup(t, "k", "tier", "m_domain")).crossJoin(_lookup(a, "k", "tier", "m_alias")).crossJoin(_lookup(p, "k", "publisher_id", "m_pub"))

    def under(m: str) -> Column:
        return F.array_min(F.filter(F.transform(suffixes(host), lambda s: F.element_at(m, s)), lambda v: v.isNotNull()))

    tier = F.coalesce("source_tier" if "source_tier" in df.columns else F.lit(None).cast("int"), F.element_at("m_domain", host).tier, under("m_domain").tier, F.element_at("m_alias", name).tier, F.lit(3))
    publisher = F.coalesce(F.element_at("m_pub", name).publisher_id, F.element_at("m_pub", host).publisher_id, under("m_pub").publisher_id, F.nullif(host, F.lit("")), F.nullif(name, F.lit("")), F.lit("unknown"))
    out = out.withColumns({"source_tier": tier.cast("int"), "publisher_id": publisher}).drop("m_domain", "m_alias", "m_pub")
    return out.withColumn("source_quality", tier_score(F.col("source_tier"), cfg))


def normalize_articles(articles: DataFrame, tiers: DataFrame, publishers: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows with a title and an http(s) url, trimmed, with canonical_url, normalized_title, tier and publisher.

    A blank snippet becomes null, a blank or null source "Unknown".
    """
    rows = articles.withColumns({"title": F.trim("title"), "url": F.trim("url")})
    rows = rows.filter((F.col("title") != "") & valid_http_url(F.col("url")))
    rows = rows.withColumns(
        {
            "canonical_url": canonical_url(F.col("url")),
            "snippet": F.nullif(F.trim("snippet"), F.lit("")),
            "source_name": F.coalesce(F.nullif(F.trim("source_name"), F.lit("")), F.lit("Unknown")),
            "normalized_title": headline_ascii(F.col("title")),
        }
    )
    return resolve_sources(rows, tiers, publishers, cfg)


def filter_recency(df: DataFrame, now: Column, hours: int, ts: str = "published_at") -> DataFrame:
    """Rows of the last ``hours``; undated and future rows stay."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= now - F.make_interval(hours=F.lit(hours))))


def relevance(phrase: Column, title: Column, snippet: Column) -> Column:
    """Share of the phrase's tokens in title and snippet, as substrings; 1 where the phrase has none."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(snippet, F.lit(""))))
    tokens = topic_tokens(phrase)
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(F.filter(tokens, lambda t: F.contains(text, t))) / F.size(tokens))


def filter_relevance_gate(df: DataFrame, phrase: Column, topic_col: str = "topic") -> DataFrame:
    """Relevant rows of a topic where they are at least half (rounded up) of it, else all its rows."""
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("snippet", F.lit(""))))
    whole = normalize_topic(phrase)
    relevant = (whole == "") | F.contains(text, whole) | (relevance(phrase, F.col("title"), F.col("snippet")) > 0)
    rows = df.withColumn("__relevant", relevant)
    by = rows.groupBy(topic_col).agg((F.count_if("__relevant") >= F.ceil(F.count("*") / 2)).alias("__gate"))
    # the grouped counts are joined back rather than windowed: a topic with a third of all rows stays split
    joined = rows.join(by.withColumnRenamed(topic_col, "__topic"), F.col(topic_col).eqNullSafe(F.col("__topic")))
    return joined.filter(~F.col("__gate") | F.col("__relevant")).select(*df.columns)


def latest_articles(df: DataFrame, k: int, topic_col: str = "topic") -> DataFrame:
    """The newest k of each topic; undated rows count as the oldest, ties go by ordinal."""
    at = F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp"))
    w = Window.partitionBy(topic_col).orderBy(at.desc(), "ordinal")
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def dedupe_first_seen(df: DataFrame) -> DataFrame:
    """The row of least ordinal for each canonical url, else url."""
    key = F.coalesce("canonical_url", "url") if "canonical_url" in df.columns else F.coalesce(canonical_url(F.col("url")), "url")
    best = df.groupBy(key.alias("__k")).agg(F.min_by(F.struct(*df.columns), "ordinal").alias("r"))
    return best.select("r.*")


def dedupe_best_by_url(df: DataFrame) -> DataFrame:
    """One row for each canonical url: best tier, longest snippet, latest, first."""
    order = F.struct(
        F.col("source_quality").alias("q"), F.length(F.coalesce("snippet", F.lit(""))).alias("l"), F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), (-F.col("ordinal")).alias("o")
    )
    return df.groupBy("canonical_url").agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def ingest_articles(sources: dict[str, DataFrame], phrase: Column, now: Column, cfg: Config = Config()) -> DataFrame:
    """Union of the providers, first rows by url, recency, relevance gate, newest of each topic."""
    rows, _ = union_sources(sources)
    rows = filter_recency(dedupe_first_seen(rows), now, cfg.recency_hours)
    return latest_articles(filter_relevance_gate(rows, phrase), cfg.max_articles)


def union_sources(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(articles with their provider, provider status with row counts); a provider without rows is listed too."""
    spark = next(iter(sources.values())).sparkSession
    out = None
    for name, df in sources.items():
        part = df.withColumn("provider", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    names = spark.createDataFrame([(n,) for n in sources], "provider string")
    counts = out.groupBy("provider").agg(F.count("*").alias("n"))
    status = names.join(counts, "provider", "left").select("provider", F.coalesce("n", F.lit(0)).alias("articles"), F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"))
    return out, status


def dedupe_stats(normalized: DataFrame, exact: DataFrame, after: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per topic: rows after each step, what went, clusters, compression ratio."""

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("topic").agg(F.count("*").alias(name))

    out = n(normalized, "after_normalize").join(n(exact, "after_exact"), "topic", "left").join(n(after, "after_dedupe"), "topic", "left").join(n(clusters, "clusters"), "topic", "left").na.fill(0)
    return out.select(
        "topic",
        "after_normalize",
        (F.col("after_normalize") - F.col("after_exact")).alias("exact_removed"),
        (F.col("after_exact") - F.col("after_dedupe")).alias("near_removed"),
        "after_dedupe",
        "clusters",
        F.greatest(F.lit(0), F.col("after_dedupe") - F.col("clusters")).alias("collapsed"),
        F.when(F.col("after_normalize") == 0, 1.0).otherwise(round_k(safe_rate(F.col("clusters"), F.col("after_normalize")), 3)).alias("compression_ratio"),
    )
