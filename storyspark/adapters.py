"""Test tables as the logical tables of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions.text import host_of, strip_html

NOW = "2024-01-31 00:00:00"
SNAPSHOT_NOW = "2024-01-20 00:00:00"
#: A phrase for each topic, so that relevance tells rows apart.
PHRASES = {"en": "that with this", "fr": "elle ment", "de": "sich keit", "es": "mente para"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now(text: str = NOW):
    return F.lit(text).cast("timestamp")


def tiers(spark: SparkSession) -> DataFrame:
    """match_kind, value, tier, ord: src0-src4 are tier 1, src5-src9 tier 2."""
    rows = [("alias", f"src{i}", 1 + i // 5, i) for i in range(10)]
    return spark.createDataFrame(rows, "match_kind string, value string, tier int, ord int")


def publishers(spark: SparkSession) -> DataFrame:
    rows = [("src0", "group-a", 0), ("src1", "group-a", 1), ("src5", "group-b", 2), ("src6", "group-b", 3)]
    return spark.createDataFrame(rows, "name string, publisher_id string, ord int")


def articles_from_documents(spark: SparkSession, sf_dir: str, url_mode: str = "content") -> DataFrame:
    """Documents as articles: 12 words of title, the next 40 as snippet, the event of the same id as time.

    ``content`` urls depend on the text, so that copies share one up to tracking parameters; ``source``
    urls are of one document each.
    """
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    mod = F.col("doc_id") % 3
    content = F.concat(F.lit("https://"), F.when(mod == 1, "www.").otherwise(""), F.lit("copy.example.com/"), F.substring(F.md5(F.col("text").cast("binary")), 1, 12), F.when(mod == 0, "?utm_source=feed").otherwise(""))
    source = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id"))
    return d.join(e, d.doc_id == e.event_id).select(
        F.col("doc_id").alias("ordinal"),
        (content if url_mode == "content" else source).alias("url"),
        F.array_join(F.slice(words, 1, 12), " ").alias("title"),
        F.array_join(F.slice(words, 13, 40), " ").alias("snippet"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("topic"),
        F.when(F.col("doc_id") % 17 != 0, F.col("ts")).alias("published_at"),
    )


def articles_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles: title and paragraphs of the html, host as source, first path segment as topic."""
    p, e = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return p.join(e, p.page_id == e.event_id).select(
        F.col("page_id").alias("ordinal"),
        "url",
        strip_html(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.substring(strip_html(F.array_join(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1), " ")), 1, 300).alias("snippet"),
        F.nullif(F.regexp_extract("html", '<img[^>]* src="(https?://[^"]*)"', 1), F.lit("")).alias("image_url"),
        host_of(F.col("url")).alias("source_name"),
        F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("topic"),
        F.col("ts").alias("published_at"),
    )


def topic_phrase(topic):
    out = F.when(F.lit(False), F.lit(""))
    for t, phrase in PHRASES.items():
        out = out.when(topic == t, F.lit(phrase))
    return F.coalesce(out, topic)
