"""Readers of landed feed files and evaluation datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions.text import strip_html, valid_http_url


def _tag(item, name: str):
    """Text of the first such element, CDATA unwrapped."""
    raw = F.regexp_extract(item, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.btrim(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), F.lit(" \t\n\r"))


ITEM = r"(?is)(<item\b.*?</item>)"


def _link(item):
    return F.coalesce(F.nullif(_tag(item, "link"), F.lit("")), _tag(item, "guid"))


def parse_feed(files: DataFrame, max_results: int = 50) -> DataFrame:
    """Article rows out of whole RSS files (columns path and value), the first ``max_results`` valid items of each.

    The file's stem is the topic. An item without title or http(s) url is skipped. The source is its
    <source>, else what follows the last " - " of the title, which is cut off there if it equals the source.
    A weekday in pubDate is ignored, as it may be wrong; a date that can't be read is null.
    Each file is parsed by itself, so files may come as a stream.
    """
    every = F.transform(F.regexp_extract_all("value", F.lit(ITEM), 1), lambda x, i: F.struct(i.alias("position"), x.alias("item")))
    valid = F.filter(every, lambda e: (strip_html(_tag(e["item"], "title")) != "") & valid_http_url(_link(e["item"])))
    items = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("topic"), F.explode(F.slice(valid, 1, max_results)).alias("e")).select("topic", "e.*")
    i = F.col("item")
    title = strip_html(_tag(i, "title"))
    suffix = F.when(F.contains(title, F.lit(" - ")), F.trim(F.substring_index(title, " - ", -1)))
    source = F.coalesce(F.nullif(strip_html(_tag(i, "source")), F.lit("")), suffix, F.lit("Unknown"))
    html = _tag(i, "description")
    date = F.regexp_replace(_tag(i, "pubDate"), r"^\w{3},\s*", "")
    rows = items.select(
        "topic", "position", _link(i).alias("url"), title.alias("full_title"), source.alias("source_name"), suffix.alias("suffix"),
        F.nullif(F.regexp_extract(i, r'(?i)<source[^>]*\surl="([^"]*)"', 1), F.lit("")).alias("source_url"),
        F.nullif(strip_html(html), F.lit("")).alias("snippet"),
        F.nullif(F.regexp_extract(html, r'(?i)<img[^>]*\ssrc="(https?://[^"]*)"', 1), F.lit("")).alias("image_url"),
        F.coalesce(F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z"))).alias("published_at"),
    )
    bare = F.when(F.col("suffix") == F.col("source_name"), F.trim(F.left("full_title", F.length("full_title") - F.length("suffix") - 3))).otherwise(F.col("full_title"))
    return rows.select("topic", "position", "url", bare.alias("title"), "source_name", "source_url", "snippet", "image_url", "published_at")


def feed_problems(files: DataFrame) -> DataFrame:
    """path and reason of files that give no article; they don't stop the others."""
    opened = F.lower("value").rlike(r"<rss\b|<feed\b|<rdf:rdf\b") & F.lower("value").rlike(r"<channel\b")
    closed = F.size(F.regexp_extract_all("value", F.lit(ITEM), 1))
    began = F.size(F.regexp_extract_all("value", F.lit(r"(?i)(<item\b)"), 1))
    reason = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty").when(~opened, "no feed").when(began > closed, "unclosed item").when(closed == 0, "no items")
    return files.select("path", reason.alias("reason")).filter("reason is not null")


def _whole_files(reader, path: str) -> DataFrame:
    return reader.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def scan_feed_dir(spark: SparkSession, path: str, max_results: int = 50) -> DataFrame:
    """A folder of RSS files as articles."""
    return parse_feed(_whole_files(spark.read, path), max_results)


def stream_feed_dir(spark: SparkSession, path: str, max_results: int = 50, files_at_once: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(articles, problems) of a folder of RSS files, as two streams; a file is read once, when it lands.

    Spark's file source keeps which files have been read in the checkpoint, and names them in order of arrival.
    """
    reader = lambda: spark.readStream.option("maxFilesPerTrigger", files_at_once)
    return parse_feed(_whole_files(reader(), path), max_results), feed_problems(_whole_files(reader(), path))


EVAL_CASE = (
    "id string, topic string, notes string, articles array<struct<source:string,title:string,description:string,url:string,publishedAt:string>>, requiredEntities array<string>, requiredFacts array<string>, "
    "candidates array<struct<id:string,label:string,headline:string,summary:string,whyItMatters:string,keyFacts:array<string>,expectHallucination:boolean,expectUnsupported:boolean>>"
)


def read_eval_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(valid cases, rejected rows with a reason, 16 hex digits over the file's bytes) of a JSON file of cases.

    A case needs an id, a topic, articles with source, title and url, and candidates with id, headline and summary.
    """
    rows = spark.read.schema(f"{EVAL_CASE}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    has = lambda c, *names: (F.size(c) > 0) & F.forall(c, lambda x: F.lit(True) if not names else _all(x, names))
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "not JSON")
        .when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.trim("topic"), F.lit("")) == "", "no topic")
        .when(~F.coalesce(has("articles", "source", "title", "url"), F.lit(False)), "bad articles")
        .when(~F.coalesce(has("candidates", "id", "headline", "summary"), F.lit(False)), "bad candidates")
    )
    judged = rows.withColumn("reason", reason)
    digest = spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16).alias("h")).first().h
    return judged.filter("reason is null").drop("reason", "_corrupt_record"), judged.filter("reason is not null"), digest


def _all(x, names):
    out = F.lit(True)
    for n in names:
        out = out & x[n].isNotNull()
    return out
