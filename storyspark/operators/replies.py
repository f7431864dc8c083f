"""Validation of raw model replies: a valid table, and a quarantine table with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import round_k, safe_rate
from storyspark.operators.hygiene import unsafe_output

REPLY = "struct<headline:string,summary:string,whyItMatters:string,keyFacts:array<string>,entities:array<string>,confidence:string,_corrupt:string>"


def parsed_replies(raw: DataFrame) -> DataFrame:
    """raw (reply_id, provider, reply) with the parsed reply and the reason against it, if any.

    Code fences are stripped. A reply needs a headline of 1-300 characters, a summary of 1-4,000, at most 12
    facts, a confidence of low, medium or high (missing: medium), and no wording of an unsafe output.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim("reply"), r"(?is)^```(?:json)?\s*", ""), r"\s*```$", "")
    r = F.from_json(body, REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.withColumn("r", r)
    confidence = F.lower(F.coalesce("r.confidence", F.lit("medium")))
    reason = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "not JSON")
        .when(F.coalesce(F.length(F.trim("r.headline")), F.lit(0)) == 0, "missing headline")
        .when(F.length("r.headline") > 300, "headline too long")
        .when(F.coalesce(F.length(F.trim("r.summary")), F.lit(0)) == 0, "missing summary")
        .when(F.length("r.summary") > 4000, "summary too long")
        .when(F.size(F.coalesce("r.keyFacts", F.array().cast("array<string>"))) > 12, "too many facts")
        .when(~confidence.isin("low", "medium", "high"), "bad confidence")
        .when(unsafe_output(F.col("r.summary")), "unsafe output")
    )
    none = F.array().cast("array<string>")
    return rows.select(
        "reply_id", "provider", "reply", F.trim("r.headline").alias("headline"), F.trim("r.summary").alias("summary"), F.coalesce("r.whyItMatters", F.lit("")).alias("why_it_matters"),
        F.coalesce("r.keyFacts", none).alias("key_facts"), F.coalesce("r.entities", none).alias("entities"), confidence.alias("confidence"), reason.alias("reason"),
    )


def validate_model_outputs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid replies, quarantined replies with a reason)."""
    rows = parsed_replies(raw)
    return rows.filter("reason is null").drop("reason", "reply"), rows.filter("reason is not null").select("reply_id", "provider", "reply", "reason")


def error_rates(raw: DataFrame) -> DataFrame:
    by = parsed_replies(raw).groupBy("provider").agg(F.count("*").alias("n"), F.count("reason").alias("rejected"))
    return by.withColumn("rate", round_k(safe_rate(F.col("rejected"), F.col("n")), 6))
