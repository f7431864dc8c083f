"""Summary quality: candidates scored against the articles of their case.

cases' articles: case_id, ord, source, title, description, url. Requirements: case_id, topic,
entities, facts (arrays). Candidates: case_id, candidate_id, headline, summary, why, key_facts,
expect_hallucination, expect_unsupported. Every score has its own function; tokens are joined, so no
case's corpus is ever one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.config import EVAL_STOP_WORDS
from storyspark.functions.text import clamp01, round_k
from storyspark.plans.cutting import materialize

# Wording that is a cue.
CUES = ["bloomberg", "exclusive", "unnamed rival", "apt-zebra", "softbank", "sabotage", "quantum encryption"]
ABSOLUTE = r"(?i)(?<![A-Za-z0-9_])(every|proves|permanently destroyed|already breached|largest .+ in history|end all competing)(?![A-Za-z0-9_])"
NUMBER = r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?|[0-9]+%"


def eval_normalize(c: Column) -> Column:
    """Lower case; letters, numbers and ``. $ % -`` stay, all else, commas too, is a space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s.$%-]", " "), r"[ \t\n\r\f]+", " "))


def eval_tokens(c: Column) -> Column:
    return F.filter(F.split(eval_normalize(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(EVAL_STOP_WORDS))


def numbers_in(c: Column) -> Column:
    return F.regexp_extract_all(eval_normalize(c), F.lit(f"({NUMBER})"), 1)


def _corpus(articles: DataFrame) -> DataFrame:
    return articles.select("case_id", F.concat_ws(" ", "source", "title", F.coalesce("description", F.lit("")), "url").alias("corpus"))


def _text(candidates: DataFrame) -> DataFrame:
    return candidates.select("case_id", "candidate_id", F.concat_ws(" ", "headline", "summary", "why", F.array_join("key_facts", " ")).alias("text"), "key_facts", "summary")


def corpus_tokens(articles: DataFrame) -> DataFrame:
    """Distinct (case_id, token)."""
    return _corpus(articles).select("case_id", F.explode(eval_tokens(F.col("corpus"))).alias("token")).distinct()


def eval_factual(articles: DataFrame, candidates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Share of a candidate's tokens, repeats counted, that its case's articles have; 0 without tokens.

    ``known``: what ``corpus_tokens`` gives, where the caller has it.
    """
    known = corpus_tokens(articles) if known is None else known
    tokens = _text(candidates).select("case_id", "candidate_id", F.explode_outer(eval_tokens(F.col("text"))).alias("token"))
    counted = tokens.groupBy("case_id", "candidate_id", "token").agg(F.count("token").alias("n"))
    met = counted.join(known.withColumn("hit", F.lit(1)), ["case_id", "token"], "left")
    out = met.groupBy("case_id", "candidate_id").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hits"), F.sum("n").alias("n"))
    return out.select("case_id", "candidate_id", (F.col("hits") / F.greatest(F.col("n"), F.lit(1))).alias("factual"))


def eval_attribution(articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sources named in the text, against two of them, or all if fewer."""
    sources = articles.select("case_id", F.trim("source").alias("source")).distinct()
    t = _text(candidates).select("case_id", "candidate_id", eval_normalize(F.col("text")).alias("norm"))
    by = t.join(sources, "case_id", "left").groupBy("case_id", "candidate_id").agg(F.count_if(F.contains("norm", eval_normalize(F.col("source")))).alias("named"), F.count("source").alias("n"))
    return by.select("case_id", "candidate_id", F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("named") / F.least(F.col("n"), F.lit(2)))).alias("attribution"))


def eval_completeness(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Half the share of required entities, half that of facts, as substrings; an empty list gives 0."""
    t = _text(candidates).select("case_id", "candidate_id", eval_normalize(F.col("text")).alias("norm")).join(requirements, "case_id")

    def share(c: str) -> Column:
        return F.size(F.filter(c, lambda x: F.contains(F.col("norm"), eval_normalize(x)))) / F.greatest(F.size(c), F.lit(1))

    return t.select("case_id", "candidate_id", (share("entities") * 0.5 + share("facts") * 0.5).alias("completeness"))


def eval_relevance(articles: DataFrame, requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of the distinct tokens of topic and first headline that the text has, as substrings."""
    first = articles.groupBy("case_id").agg(F.min_by("title", "ord").alias("title"))
    want = requirements.join(first, "case_id", "left").select("case_id", F.array_distinct(F.concat(eval_tokens(F.col("topic")), eval_tokens(F.coalesce("title", F.lit(""))))).alias("want"))
    t = _text(candidates).select("case_id", "candidate_id", eval_normalize(F.col("text")).alias("norm")).join(want, "case_id")
    return t.select("case_id", "candidate_id", (F.size(F.filter("want", lambda w: F.contains(F.col("norm"), w))) / F.greatest(F.size("want"), F.lit(1))).alias("relevance"))


def eval_conciseness(candidates: DataFrame) -> DataFrame:
    w = F.size(F.filter(F.split("summary", r"[ \t\n\r\f]+"), lambda x: x != ""))
    score = F.when(w < 25, w / 25).when(w > 160, F.lit(160) / w).when(w > 120, 0.85).otherwise(1.0)
    return candidates.select("case_id", "candidate_id", w.alias("words"), score.alias("conciseness"))


def _number_blocks(v: Column) -> Column:
    return F.when(F.length(v) > 1, F.left(v, F.lit(2))).otherwise(v)


def unsupported_numbers(articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, candidate_id, numbers, unsupported: a number is supported where its case's corpus holds it anywhere.

    A number has no space, so it lies inside one word of the corpus; words meet numbers on the
    number's first two characters, and only distinct words with digits take part.
    """
    n = _text(candidates).select("case_id", "candidate_id", F.explode(numbers_in(F.col("text"))).alias("v"))
    words = _corpus(articles).select("case_id", F.explode(F.split(eval_normalize(F.col("corpus")), " ")).alias("w")).filter(F.col("w").rlike("[0-9]")).distinct()
    at = F.sequence(F.lit(1), F.length("w"))
    pieces = F.array_distinct(F.concat(F.transform(at, lambda i: F.substring("w", i, F.lit(2))), F.transform(at, lambda i: F.substring("w", i, F.lit(1)))))
    index = words.select("case_id", "w", F.explode(pieces).alias("block"))
    asked = n.select("case_id", "v", _number_blocks(F.col("v")).alias("block")).distinct()
    held = asked.join(index, ["case_id", "block"]).filter(F.contains("w", F.col("v"))).select("case_id", "v").distinct().withColumn("held", F.lit(True))
    met = n.join(held, ["case_id", "v"], "left")
    return met.groupBy("case_id", "candidate_id").agg(F.count("*").alias("numbers"), F.count_if(F.col("held").isNull()).alias("bad_numbers"))


def unsupported_facts(articles: DataFrame, candidates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """case_id, candidate_id, bad_facts: key facts with under 34 % of their tokens in the case's articles."""
    known = corpus_tokens(articles) if known is None else known
    facts = candidates.select("case_id", "candidate_id", F.posexplode("key_facts").alias("f", "fact"))
    tokens = facts.select("case_id", "candidate_id", "f", F.explode(eval_tokens(F.col("fact"))).alias("token"))
    met = tokens.join(known.withColumn("hit", F.lit(1)), ["case_id", "token"], "left")
    by = met.groupBy("case_id", "candidate_id", "f").agg((F.count("hit") / F.count("*") < 0.34).alias("bad"))
    return by.groupBy("case_id", "candidate_id").agg(F.count_if("bad").alias("bad_facts"))


def eval_unsupported(articles: DataFrame, candidates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Numbers and facts without support, and 1 less their share of all (of two at least)."""
    rows = candidates.select("case_id", "candidate_id", F.size("key_facts").alias("facts"))
    keys = ["case_id", "candidate_id"]
    rows = rows.join(unsupported_numbers(articles, candidates), keys, "left").join(unsupported_facts(articles, candidates, known), keys, "left").na.fill(0)
    claims = F.col("bad_numbers") + F.col("bad_facts")
    return rows.select(*keys, "bad_numbers", claims.alias("unsupported_claims"), clamp01(F.lit(1.0) - claims / F.greatest(F.lit(2), F.col("facts") + F.col("numbers"))).alias("unsupported"))


def eval_hallucination(articles: DataFrame, candidates: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Flag and score: cues that the corpus lacks, unsupported claims, absolute wording."""
    norm = _corpus(articles).select("case_id", eval_normalize(F.col("corpus")).alias("norm"))
    known = norm.groupBy("case_id").agg(*[F.max(F.contains("norm", F.lit(c))).alias(f"k{i}") for i, c in enumerate(CUES)])
    t = _text(candidates).select("case_id", "candidate_id", "text", eval_normalize(F.col("text")).alias("norm")).join(known, "case_id", "left").join(unsupported, ["case_id", "candidate_id"])
    cues = sum((F.when(F.contains("norm", F.lit(c)) & ~F.coalesce(f"k{i}", F.lit(False)), 1).otherwise(0) for i, c in enumerate(CUES)), F.lit(0))
    severe = (F.col("unsupported_claims") >= 2) | (F.col("bad_numbers") >= 1)
    flagged = (cues > 0) | severe | F.col("text").rlike(ABSOLUTE)
    return t.select("case_id", "candidate_id", flagged.alias("flagged"), F.when(flagged, clamp01(F.lit(0.35) - cues * 0.1 - F.when(severe, 0.15).otherwise(0.0))).otherwise(0.95).alias("hallucination"))


DIMENSIONS = ["factual", "attribution", "completeness", "relevance", "conciseness", "unsupported", "hallucination"]


def score_candidates(articles: DataFrame, requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """All seven scores, their mean, and whether both expectations were met."""
    keys = ["case_id", "candidate_id"]
    # three scores need the articles' tokens, and two the unsupported claims: both are worked out once
    known = materialize(corpus_tokens(articles), "corpus-tokens")
    u = materialize(eval_unsupported(articles, candidates, known), "unsupported")
    out = candidates.select(*keys, "expect_hallucination", "expect_unsupported")
    for part in (eval_factual(articles, candidates, known), eval_attribution(articles, candidates), eval_completeness(requirements, candidates), eval_relevance(articles, requirements, candidates), eval_conciseness(candidates), u, eval_hallucination(articles, candidates, u)):
        out = out.join(part, keys)
    overall = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])) / len(DIMENSIONS)
    match = (F.col("expect_hallucination") == F.col("flagged")) & (F.col("expect_unsupported") == (F.col("unsupported_claims") > 0))
    return out.withColumns({"overall": round_k(overall, 6), "expectation_match": match} | {d: round_k(F.col(d), 6) for d in DIMENSIONS})


def eval_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates and means over scored candidates; one row of zeros for an empty table without ``by``."""

    def mean(c: Column) -> Column:
        return round_k(F.coalesce(F.try_divide(F.sum(c.cast("decimal(20,6)")).cast("double"), F.count("*")), F.lit(0.0)), 6)

    return scored.groupBy(*by).agg(
        F.count("*").alias("candidates"), mean(F.col("flagged").cast("int")).alias("hallucination_rate"), mean(F.col("attribution")).alias("attribution_mean"), mean(F.col("overall")).alias("score_mean"),
        F.coalesce(F.sum("unsupported_claims"), F.lit(0)).alias("unsupported_sum"), mean(F.col("words")).alias("length_mean"), mean(F.col("expectation_match").cast("int")).alias("match_rate"),
    )


def list_eval_runs(results: DataFrame) -> DataFrame:
    """run_id, evaluated_at, candidates, score_mean over all rows, newest first."""
    by = results.groupBy("run_id").agg(F.max("evaluated_at").alias("evaluated_at"), F.count("*").alias("candidates"), round_k(F.sum(F.col("overall").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("score_mean"))
    return by.orderBy(F.desc("evaluated_at"), "run_id")
