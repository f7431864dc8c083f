"""Registered queries of summary-quality evaluation, with their check SQL: a case is a source of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark import adapters as ad
from storyspark.config import EVAL_STOP_WORDS
from storyspark.operators import evaluation as ev
from storyspark.plans import sql_parts as sq

KEYS = ["case_id", "candidate_id"]


def _docs(s, d):
    labels = ad.table(s, d, "labels")
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    return ad.table(s, d, "documents").join(labels, "doc_id").withColumn("w", words)


def articles(s, d):
    return _docs(s, d).filter("quality = 1").select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("ord"), "source", F.array_join(F.slice("w", 1, 12), " ").alias("title"),
        F.array_join(F.slice("w", 13, 1 << 30), " ").alias("description"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"), "w",
    )


def requirements(s, d):
    first = articles(s, d).groupBy("case_id").agg(F.min_by("w", "ord").alias("w"))
    long = F.filter("w", lambda x: F.length(x) > 4)
    return first.select("case_id", F.col("case_id").alias("topic"), F.slice(long, 1, 3).alias("entities"), F.slice(long, 4, 3).alias("facts"))


def candidates(s, d):
    return _docs(s, d).select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("candidate_id"), F.array_join(F.slice("w", 1, 12), " ").alias("headline"), F.col("text").alias("summary"), F.lit("").alias("why"),
        F.slice(F.split("text", r"[.!?][ \n]+"), 1, 3).alias("key_facts"), (F.col("toxic") == 1).alias("expect_hallucination"), (F.col("quality") == 0).alias("expect_unsupported"),
    )


def scored(s, d):
    return ev.score_candidates(articles(s, d), requirements(s, d), candidates(s, d))


def _rounded(df, *cols):
    return df.withColumns({c: ev.round_k(F.col(c), 6) for c in cols})


def _norm(x):
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s.$%-]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


def _toks(x):
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: length(t) > 2 AND NOT list_contains({sq.words(EVAL_STOP_WORDS)}, t))"


_ABS = r"(?i)\b(every|proves|permanently destroyed|already breached|largest .+ in history|end all competing)\b"
_BASE = rf"""
d AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents JOIN labels USING (doc_id)),
arts AS (SELECT source AS case_id, doc_id AS ord, source, array_to_string(w[1:12], ' ') AS title, source || ' ' || array_to_string(w[1:12], ' ') || ' ' || array_to_string(w[13:], ' ') || ' https://' || source || '.example.com/' || doc_id AS corpus, w FROM d WHERE quality = 1),
req AS (SELECT case_id, case_id AS topic, list_filter(w, lambda x: length(x) > 4)[1:3] AS entities, list_filter(w, lambda x: length(x) > 4)[4:6] AS facts, title FROM arts QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ord) = 1),
c0 AS (SELECT source AS case_id, doc_id AS candidate_id, text AS summary, regexp_split_to_array(text, '[.!?][ \n]+')[1:3] AS key_facts, array_to_string(w[1:12], ' ') AS headline, toxic = 1 AS expect_hallucination, quality = 0 AS expect_unsupported FROM d),
c AS (SELECT *, headline || ' ' || summary || '  ' || array_to_string(key_facts, ' ') AS text FROM c0),
ct AS (SELECT DISTINCT case_id, unnest({_toks('corpus')}) AS token FROM arts),
cn AS (SELECT *, {_norm('text')} AS norm, {_toks('text')} AS toks, regexp_extract_all({_norm('text')}, '{ev.NUMBER}') AS nums FROM c),
f AS (SELECT case_id, candidate_id, coalesce(sum(CASE WHEN ct.token IS NOT NULL THEN 1 ELSE 0 END), 0) / greatest(1, count(t.token)) AS factual FROM (SELECT case_id, candidate_id, unnest(toks) AS token FROM cn) t LEFT JOIN ct USING (case_id, token) GROUP BY ALL),
e1 AS (SELECT case_id, candidate_id, coalesce(factual, 0.0::DOUBLE) AS factual FROM cn LEFT JOIN f USING (case_id, candidate_id)),
e2 AS (SELECT case_id, candidate_id, CASE WHEN case_id IN (SELECT case_id FROM arts) THEN CASE WHEN contains(norm, {_norm('case_id')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS attribution FROM cn),
e3 AS (SELECT case_id, candidate_id, len(list_filter(entities, lambda x: contains(norm, {_norm('x')}))) / greatest(len(entities), 1) * 0.5::DOUBLE + len(list_filter(facts, lambda x: contains(norm, {_norm('x')}))) / greatest(len(facts), 1) * 0.5::DOUBLE AS completeness FROM cn JOIN req USING (case_id)),
e4 AS (SELECT case_id, candidate_id, len(list_filter(want, lambda x: contains(norm, x))) / greatest(len(want), 1) AS relevance FROM cn JOIN (SELECT case_id, list_distinct(list_concat({_toks('topic')}, {_toks('title')})) AS want FROM req) USING (case_id)),
e5 AS (SELECT case_id, candidate_id, words, CASE WHEN words < 25 THEN words / 25 WHEN words > 160 THEN 160 / words WHEN words > 120 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS conciseness FROM (SELECT *, CAST(len(list_filter(regexp_split_to_array(summary, '[ \t\n\r\f]+'), lambda w: w <> '')) AS INTEGER) AS words FROM c)),
corp AS (SELECT case_id, string_agg({_norm('corpus')}, ' ') AS corpus FROM arts GROUP BY case_id),
bn AS (SELECT case_id, candidate_id, len(nums) AS numbers, len(list_filter(nums, lambda x: NOT contains(coalesce(corpus, ''), x))) AS bad_numbers FROM cn LEFT JOIN corp USING (case_id)),
ff AS (SELECT case_id, candidate_id, fi, unnest({_toks('fact')}) AS token FROM (SELECT case_id, candidate_id, unnest(key_facts) AS fact, generate_subscripts(key_facts, 1) AS fi FROM c)),
bf AS (SELECT case_id, candidate_id, count(*) FILTER (share < 0.34) AS bad_facts FROM (SELECT case_id, candidate_id, fi, count(ct.token) / count(*) AS share FROM ff LEFT JOIN ct USING (case_id, token) GROUP BY ALL) GROUP BY ALL),
e6 AS (SELECT case_id, candidate_id, bad_numbers, bad_numbers + coalesce(bad_facts, 0) AS unsupported_claims, greatest(0.0::DOUBLE, 1.0::DOUBLE - (bad_numbers + coalesce(bad_facts, 0)) / greatest(2, len(key_facts) + numbers)) AS unsupported FROM c JOIN bn USING (case_id, candidate_id) LEFT JOIN bf USING (case_id, candidate_id)),
e7 AS (SELECT case_id, candidate_id, cues > 0 OR severe OR absolute AS flagged, CASE WHEN cues > 0 OR severe OR absolute THEN greatest(0.0::DOUBLE, 0.35::DOUBLE - cues * 0.1::DOUBLE - CASE WHEN severe THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.95::DOUBLE END AS hallucination FROM (
  SELECT cn.case_id, cn.candidate_id, len(list_filter({sq.words(ev.CUES)}, lambda x: contains(norm, x) AND NOT contains(coalesce(corpus, ''), x))) AS cues, unsupported_claims >= 2 OR bad_numbers >= 1 AS severe, regexp_matches(text, '{_ABS}') AS absolute FROM cn JOIN e6 USING (case_id, candidate_id) LEFT JOIN corp USING (case_id))),
sc AS (SELECT c.case_id, c.candidate_id, expect_hallucination, expect_unsupported, {', '.join(sq.rnd(x, 6) + ' AS ' + x for x in ev.DIMENSIONS)}, words, bad_numbers, unsupported_claims, flagged,
  {sq.rnd('(' + ' + '.join(ev.DIMENSIONS) + ') / 7', 6)} AS overall, expect_hallucination = flagged AND expect_unsupported = (unsupported_claims > 0) AS expectation_match
  FROM c JOIN e1 USING (case_id, candidate_id) JOIN e2 USING (case_id, candidate_id) JOIN e3 USING (case_id, candidate_id) JOIN e4 USING (case_id, candidate_id) JOIN e5 USING (case_id, candidate_id) JOIN e6 USING (case_id, candidate_id) JOIN e7 USING (case_id, candidate_id))"""


def _mean(x):
    return sq.rnd(f"CAST(sum(CAST({x} AS DECIMAL(20,6))) AS DOUBLE) / count(*)", 6)


_METRICS = f"count(*) AS candidates, {_mean('CAST(flagged AS INTEGER)')} AS hallucination_rate, {_mean('attribution')} AS attribution_mean, {_mean('overall')} AS score_mean, CAST(sum(unsupported_claims) AS BIGINT) AS unsupported_sum, {_mean('words')} AS length_mean, {_mean('CAST(expectation_match AS INTEGER)')} AS match_rate"


def _one(e, *cols):
    return f"WITH {_BASE} SELECT case_id, candidate_id, {', '.join((sq.rnd(c, 6) if c in ev.DIMENSIONS else c) + ' AS ' + c for c in cols)} FROM {e}"


def _runs(s, d):
    return scored(s, d).select(F.concat(F.lit("run-"), (F.col("candidate_id") % 3).cast("string")).alias("run_id"), F.timestamp_seconds(F.col("candidate_id") % 3 * 86400).alias("evaluated_at"), "overall")


QUERIES = {
    "eval_factual": (lambda s, d: _rounded(ev.eval_factual(articles(s, d), candidates(s, d)), "factual"), _one("e1", "factual")),
    "eval_attribution": (lambda s, d: _rounded(ev.eval_attribution(articles(s, d), candidates(s, d)), "attribution"), _one("e2", "attribution")),
    "eval_completeness": (lambda s, d: _rounded(ev.eval_completeness(requirements(s, d), candidates(s, d)), "completeness"), _one("e3", "completeness")),
    "eval_relevance": (lambda s, d: _rounded(ev.eval_relevance(articles(s, d), requirements(s, d), candidates(s, d)), "relevance"), _one("e4", "relevance")),
    "eval_conciseness": (lambda s, d: _rounded(ev.eval_conciseness(candidates(s, d)), "conciseness"), _one("e5", "words", "conciseness")),
    "eval_unsupported": (lambda s, d: _rounded(ev.eval_unsupported(articles(s, d), candidates(s, d)), "unsupported"), _one("e6", "bad_numbers", "unsupported_claims", "unsupported")),
    "eval_hallucination": (lambda s, d: _rounded(ev.eval_hallucination(articles(s, d), candidates(s, d), ev.eval_unsupported(articles(s, d), candidates(s, d))), "hallucination"), _one("e7", "flagged", "hallucination")),
    "score_candidates": (scored, f"WITH {_BASE} SELECT * FROM sc"),
    "eval_metrics": (lambda s, d: ev.eval_metrics(scored(s, d), ["case_id"]), f"WITH {_BASE} SELECT case_id, {_METRICS} FROM sc GROUP BY case_id"),
    "list_eval_runs": (lambda s, d: ev.list_eval_runs(_runs(s, d)), f"WITH {_BASE} SELECT 'run-' || (candidate_id % 3) AS run_id, TIMESTAMP '1970-01-01' + to_seconds(candidate_id % 3 * 86400) AS evaluated_at, count(*) AS candidates, {_mean('overall')} AS score_mean FROM sc GROUP BY candidate_id % 3"),
}
