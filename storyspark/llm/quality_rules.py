"""Quality rules: a learned decision list.

Sequential covering: conjunctions of thresholds on document statistics are grown one condition at a
time by information gain, pruned from their end on rows that growing has not seen, and kept while
they stay precise; the rows that a rule covers leave, and the next rule is learned from the rest
(Cohen 1995). The list is ordered Spark conditional expressions over statistics columns, so applying
it stays inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm import statistics
from storyspark.llm.common import map_text, table, training_labels

#: Labelled rows to learn from, at most; the first in the order of a hash of the id.
MAX_EXAMPLES = 20_000


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, "<=" or ">", threshold) hold: the document goes."""

    conditions: tuple[tuple[str, str, float], ...]

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.conditions:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            out = out & (F.col(name) <= F.lit(t) if op == "<=" else F.col(name) > F.lit(t))
        return out


def features(df: DataFrame) -> DataFrame:
    """Adds the shares that rules may test; 0 where there is no word or line."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines", "word_chars"))
    return df.withColumns(
        {
            "words": F.col("n_words").cast("double"),
            "chars_per_word": F.col("word_chars") / words,
            "symbol_share": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("n_upper") / chars,
            "digit_share": F.col("n_digits") / chars,
            "mark_share": F.col("n_marks") / words,
            "distinct_share": F.col("n_distinct") / words,
            "short_share": F.col("n_short") / words,
            "words_per_line": F.col("n_words") / lines,
        }
    )


FEATURES = ["words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "short_share", "words_per_line"]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if n0 == 0 or p0 == 0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        y = bad[inside]
        for name in FEATURES:
            v = x[name][inside]
            order = np.argsort(v, kind="stable")
            v, hits = v[order], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])  # conditions lie halfway between neighbouring values
            below_p, below = hits[cut], cut + 1
            for op, p, n in (("<=", below_p, below), (">", p0 - below_p, len(v) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), -1.0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= Rule((best[1],)).matches(x)
    return rule


def _precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """Share of covered rows that are bad, smoothed by one of each; bad rows covered."""
    m = rule.matches(x)
    p = int((m & bad).sum())
    return (p + 1) / (int(m.sum()) + 2), p


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, least_covered: int = 3, most_conditions: int = 4, most_rules: int = 24) -> list[Rule]:
    """The ordered list; empty where nothing is precise enough. Every third row is for pruning."""
    held = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (left & bad & ~held).sum() >= least_covered:
        grow, prune = left & ~held, left & held
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        xp, bp = {k: v[prune] for k, v in x.items()}, bad[prune]
        scored = [(_precision(Rule(tuple(conditions[:k])), xp, bp), -k, Rule(tuple(conditions[:k]))) for k in range(1, len(conditions) + 1)]
        if not scored:
            break
        (precision, covered), _, rule = max(scored, key=lambda s: s[:2])
        if precision < least_precision or covered < least_covered:
            break
        rules.append(rule)
        left &= ~rule.matches(x)
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """1, 2, ... for the first rule that holds, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(k))
    return out.cast("int")


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    return map_text(docs, text_col, keep, statistics.FIELDS, statistics.start)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_quality_rules(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> list[Rule]:
    """Rules that reject, learned from documents that pass the base rules and have a label 0 or 1.

    Reads at most ``max_examples`` labels of rows outside the held-out fold; that many small rows
    are joined by broadcast and come to the driver.
    """
    sample = F.broadcast(training_labels(labels, "quality", max_examples))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = features(with_statistics(ids.join(sample, "doc_id"), ["doc_id", "y"])).filter(~base_failed()).select("doc_id", "y", *FEATURES).toPandas()
    rows = rows.sort_values(["doc_id", "y", *FEATURES], kind="stable").drop_duplicates()
    if rows.empty:
        return []
    return learn_rules({n: rows[n].to_numpy(float) for n in FEATURES}, rows["y"].to_numpy() == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """``keep`` columns of every row with its statistics, base_failed, rule (the first that rejects) and kept.

    Null text counts as empty: no words, so base_failed. Repeated rows and rows with a null id are
    judged one by one. Without usable labels there are no rules and only the base ones reject.
    """
    rules = fit_quality_rules(docs, labels, max_examples)
    out = features(with_statistics(docs, keep or ["doc_id"]))
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", decision_list(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*FEATURES)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERY = ("op1_quality_rules", op1_quality_rules)
