"""Similar articles: an exact set-similarity join with rare-token prefixes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.functions.text import clamp01, containment, jaccard, significant, similarity_tokens
from storyspark.operators.components import connected_components
from storyspark.plans.cutting import materialize


#: For each column of a metric the sizes of a block's sets, or its flags.
Sides = dict[str, np.ndarray]


@dataclass(frozen=True)
class Metric:
    """columns: what a row needs; score: of two structs of them; block: tokens that a linked pair shares.

    ``overlap(threshold)``: the least share of the smaller side's block tokens that a pair at the
    threshold has in common. Two rows without block tokens meet in a block of their own.
    """

    columns: dict[str, Column]
    score: Callable[[Column, Column], Column]
    overlap: Callable[[float], float]
    #: The score of all pairs of two blocks at once, from sizes of sets and of what they share; None: only ``score``.
    matrix: Callable[[Sides, Sides, dict[str, np.ndarray]], np.ndarray] | None = None
    #: Finds pairs (a, b, score) of rows, from a table, threshold, the columns to agree in, and the id, where token sets are not what is compared.
    find: Callable[[DataFrame, float, list[str], str], DataFrame] | None = None
    #: The least score of two rows where the block tokens of the one, if there are any, all lie in the other's; None: not known.
    contained: float | None = None
    #: The score as far as the columns title and significant give it, and the most that the others add; for ``linked_components``.
    rough: Callable[[Column, Column], Column] | None = None
    rest: float = 0.0


def _shares(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard and containment of all pairs: 1 and 0 where both sets are empty, 0 where one is."""
    at = np.flatnonzero(both != 0)
    if 3 * len(at) < both.size:  # few share anything: only those are worked out
        row, col = np.divmod(at, both.shape[1])
        some, a_some, b_some = both.ravel()[at], a[row], b[col]
        jaccards, contained = np.zeros(both.shape), np.zeros(both.shape)
        jaccards.ravel()[at], contained.ravel()[at] = some / (a_some + b_some - some), some / np.minimum(a_some, b_some)
        jaccards[np.ix_(a == 0, b == 0)] = 1.0
        return jaccards, contained
    a, b = a[:, None], b[None, :]
    union, least = a + b - both, np.minimum(a, b) + 0 * both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1)), np.where(least == 0, 0.0, both / np.maximum(least, 1))


def lexical_matrix(a: Sides, b: Sides, both: dict[str, np.ndarray]) -> np.ndarray:
    """As ``lexical_score``, operation by operation."""
    jaccards, contained = _shares(a["title"], b["title"], both["title"])
    title = np.maximum(jaccards, contained * 0.92)
    jaccards, contained = _shares(a["snippet"], b["snippet"], both["snippet"])
    snippet = np.where(a["has_snippet"][:, None] | b["has_snippet"][None, :], np.maximum(jaccards, contained * 0.9), 0.0)
    telling = _shares(a["significant"], b["significant"], both["significant"])[1]
    return np.minimum(1.0, np.maximum(0.0, title * 0.7 + snippet * 0.2 + telling * 0.1))


def _title_score(a: Column, b: Column) -> Column:
    return F.greatest(jaccard(a.title, b.title), containment(a.title, b.title) * 0.92)


def lexical_score(a: Column, b: Column) -> Column:
    empty = (F.size(a.significant) == 0) | (F.size(b.significant) == 0)
    snippet = F.when(a.has_snippet | b.has_snippet, F.greatest(jaccard(a.snippet, b.snippet), containment(a.snippet, b.snippet) * 0.9)).otherwise(0.0)
    return clamp01(_title_score(a, b) * 0.7 + snippet * 0.2 + F.when(empty, 0.0).otherwise(containment(a.significant, b.significant)) * 0.1)


def headline_score(a: Column, b: Column) -> Column:
    """Without snippets: 0.8 at most."""
    empty = (F.size(a.significant) == 0) | (F.size(b.significant) == 0)
    return clamp01(_title_score(a, b) * 0.7 + F.when(empty, 0.0).otherwise(containment(a.significant, b.significant)) * 0.1)


def _tokens(title: str, snippet: str) -> dict[str, Column]:
    t = F.array_distinct(similarity_tokens(F.col(title)))
    return {"title": t, "significant": significant(t), "snippet": F.array_distinct(similarity_tokens(F.col(snippet))), "has_snippet": F.coalesce(F.col(snippet) != "", F.lit(False))}


def lexical(title: str = "title", snippet: str = "snippet") -> Metric:
    """0.7 title + 0.2 snippet + 0.1 significant title tokens. Of the rest, 0.3 at most, the title needs its share."""
    return Metric(_tokens(title, snippet), lexical_score, lambda t: max(0.0, (t - 0.3) / 0.7), lexical_matrix, contained=0.92 * 0.7, rough=headline_score, rest=0.2)


def headline(title: str = "title") -> Metric:
    t = F.array_distinct(similarity_tokens(F.col(title)))
    return Metric({"title": t, "significant": significant(t)}, headline_score, lambda t: max(0.0, (t - 0.1) / 0.7), contained=0.92 * 0.7, rough=headline_score)


def equality_key(struct: str, schema: T.StructType) -> Column:
    """Equal for rows that no score of a metric tells apart: its columns, sets in one order."""
    parts = [F.array_sort(F.col(f"{struct}.{f.name}")) if f.dataType.typeName() == "array" else F.col(f"{struct}.{f.name}") for f in schema.fields]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def copy_classes(df: DataFrame, metric: Metric, within: list[str] = ["topic"], id_col: str = "ordinal") -> DataFrame:
    """id, class (the least id of the rows of a ``within`` group that are equal to the metric), copies, and alike, the score of two of them."""
    rows = df.select(F.col(id_col).alias("id"), *within, F.struct(*[c.alias(n) for n, c in metric.columns.items()]).alias("s"))
    rows = rows.withColumn("key", equality_key("s", rows.schema["s"].dataType))
    by = rows.groupBy(*within, "key").agg(F.min("id").alias("class"), F.count("*").alias("copies"), F.first("s").alias("s"))
    by = by.select(*within, "key", "class", "copies", metric.score(F.col("s"), F.col("s")).alias("alike"))
    same = [rows[c].eqNullSafe(by[c]) for c in [*within, "key"]]
    met = rows.join(by, same[0] if len(same) == 1 else _conjunction(same))
    return met.select("id", "class", "copies", "alike")


def _conjunction(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def similar_pairs(df: DataFrame, threshold: float, metric: Metric | None = None, within: list[str] = ["topic"], id_col: str = "ordinal") -> DataFrame:
    """a, b (a < b), score: pairs of rows that agree in ``within`` and reach the threshold; exact.

    Of two linked sets the smaller one shares at least ``share`` of its tokens, so at least one of its
    rarest ``n - ceil(share n) + 1`` (Bayardo et al. 2007). Those index tokens meet the tokens of sets
    at least as large, unless their places in both sets leave too few tokens to share (Xiao et al.
    2008); frequent tokens are mostly left out. Scores are worked out once for a pair. A metric that finds pairs itself
    is asked for them, and is as exact as it says.
    """
    metric = metric or lexical()
    if metric.find is not None:
        return metric.find(df, threshold, within, id_col)
    share = metric.overlap(threshold)
    if share <= 0:
        raise ValueError("below this threshold a pair needs no common token")
    rows = materialize(df.select(F.col(id_col).alias("id"), *within, F.struct(*[c.alias(n) for n, c in metric.columns.items()]).alias("s")), "tokens")
    size = F.size("s.title")
    tokens = rows.select("id", *within, F.explode(F.when(size == 0, F.array(F.lit(""))).otherwise(F.col("s.title"))).alias("token"), F.greatest(size, F.lit(1)).alias("size"))
    frequency = tokens.groupBy(*within, "token").agg(F.count("*").alias("n"))
    counted = tokens.join(frequency, [*within, "token"])
    ordered = materialize(counted.groupBy("id", *within, "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ts")), "ordered")
    placed = ordered.select(*within, "id", "size", F.posexplode("ts.token").alias("at", "token"))
    needed = F.ceil(F.col("xs") * share - 1e-9)
    rare = placed.select(*within, "token", F.col("id").alias("x"), F.col("size").alias("xs"), F.col("at").alias("i")).filter(F.col("i") <= F.col("xs") - needed)
    every = placed.select(*within, "token", F.col("id").alias("y"), F.col("size").alias("ys"), F.col("at").alias("j"))
    smaller = (F.col("xs") < F.col("ys")) | ((F.col("xs") == F.col("ys")) & (F.col("x") < F.col("y")))
    # after the first token in common, in the one order of all sets, no more than both rests can be shared
    enough = F.least(F.col("xs") - F.col("i"), F.col("ys") - F.col("j")) >= needed
    met = rare.join(every, [*within, "token"]).filter(smaller & enough)
    # dealt once by a, for the distinct rows and the join; scores take time, so their tasks go by number and not by bytes
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).repartition(tasks, "a").distinct()
    left, right = rows.select(F.col("id").alias("a"), F.col("s").alias("sa")), rows.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("score", metric.score(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("score") >= threshold).select("a", "b", "score")


def links_by_title(metric: Metric, threshold: float) -> bool:
    """Whether ``linked_components`` can be used: rows link for sure where the title of the one holds the other's."""
    return metric.find is None and metric.rough is not None and metric.contained is not None and metric.contained >= threshold


def linked_components(df: DataFrame, threshold: float, metric: Metric | None = None, within: list[str] = ["topic"], id_col: str = "ordinal") -> DataFrame:
    """id, component: the least id that chains of linked rows of one ``within`` group reach; exact, without all pairs.

    Rows of equal titles are linked and so one class, however many there are. A title of one token links every title
    that holds it; that takes one join on tokens, and leaves most classes of a large group in one component. Pairs inside
    a component tell nothing new, so only classes outside a group's largest one are joined on all their tokens, with
    all others. Enough tokens in common leave few pairs; titles settle most of these, and only for the rest rows with
    all their columns meet. Without titles of one token every class is joined with all others. Rows with a null in ``within``
    link with none and are left out.
    """
    metric = metric or lexical()
    share = metric.overlap(threshold)
    if share <= 0 or not links_by_title(metric, threshold):
        raise ValueError("at this threshold titles don't tell which rows link")
    known = _conjunction([F.col(c).isNotNull() for c in within])
    titles = F.struct(*[F.array_sort(metric.columns[n]).alias(n) for n in ("title", "significant")])
    rows = df.filter(known).select(F.col(id_col).alias("id"), *within, titles.alias("s"))
    rows = materialize(rows.withColumn("key", equality_key("s", rows.schema["s"].dataType)), "titles")
    classes = materialize(rows.groupBy(*within, "key").agg(F.min("id").alias("class"), F.first("s").alias("s")), "classes")
    members = materialize(rows.join(classes.drop("s"), [*within, "key"]).select("id", "class"), "class_members")

    def tokens(table: DataFrame, *more: str) -> DataFrame:
        size = F.size("s.title")
        token = F.explode(F.when(size == 0, F.array(F.lit(""))).otherwise(F.col("s.title")))
        # exploded rows look as few as the table's to Spark, and must not be broadcast
        return table.select("class", *within, *more, F.greatest(size, F.lit(1)).alias("size"), token.alias("token")).hint("merge")

    single = tokens(classes).filter("size = 1").select(*within, "token", F.col("class").alias("hub"))
    first = materialize(connected_components(tokens(classes).join(single, [*within, "token"]), "class", "hub"), "first_components")
    named = classes.join(first, F.col("class") == F.col("node"), "left").select("class", *within, "s", F.coalesce("component", "class").alias("component"))
    largest = named.groupBy(*within, "component").agg(F.count("*").alias("n")).groupBy(*within).agg(F.max_by("component", "n").alias("largest"))
    placed = materialize(named.join(largest, within).withColumn("outside", F.col("component") != F.col("largest")).drop("largest"), "placed")
    every = tokens(placed, "component", "outside")
    x = every.filter("outside").select(*within, "token", F.col("class").alias("x"), F.col("size").alias("xs"), F.col("component").alias("xc"))
    y = every.select(*within, "token", F.col("class").alias("y"), F.col("size").alias("ys"), F.col("component").alias("yc"), F.col("outside").alias("too"))
    met = x.hint("merge").join(y.hint("merge"), [*within, "token"]).filter((F.col("xc") != F.col("yc")) & (~F.col("too") | (F.col("x") < F.col("y"))))
    pairs = met.groupBy("x", "y", "xs", "ys").agg(F.count("*").alias("both")).filter(F.col("both") >= F.ceil(F.least("xs", "ys") * share - 1e-9))
    left, right = placed.select(F.col("class").alias("x"), F.col("s").alias("sx")), placed.select(F.col("class").alias("y"), F.col("s").alias("sy"))
    near = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", metric.rough(F.col("sx"), F.col("sy")).alias("rough"))
    near = materialize(near.filter(F.col("rough") + metric.rest >= threshold - 1e-9), "near_classes")
    links = first.toDF("x", "y").unionByName(near.filter(F.col("rough") >= threshold).select("x", "y"))
    if metric.rest:
        unsure = near.filter(F.col("rough") < threshold).select("x", "y")
        some = members.join(unsure.select(F.col("x").alias("class")).union(unsure.select("y")).distinct(), "class", "left_semi")
        whole = df.select(F.col(id_col).alias("id"), F.struct(*[c.alias(n) for n, c in metric.columns.items()]).alias("s"))
        whole = materialize(whole.join(some, "id").select("class", "s"), "unsure_rows")
        met = unsure.join(whole.toDF("x", "sx"), "x").join(whole.toDF("y", "sy"), "y")
        links = links.unionByName(met.filter(metric.score(F.col("sx"), F.col("sy")) >= threshold).select("x", "y").distinct())
    found = connected_components(links, "x", "y")
    return members.join(found, F.col("class") == F.col("node"), "left").select("id", F.coalesce("component", "class").alias("component"))
