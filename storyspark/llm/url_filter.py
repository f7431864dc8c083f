"""URL filters: host and path rules, then a tree of path templates for each host.

The path's segments make a tree under their host. From the top down, a segment becomes a wildcard
where it varies (wholly a shape of digits or hexadecimal digits, or children that are nearly all
different). The other children of a node are ordered by their labelled share of good pages; two
neighbours in that order belong to one branch unless their shares differ statistically, so that
similar branches merge and different ones stay apart. What is left are templates; a template is
rejected where the share of its labelled pages that are good, smoothed towards the share of all
labelled pages, is too low.

The tree is grown over distinct shaped paths with their counts, a table that Spark has grouped
first; its levels are grouped sums and equi-joins, and children with equal counts are compared once,
so no host is ever held by one task. Levels are added until no path that still shares its branch with
another one has a further segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyspark.llm.common import table
from storyspark.plans.cutting import materialize


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))
#: Segments that are wholly a shape.
SHAPES = ("{n}", "{x}")
#: A node with so many different children, of which so large a share of its paths is of its own, varies.
MANY, SINGLE_SHARE = 8, 0.5
#: Neighbours merge whose shares differ by no more than so many standard errors; labelled pages that a child needs for it.
Z, LEAST_TESTED = 1.96, 5
#: Pseudo-count of the prior, labelled pages that a template needs, share of good pages below which it goes.
PRIOR, LEAST_LABELLED, LEAST_GOOD = 10.0, 20, 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls; a rule fits its host and all subdomains."""
    text, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = text.when(fits, F.lit(r.text)), verdict.when(fits, F.lit(r.verdict))
    return text, verdict


def shaped(path: Column) -> Column:
    """Segments of a path, digits and long hexadecimal words replaced by their kind."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F]{12,}", "{x}"), "[0-9]+", "{n}"))


def similar_branches(tested: DataFrame) -> DataFrame:
    """host, template, known, good, branch: which children of a node merge, from (host, template, seg, known, good).

    branch is null where a child stays alone, "*" where all children of the node are alike, else "*" and
    the place of the group in the order of shares. The test is that of two proportions; it links
    neighbours, so the ends of a long chain may differ. Children with equal counts are one row, so a
    node with n labelled pages has in the order of n ** (2 / 3) rows at most.
    """
    share = F.col("good") / F.col("known")
    counts = tested.groupBy("host", "template", "known", "good").agg(F.count("*").alias("children"))
    node = Window.partitionBy("host", "template")
    order = node.orderBy(share, "known", "good")
    before_known, before_good = F.lag("known").over(order), F.lag("good").over(order)
    pooled = (F.col("good") + before_good) / (F.col("known") + before_known)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("known") + 1 / before_known))
    cut = F.coalesce((share - before_good / before_known > Z * error).cast("int"), F.lit(0))
    placed = counts.withColumn("cut", cut).withColumn("place", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sized = placed.withColumns({"last": F.max("place").over(node), "members": F.sum("children").over(Window.partitionBy("host", "template", "place"))})
    branch = F.when(F.col("last") == 0, "*").when(F.col("members") > 1, F.concat(F.lit("*"), (F.col("place") + 1).cast("string")))
    return sized.select("host", "template", "known", "good", branch.alias("branch"))


def grow_templates(pages: DataFrame) -> DataFrame:
    """(host, shape) to template, from columns host, shape, good (1, 0 or null) of all pages."""
    spark = pages.sparkSession
    shapes = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("good").alias("known"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    now = materialize(shapes.withColumns({"template": F.lit(""), "open": F.size("shape") > 0}), "shapes")
    levels = [now]
    while not now.filter("open").isEmpty():
        level = len(levels)
        here = now.filter("open").withColumn("seg", F.get("shape", F.lit(level - 1)))
        sums = here.groupBy("host", "template", "seg").agg(F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("good").alias("good"))
        node = sums.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("paths").alias("all_paths"), F.sum("n").alias("all_n"))
        varies = ((F.col("children") >= MANY) & (F.col("children") > SINGLE_SHARE * F.col("all_n"))) | F.col("seg").isin(*SHAPES)
        both = materialize(sums.join(node, ["host", "template"]).withColumn("tested", ~varies & (F.col("known") >= LEAST_TESTED)), "branches")
        tested = both.filter("tested")
        named = tested.join(similar_branches(tested), ["host", "template", "known", "good"]).withColumn("branch", F.coalesce("branch", "seg"))
        branches = named.unionByName(both.filter("not tested").withColumn("branch", F.lit("*")))
        chosen = branches.select("host", "template", "seg", F.concat("template", F.lit("/"), "branch").alias("grown"), (F.col("all_paths") == 1).alias("alone"))
        step = here.join(chosen, ["host", "template", "seg"])
        # a path alone in its node is like itself at each further level
        rest = F.when(F.col("alone"), F.repeat(F.lit("/*"), F.size("shape") - level)).otherwise("")
        step = step.select("host", "shape", "n", "known", "good", F.concat("grown", rest).alias("template"), (~F.col("alone") & (F.size("shape") > level)).alias("open"))
        now = materialize(step, "shapes")
        levels.append(now)
    whole = spark.read.schema(now.schema).parquet(*[x._storyspark_path for x in levels])
    return whole.filter(~F.col("open")).drop("open")


def reject_templates(grown: DataFrame) -> DataFrame:
    """host, template, n, known, purity (smoothed share of good pages) and rejected, for each template."""
    by = grown.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("good").alias("good"))
    total = grown.agg(F.try_divide(F.sum("good"), F.sum("known")).alias("base"))
    purity = (F.col("good") + PRIOR * F.coalesce("base", F.lit(1.0))) / (F.col("known") + PRIOR)
    out = by.crossJoin(F.broadcast(total)).withColumn("purity", purity)  # one row of totals
    return out.select("host", "template", "n", "known", "purity", ((F.col("known") >= LEAST_LABELLED) & (F.col("purity") < LEAST_GOOD)).alias("rejected"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    Labels (doc_id, quality) go with pages by page_id; several of one page count as their mean,
    rounded down. A null url, or one without ``://``, has empty host and path, fits no rule and is
    judged by the template of the empty host. Repeated rows are judged alike and counted each; a
    null page_id is kept and has no label. Unlabelled children, and those with too few labelled pages
    for a test, share their node's wildcard.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("page_id")).agg(F.floor(F.avg("quality")).cast("int").alias("good"))
    rows = materialize(rows.join(marks, "page_id", "left").withColumn("shape", shaped(F.col("path"))), "pages")
    grown = grow_templates(rows)
    known = materialize(grown.join(reject_templates(grown).select("host", "template", "purity", "rejected"), ["host", "template"]).select("host", "shape", "template", "purity", "rejected"), "templates")
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.join(known, ["host", "shape"], "left")
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERY = ("op10_url_filter", op10_url_filter)
