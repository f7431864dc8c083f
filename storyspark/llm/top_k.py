"""Exact top-k inner products by norm buckets.

Vectors are grouped by length, in bands of a fixed ratio (Teflioudi et al. 2015). A query first gets
a lower bound of its k-th best product from the longest vectors. It then goes only to bands whose
longest vector could still reach that bound, cut into blocks of a bounded number of vectors. Queries
come in blocks too, by the length that their bound asks for, and a vector is sent only to blocks of
queries that can reach its band; every group that one task holds is bounded, however many vectors
share a length or a value. Inside a group the bound becomes a local cosine threshold: a high one makes ranges
for the query's largest coordinates that a candidate must lie in, a low one leaves pruning by length.
Whatever remains is verified by exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm.common import table
from storyspark.plans.cutting import materialize

#: Vectors and queries in a block, vectors that give the first bounds; bands for a doubling of the squared length.
BLOCK, QUERY_BLOCK, PROBES, BANDS = 4096, 4096, 2048, 4
#: From this local cosine on, coordinates prune; so many of the query's largest ones.
COORDINATE_COSINE, FOCUS = 0.35, 3


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products; outside of long, the nearest long."""
    if not len(q) or not len(p):
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    exact = [np.array([[int(x) for x in row] for row in m], object) for m in (q, p)]
    whole = exact[0] @ exact[1].T
    return np.array([[min(max(int(x), -(2**63)), 2**63 - 1) for x in row] for row in whole], np.int64).reshape(whole.shape)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search_group(q: np.ndarray, q_rows: np.ndarray, bounds: np.ndarray, p: np.ndarray, p_ids: np.ndarray, p_rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its position, and ids, rows and scores of the k best of one block, but for its own row, that reach its bound."""
    p_norm, q_norm = np.sqrt((p.astype(float) ** 2).sum(axis=1)), np.sqrt((q.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-p_norm, kind="stable")
    p, p_ids, p_rows, p_norm = p[order], p_ids[order], p_rows[order], p_norm[order]
    unit = p / np.maximum(p_norm, 1e-300)[:, None]
    slack = 1 + 1e-9  # bounds are doubles: keep what lies on them
    for i in range(len(q)):
        reach = q_norm[i] * p_norm[0]
        bound = bounds[i]
        if bound > reach * slack:
            continue
        if bound > 0 and bound / reach >= COORDINATE_COSINE:
            cosine = min(1.0, bound / reach)
            u = q[i] / q_norm[i]
            keep = np.ones(len(p), bool)
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - u[f] * u[f])))
                # a unit vector at cosine c or more has its coordinate within the cap's range
                low = -1.0 if -u[f] >= cosine else u[f] * cosine - spread
                high = 1.0 if u[f] >= cosine else u[f] * cosine + spread
                keep &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
            at = np.flatnonzero(keep)
        elif bound > 0:
            at = np.arange(np.searchsorted(-p_norm * q_norm[i] * slack, -bound, side="right"))
        else:
            at = np.arange(len(p))
        at = at[p_rows[at] != q_rows[i]]
        scores = products(q[i : i + 1], p[at])[0]
        top = best(scores, p_ids[at], k)
        top = top[scores[top] >= bound]
        if len(top):
            yield i, p_ids[at][top], p_rows[at][top], scores[top]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of floor(256 x) as double) and norm2 of the rows that take part; repeats of an id with its vector once."""
    x = F.col("v").cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))))
    rows = rows.select("id", F.transform(x, lambda e: F.floor(e * 256).cast("double")).alias("v"))
    return rows.distinct().withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))


def _band(norm2: Column) -> Column:
    return F.floor(F.log2(F.greatest(norm2, F.lit(1.0))) * BANDS).cast("int")


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy().reshape(len(col), -1)


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, id, score: the k highest inner products of each query with all rows but its own.

    ``queries`` marks the rows that ask (a condition on ``id``). Null vectors, empty ones and those
    with null or non-finite components take no part; products are taken within one dimension.
    Rows that share an id with different vectors are rows of their own, as candidates and as queries (each such query has
    its ranks); exact repeats count once. An empty table gives an empty result.
    """
    rows = integer_vectors(vectors, id_col, vector_col).withColumns({"dim": F.size("v"), "band": _band(F.col("norm2")), "row": F.monotonically_increasing_id()})
    rows = materialize(rows, "vectors")
    parts = []
    for dim in [r.dim for r in rows.select("dim").distinct().collect()]:  # as many jobs as there are dimensions
        parts.append(_one_dimension(rows.filter(F.col("dim") == dim), queries, k))
    empty = "query_id long, rank int, id long, score long"
    if not parts:
        return rows.sparkSession.createDataFrame([], empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_dimension(rows: DataFrame, queries: Column, k: int) -> DataFrame:
    spark = rows.sparkSession
    probe = rows.orderBy(F.desc("norm2"), "id").limit(PROBES).select("row", "v").toPandas()  # a fixed number of rows
    probe_rows, probe_v = probe["row"].to_numpy(), np.stack(probe["v"].to_numpy())

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, q = b.column("row").to_numpy(), _rows(b, "v")
            s = products(q, probe_v).astype(float)
            s[own[:, None] == probe_rows[None, :]] = -np.inf
            kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)
            kth = np.where(np.isfinite(kth), np.floor(kth - np.abs(kth) * 1e-15), -np.inf)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("v"), b.column("norm2"), pa.array(kth)], names=["query", "query_id", "q", "q_norm2", "bound"])

    asked = materialize(rows.filter(queries).select("row", "id", "v", "norm2").mapInArrow(first_bounds, "query long, query_id long, q array<double>, q_norm2 double, bound double"), "queries")
    # at most BANDS * 2048 bands exist for doubles, of vectors and of the lengths that queries ask for
    need = F.col("bound") / F.sqrt("q_norm2")
    asked = asked.withColumn("need", F.when((F.col("bound") > 0) & (F.col("q_norm2") > 0), _band(need * need)).otherwise(-1))
    bands = rows.groupBy("band").agg(F.count("*").alias("n"), F.max("norm2").alias("longest")).collect()
    needs = asked.groupBy("need").agg(F.count("*").alias("n"), F.min(F.when(F.col("need") < 0, 0.0).otherwise(need)).alias("least")).collect()
    meet = [(b.band, -(-b.n // BLOCK), float(b.longest), a.need, -(-a.n // QUERY_BLOCK)) for b in bands for a in needs if a.least <= math.sqrt(b.longest) * (1 + 1e-9)]
    if not meet:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    plan = F.broadcast(spark.createDataFrame(meet, "band int, blocks int, longest double, need int, query_blocks int"))
    block, query_block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int")
    candidates = rows.select("band", "row", "id", "v").join(plan, "band").select("band", "need", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "row", "id", "v")
    sent = asked.join(plan, "need").filter(F.col("bound") <= F.sqrt("q_norm2") * F.sqrt("longest") * (1 + 1e-9))
    sent = sent.select("band", "need", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), query_block.alias("query_block"), "query", "query_id", "q", "bound")

    def group(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "query_id": [], "id": [], "row": [], "score": []}
        if len(q) and len(p):
            q_rows, q_ids = q["query"].to_numpy(), q["query_id"].to_numpy()
            for i, ids, found, scores in search_group(np.stack(q["q"].to_numpy()), q_rows, q["bound"].to_numpy(), np.stack(p["v"].to_numpy()), p["id"].to_numpy(), p["row"].to_numpy(), k):
                out["query"] += [q_rows[i]] * len(ids)
                out["query_id"] += [q_ids[i]] * len(ids)
                out["id"] += ids.tolist()
                out["row"] += found.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    keys = ["band", "need", "block", "query_block"]
    found = sent.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(group, T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "id", "row", "score")]))
    # the k best of all blocks: sorted short lists, merged before and after the shuffle
    listed = found.groupBy("query", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "row", "score"))), 1, k).alias("top"))
    out = listed.select("query_id", F.posexplode("top").alias("at", "t"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("id"), F.col("t.score").alias("score"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERY = ("op2_top_k", op2_top_k)
