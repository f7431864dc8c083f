"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and towards the pooled one
(Friedman 1989). A score is the logistic of the difference of the Gaussian log densities plus the
log prior odds; Mahalanobis distances come from Cholesky factors worked out once. The sums that
means and covariances need are grouped in Spark over all labelled rows, so the driver sees a few
hundred numbers, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm import statistics
from storyspark.llm.common import fold, map_text, table, training_labels
from storyspark.plans.cutting import materialize

DIM = 10
VECTOR = T.StructType([T.StructField("x", T.ArrayType(T.FloatType()))])


def transform(counts: np.ndarray) -> np.ndarray:
    """Rows of statistics (order of statistics.NAMES) as roots and logarithms of shares."""
    c = counts.astype(float).T
    words, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct, short = c
    w, ch, ln = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack(
        [np.log1p(words), np.log1p(chars / w), np.sqrt(symbols / w), np.sqrt(dup / ln), np.sqrt(repeat / w), np.sqrt(upper / ch), np.sqrt(digits / ch), np.sqrt(marks / w), np.log1p(w - distinct) - np.log1p(w), np.sqrt(short / w)]
    )


def _start():
    def work(texts: list[str]) -> list[pa.Array]:
        x = transform(np.array([statistics.of_text(t) for t in texts], dtype=np.int64)).astype(np.float32)
        return [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * DIM, pa.array(x.ravel()))]

    return work


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # 2 x DIM
    factors: np.ndarray  # 2 x DIM x DIM, lower Cholesky factors
    constants: np.ndarray  # log prior - sum of log diagonal

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Estimated chance of label 1 for rows of transformed statistics."""
        logs = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            logs.append(self.constants[k] - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_diagonal: float = 0.2, to_pooled: float = 0.3, floor: float = 0.01) -> Discriminant | None:
    """From counts, sums and sums of products by class; None where a class has no rows."""
    if (n < 1).any():
        return None
    means = s / n[:, None]
    covs = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (covs * (n / n.sum())[:, None, None]).sum(axis=0)
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * covs[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c))
        c = c + floor * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(low)
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def fit_discriminant(vectors: DataFrame, labels: DataFrame) -> Discriminant | None:
    """From all labelled rows outside the held-out fold: vectors (doc_id, x) joined to labels by id."""
    rows = vectors.select("doc_id", "x").filter("doc_id is not null").join(training_labels(labels, "quality"), "doc_id")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + DIM + DIM * DIM))
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().astype(float).reshape(-1, DIM)
                y = b.column("y").to_numpy()
                for k in (0, 1):
                    v = x[y == k]
                    total[k] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "sums"])

    parts = rows.select("x", "y").mapInArrow(sums, "y int, sums array<double>")
    got = parts.select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in got:
        total[r.y, r.i] = r.v
    return fit_from_sums(total[:, 0], total[:, 1 : 1 + DIM], total[:, 1 + DIM :].reshape(2, DIM, DIM))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score in [0, 1] of every row; higher: label 1 is likelier.

    Null text counts as empty and gets the score that its (zero) statistics have. Rows with a null
    or a repeated id are scored one by one. Where a class has no labelled rows, every score is 0.5.
    """
    vectors = materialize(map_text(docs, "text", ["doc_id"], VECTOR, _start), "vectors")
    model = fit_discriminant(vectors, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().astype(float).reshape(-1, DIM)
                s = model.scores(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return vectors.select("doc_id", "x").mapInArrow(score, T.StructType([vectors.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERY = ("op3_quality_classifier", op3_quality_classifier)
