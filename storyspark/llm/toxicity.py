"""Toxicity by nearest labelled examples, exact under TF-IDF cosine.

All words of a bounded sample of labelled texts are terms. A term weighs by its inverse document
frequency, counted over all documents, and by how far its share differs between the classes of the
sample (supervised term weighting, Debole and Sebastiani 2003). Examples sit in an inverted index
whose lists are cut into blocks of examples, each with its largest weight (Ding and Suel 2011): a
document's blocks get upper bounds from these, the best ones are scored first, and then only those
that can still hold a nearer example. The nearest ones vote with weights that fall with their
distance, towards the share of toxic examples among those that share no term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm.common import fold, map_text, release_memory, table, training_labels
from storyspark.plans.cutting import materialize

#: Labelled examples at most: the first in the order of a hash of the id.
MAX_EXAMPLES = 2_500
#: Neighbours that vote; weight of the prior; distance added to each; examples in a block; blocks that are scored first.
NEIGHBOURS, PRIOR, SOFT, BLOCK, FIRST = 9, 0.25, 0.02, 64, 4

WORDS = re.compile(r"\w+").findall
TERMS = T.StructType([T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])


def labelled_examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """(doc_id, y, text) of at most ``max_examples`` labelled rows outside the held-out fold; equal texts of one label once."""
    picked = F.broadcast(training_labels(labels, "toxic", max_examples))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.join(picked, "doc_id").groupBy("y", "text").agg(F.min("doc_id").alias("doc_id")), "examples")


def vocabulary_of(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words of the examples, sorted, and how many toxic and other ones hold each; bounded by the sample."""

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array([list(set(WORDS(t.lower()))) for t in texts], pa.list_(pa.string()))]

        return work

    words = map_text(examples, "text", ["y"], T.StructType([T.StructField("words", T.ArrayType(T.StringType()))]), start)
    by = words.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    found = by.toArrow().sort_by("word")
    bad, n = (found.column(c).to_numpy().astype(float) for c in ("bad", "n"))
    return found.column("word").to_pylist(), np.stack([n - bad, bad])


def with_terms(docs: DataFrame, vocabulary: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, and the known terms of each whole text, ascending, with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of MAX_EXAMPLES texts

    def start():
        number = {w: i for i, w in enumerate(known.value)}

        def work(texts: list[str]) -> list[pa.Array]:
            terms, tfs = [], []
            for t in texts:
                pairs = sorted((i, n) for w, n in Counter(WORDS(t.lower())).items() if (i := number.get(w)) is not None)
                terms.append([i for i, _ in pairs])
                tfs.append([n for _, n in pairs])
            return [pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]

        return work

    return map_text(docs, "text", keep, TERMS, start)


def term_weights(by_class: np.ndarray, totals: tuple[int, int], df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency, times the difference of the two classes' shares in standard errors."""
    good, bad = by_class
    n_good, n_bad = totals
    pooled = (good + bad + 1) / (n_good + n_bad + 1)
    return np.log((n + 1) / (df + 0.5)) * np.abs(bad / n_bad - good / n_good) / np.sqrt(pooled * (1 / n_bad + 1 / n_good))


def weights(tf: np.ndarray, by_term: np.ndarray) -> np.ndarray:
    """Of length 1, or zeros."""
    w = (1 + np.log(tf)) * by_term
    return w / max(float(np.sqrt((w * w).sum())), 1e-300)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class BlockMaxIndex:
    """Examples by term. A cell is one term's list inside one block of examples, with its largest weight."""

    ids: np.ndarray
    y: np.ndarray
    by_term: np.ndarray
    cells_of: np.ndarray  # from term t's first cell to that of t + 1
    cell_block: np.ndarray
    cell_most: np.ndarray
    cell_start: np.ndarray  # in the postings, with one end more
    at: np.ndarray
    weight: np.ndarray
    no_term: float

    @classmethod
    def build(cls, rows: list[tuple[int, int, np.ndarray, np.ndarray]], by_term: np.ndarray) -> BlockMaxIndex:
        """rows: id, y, terms, counts. Like examples stand together, so that bounds are tight: by class, commonest and heaviest term."""
        told = [(i, y, np.asarray(t, int), weights(np.asarray(n), by_term[np.asarray(t, int)]), np.asarray(n)) for i, y, t, n in rows]
        empty = [r[1] for r in told if not r[3].any()]
        told = sorted((r for r in told if r[3].any()), key=lambda r: (-r[1], int(r[2][r[4].argmax()]), int(r[2][r[3].argmax()]), r[0]))
        at = np.repeat(np.arange(len(told)), [len(r[2]) for r in told])
        term, weight = (np.concatenate([np.zeros(0), *(r[k] for r in told)]) for k in (2, 3))
        order = np.lexsort((at, term))
        at, term, weight = at[order], term[order].astype(int), weight[order]
        block = at // BLOCK
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        most = np.maximum.reduceat(weight, first) if len(first) else weight
        cells_of = np.searchsorted(term[first], np.arange(len(by_term) + 1))
        ids, y = np.array([r[0] for r in told], np.int64), np.array([r[1] for r in told], int)
        return cls(ids, y, by_term, cells_of, block[first], most, np.append(first, len(at)), at, weight, (sum(empty) + 1) / (len(empty) + 10))

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, ties to the smaller position; exact."""
        n_cells = self.cells_of[terms + 1] - self.cells_of[terms]
        cells, x = _ranges(self.cells_of[terms], n_cells), np.repeat(w, n_cells)
        block = self.cell_block[cells]
        n_blocks = -(-len(self.ids) // BLOCK)
        bound = np.bincount(block, x * self.cell_most[cells], n_blocks)
        score = np.zeros(len(self.ids))

        def visit(blocks: np.ndarray) -> None:
            chosen = blocks[block]
            c = cells[chosen]
            lengths = self.cell_start[c + 1] - self.cell_start[c]
            p = _ranges(self.cell_start[c], lengths)
            np.add(score, np.bincount(self.at[p], np.repeat(x[chosen], lengths) * self.weight[p], len(score)), out=score)

        first = np.zeros(n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[:FIRST]] = True
        visit(first)
        kth = np.partition(score, -k)[-k] if len(score) > k else 0.0
        visit(~first & (bound > 0) & (bound * (1 + 1e-9) >= kth))
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        best = found[np.lexsort((found, -score[found]))[:k]]
        return best, score[best]

    def vote(self, terms: np.ndarray, tfs: np.ndarray) -> tuple[float, list[int], list[float]]:
        """Score, ids of the nearest examples, their cosines. A weight is 1 / (distance + SOFT)."""
        w = weights(tfs, self.by_term[terms]) if len(terms) else np.zeros(0)
        if not w.any() or not len(self.ids):
            return self.no_term, [], []
        at, cos = self.nearest(terms, w, NEIGHBOURS)
        v = 1 / (1 - np.minimum(cos, 1) + SOFT)
        return (float((v * self.y[at]).sum()) + PRIOR * self.no_term) / (float(v.sum()) + PRIOR), self.ids[at].tolist(), cos.tolist()


def _arrays(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in batch.column(name)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], max_examples: int = MAX_EXAMPLES) -> tuple[BlockMaxIndex | None, DataFrame]:
    """The index, and ``keep``, term and tf of all documents, written in the shared folder.

    Examples are a bounded sample, and so is the vocabulary; document frequencies count all documents.
    """
    examples = labelled_examples(docs, labels, max_examples)
    vocabulary, by_class = vocabulary_of(examples)
    vectors = materialize(with_terms(docs, vocabulary, keep), "terms")
    rows = with_terms(examples, vocabulary, ["doc_id", "y"]).toArrow()
    y = rows.column("y").to_pylist()
    totals = y.count(0), y.count(1)
    if not all(totals):
        return None, vectors
    df = np.zeros(len(vocabulary))
    counted = vectors.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    df[counted.column("t").to_numpy()] = counted.column("n").to_numpy()
    by_term = term_weights(by_class, totals, df, vectors.count())
    return BlockMaxIndex.build(list(zip(rows.column("doc_id").to_pylist(), y, _arrays(rows, "term"), _arrays(rows, "tf"), strict=True)), by_term), vectors


def _judged(index: BlockMaxIndex | None, batch: pa.RecordBatch) -> list[tuple[float, list[int], list[float]]]:
    if index is None:
        return [(0.0, [], [])] * batch.num_rows
    return [index.vote(t, n) for t, n in zip(_arrays(batch, "term"), _arrays(batch, "tf"), strict=True)]


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("cosines", T.ArrayType(T.DoubleType()))])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score in [0, 1], evidence (ids of the nearest examples) and cosines of every row.

    A score depends on the text alone, so equal texts score equally and an example is its own nearest
    one. Null text counts as empty; a text without a word of the examples gets the share of toxic ones
    among such examples. Rows with null or repeated ids are scored one by one. Without labels of both
    classes every score is 0.
    """
    index, vectors = fit_toxicity(docs, labels, ["doc_id"])
    known = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if made := _judged(known.value, b):
                s, e, c = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array(e, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.float64()))], names=["doc_id", *SCORED.fieldNames()])
        release_memory()

    return vectors.mapInArrow(run, T.StructType([vectors.schema["doc_id"], *SCORED.fields]))


def drop_toxic(docs: DataFrame, labels: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """``columns`` of the rows that score below ``least``; texts are written beside their terms and never shuffled."""
    index, vectors = fit_toxicity(docs, labels, columns)
    known = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(columns).filter(pa.array([s < least for s, _, _ in _judged(known.value, b)], pa.bool_()))
        release_memory()

    return vectors.mapInArrow(run, docs.select(*columns).schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


QUERY = ("op6_toxicity", op6_toxicity)
