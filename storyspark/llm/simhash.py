"""SimHash near-duplicates by anchor points.

Fingerprints link where at most two of their 64 bits differ. The anchors are the words of a covering
code (Afrati et al. 2014): the product of two perfect binary Golay codes of length 23 on bits 0-22
and 23-45, so that every fingerprint lies within 3 bits of exactly one anchor in either half, its
home. A fingerprint is also replicated to every anchor within covering radius plus threshold, the
threshold shared out between the halves: radius 3 + i in one and 3 + j in the other, i + j <= 2.
Of two linked fingerprints either one therefore meets the other at its home anchor, and they are
compared only there: on average 61 small rows for a fingerprint, over 2**24 anchors. Exact copies
meet before that, in one grouped minimum, so groups of copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm.common import map_text, table
from storyspark.operators.components import connected_components
from storyspark.plans.cutting import materialize

THRESHOLD = 2
LENGTH, RADIUS = 23, 3
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101
CHUNK = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's shingles of ``width`` words; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    h = np.fromiter(map(_hash, shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _start():
    def work(texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return work


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and fp, the fingerprint's bits as a signed long. Null text counts as empty."""
    return map_text(docs, "text", keep, T.StructType([T.StructField("fp", T.LongType())]), _start)


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    v = v.copy()
    for bit in range(LENGTH - 1, 10, -1):
        v ^= np.where((v >> bit) & 1, GENERATOR << (bit - 11), 0)
    return v


@lru_cache(1)
def _offsets() -> list[np.ndarray]:
    """By cost 0, 1, 2: a row for each syndrome of the words that lead from a point to its anchors; -1 pads.

    Cost i holds the words of weight RADIUS + i, cost 0 those of weight up to RADIUS.
    """
    out = []
    for cost in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if cost == 0 else [RADIUS + cost]
        words = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(LENGTH), w)], np.int64)
        s = syndrome(words)
        words, s = words[order := np.argsort(s, kind="stable")], s[order]
        first = np.searchsorted(s, np.arange(1 << 11))
        rows = np.full((1 << 11, np.bincount(s).max()), -1, np.int64)
        rows[s, np.arange(len(s)) - first[s]] = words
        out.append(rows)
    return out


def anchors(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into fps, anchor), for every anchor that a fingerprint goes to."""
    mask = (1 << LENGTH) - 1
    halves = [fps & mask, (fps >> LENGTH) & mask]
    syndromes = [syndrome(h) for h in halves]
    table_ = _offsets()
    to = [[np.where(table_[c][s] >= 0, h[:, None] ^ table_[c][s], -1) for c in range(THRESHOLD + 1)] for h, s in zip(halves, syndromes, strict=True)]
    for i in range(THRESHOLD + 1):
        for j in range(THRESHOLD + 1 - i):
            a, b = to[0][i][:, :, None], to[1][j][:, None, :]
            index, x, y = np.nonzero((a >= 0) & (b >= 0))
            yield index, (to[0][i][index, x] << LENGTH) | to[1][j][index, y]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for index, anchor in anchors(fps):
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[index])], names=["anchor", "b"])


def linked(fps: DataFrame) -> DataFrame:
    """(a, b), a < b, once for every two distinct values of column fp that differ in 1 or 2 bits."""
    placed = fps.mapInArrow(_placed, "anchor long, b long")
    at_home = fps.mapInArrow(_at_home, "anchor long, a long")
    # both sides look equally small to Spark, as a step in Python does not tell that it multiplies rows; placed must not be broadcast
    met = at_home.join(placed.hint("merge"), "anchor")
    return met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)).select("a", "b")


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = (1 << LENGTH) - 1
    leaders = _offsets()[0][:, 0]
    for batch in batches:
        fps = batch.column(0).to_numpy()
        a, b = fps & mask, (fps >> LENGTH) & mask
        yield pa.RecordBatch.from_arrays([pa.array(((a ^ leaders[syndrome(a)]) << LENGTH) | (b ^ leaders[syndrome(b)])), pa.array(fps)], names=["anchor", "a"])


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, component_id of every row; component_id is the least doc_id reachable by links.

    Null text counts as empty; texts without words have fingerprint zero and link like others.
    Repeated rows stay, in one component. Rows with a null id link too but lend no id: a component
    of such rows alone has a null component_id. text_key is the text's xxhash64.
    """
    return _rooted(docs).select("doc_id", "text_key", "fp", "component_id")


def _rooted(docs: DataFrame) -> DataFrame:
    """``simhash_components`` with root, a fingerprint that is the component's own."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = materialize(with_fingerprint(named, ["doc_id", "text_key"]), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(linked(classes.select("fp")), "a", "b")
    whole = materialize(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    known = whole.select("fp", "root").join(whole.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(known, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one_per_component(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of one row of each component: that of its least id.

    Of several rows with that id in the component, the one of least text key stays, and of its
    exact repeats the least in the other columns. An id that is the least one of several components keeps a row in
    each. Rows with a null id all stay: no decision can name them. Texts are shuffled once, to their ids.
    """
    found = _rooted(docs).filter("doc_id = component_id").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("__copies"))
    keepers = found.groupBy("root", "doc_id").agg(F.min(F.struct(F.col("text_key").alias("__text_key"), "__copies")).alias("k")).select("doc_id", "k.*")
    keepers = materialize(keepers, "keepers")
    rows = docs.select(*columns).filter("doc_id is not null").withColumn("__text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(keepers, ["doc_id", "__text_key"])
    once = rows.filter("__copies = 1").select(*columns).unionByName(docs.select(*columns).filter("doc_id is null"))
    if not keepers.filter("__copies > 1").head(1):
        return once
    repeated = rows.filter("__copies > 1").groupBy("doc_id", "__text_key").agg(F.min(F.struct(*[c for c in columns if c != "doc_id"])).alias("least"))
    return once.unionByName(repeated.select("doc_id", F.col("least").alias("__least")).select(*[F.col("doc_id") if c == "doc_id" else F.col("__least")[c].alias(c) for c in columns]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERY = ("op4_simhash", op4_simhash)
