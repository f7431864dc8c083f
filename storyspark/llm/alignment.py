"""Alignment of two tokenizers over the bytes of a text.

Both token sequences tile the same bytes. An ordered merge finds for each token start the covering token
of the other side; both directions together give all overlapping pairs. Where two overlapping tokens end
together a group ends. Links are counted over the whole corpus and their counts go back to the documents:
frequent pairs by a broadcast of bounded size, the others by a join.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm import byte_bpe, piece_bpe
from storyspark.llm.common import map_text, table
from storyspark.plans.cutting import materialize

#: Tokens that are merged at once; and pairs whose counts are broadcast, at most.
WINDOW, HEAD = 300_000, 300_000
#: Units that a worker remembers, at most; twice as many while the older half fades out.
REMEMBERED = 200_000
#: A pair is its first id times 2^15 plus its second one; with its number of links it fits in 63 bits.
B_BITS, PAIR_BITS, COUNT_BITS = 15, 31, 32
#: Documents that are worked on together.
AT_ONCE = 1000
FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType(), False))]
)


def overlaps(a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all pairs of tokens that share bytes, from ascending starts that begin together.

    Starts hold the document: they count on from one document to the next, where both sides start anew.
    """
    a, b = pd.DataFrame({"at": a_start, "a": np.arange(len(a_start))}), pd.DataFrame({"at": b_start, "b": np.arange(len(b_start))})
    in_b = pd.merge_asof(a, b, on="at")["b"].to_numpy()
    in_a = pd.merge_asof(b, a, on="at")["a"].to_numpy()
    later = np.flatnonzero(a_start[in_a] != b_start)  # equal starts are in the other direction already
    return np.concatenate([a["a"].to_numpy(), in_a[later]]), np.concatenate([in_b, later])


def _shared_end(a_end: np.ndarray, b_end: np.ndarray, least: int) -> int:
    """The first place in a, from ``least`` on, whose token ends with one of b; the last of all does."""
    size = 1024
    while True:
        some = a_end[least : least + size]
        near = b_end[np.searchsorted(b_end, some[0]) : np.searchsorted(b_end, some[-1], "right")]
        if len(hit := np.flatnonzero(np.isin(some, near, assume_unique=True))):
            return least + int(hit[0])
        size *= 4


class BothIds:
    """Ids of both tokenizers, from units that end where neither has a token across: mostly before white space."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe.ByteBpe(a_path, True), piece_bpe.PieceBpe(b_path)
        behind = {m[1] for p in self.b.id_of for m in re.finditer(r"\S(\s)", p.replace(piece_bpe.SPACE, " "))}
        joined = f"(?:[{re.escape(''.join(behind))}]\\s*\\S*)*" if behind else ""  # white space that a piece has behind a letter
        self.units = re.compile(rf"\s*\S+{joined}|\s+").findall
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of texts that have the space in front, as little-endian unsigned 32-bit integers."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        cut = [self.units(t) for t in texts]
        young, new, once = self.young, [], []
        for u in set().union(*cut).difference(young):
            if (ids := self.old.get(u)) is not None:
                young[u] = ids
            else:
                new.append(u)
                if len(u) > piece_bpe.LONG:
                    once.append(u)
        for i in range(0, len(new), piece_bpe.AT_ONCE):
            some = new[i : i + piece_bpe.AT_ONCE]
            if len(self.a.young) > REMEMBERED // 4:
                self.a.old, self.a.young = {}, {}
            b = self.b.encode_spaced([u.replace(" ", piece_bpe.SPACE) for u in some], REMEMBERED // 8)
            young.update(zip(some, zip(self.a.encode_batch(some), b, strict=True), strict=True))
        ids = [[young[u] for u in units] for units in cut]
        for u in once:  # long ones are not kept
            del young[u]
        return [b"".join([x for x, _ in i]) for i in ids], [b"".join([y for _, y in i]) for i in ids]


@lru_cache(1)
def load(a_path: str, b_path: str) -> BothIds:
    return BothIds(a_path, b_path)


class Aligner:
    def __init__(self, a_path: str, b_path: str, digest: bool, window: int = WINDOW):
        self.ids, self.digest, self.window = load(a_path, b_path), digest, window
        known = self.ids.a.index.bytes_of
        self.a_size = np.array([len(known.get(i, b"")) for i in range(max(known) + 1)])
        self.b_size = np.array([len(x) for x in self.ids.b.bytes_of])
        if len(self.b_size) > 1 << B_BITS or len(self.a_size) > 1 << (PAIR_BITS - B_BITS):
            raise ValueError("a vocabulary has too many ids")

    def align(self, texts: list[str]) -> list[pa.Array]:
        """The arrays of FIELDS. A text that is empty or holds the letter for a space, which B's pieces can't give back, has no tokens."""
        used = [k for k, t in enumerate(texts) if t and piece_bpe.SPACE not in t]
        a_ids, b_ids = self.ids.encode([" " + texts[k] for k in used])
        n_a, n_b, n_groups, n_links = (np.zeros(len(texts), np.int64) for _ in range(4))
        n_a[used], n_b[used] = [len(x) // 4 for x in a_ids], [len(x) // 4 for x in b_ids]
        hashes = [hashlib.sha256() for _ in texts] if self.digest else None
        parts: list[list[bytes]] = [[] for _ in texts]
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if len(a_end) and a_end[-1] != b_end[-1]:
            raise AssertionError("the tokens of a text give other bytes than the text")
        a_doc = np.repeat(np.arange(len(texts)), n_a)
        codes, counts = [], []
        x = y = start = 0
        while x < len(a):
            to = _shared_end(a_end, b_end, min(x + self.window, len(a)) - 1) + 1
            upto = int(np.searchsorted(b_end, a_end[to - 1])) + 1
            doc = a_doc[x:to]
            i, j = overlaps(np.concatenate([[start], a_end[x : to - 1]]), np.concatenate([[start], b_end[y : upto - 1]]))
            ends = a_end[x:to][i] == b_end[y:upto][j]
            n_links += np.bincount(doc[i], minlength=len(texts))
            n_groups += np.bincount(doc[i[ends]], minlength=len(texts))
            code = np.sort(doc[i] << PAIR_BITS | a[x:to][i] << B_BITS | b[y:upto][j])
            first = np.flatnonzero(np.diff(code, prepend=-1))
            codes.append(code[first])
            counts.append(np.diff(first, append=len(code)))
            for d, piece in self._listed(a[x:to], b[y:upto], doc, i[ends], j[ends]):
                hashes[d].update(piece) if self.digest else parts[d].append(piece)
            x, y, start = to, upto, int(a_end[to - 1])
        if self.digest:
            listed = [h.hexdigest() if n else "" for h, n in zip(hashes, n_a.tolist(), strict=True)]
        else:
            listed = [b"".join(p).decode() for p in parts]
        return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), pa.array(listed, pa.string()), _pairs(codes, counts, len(texts))]

    def _listed(self, a, b, doc, a_last, b_last):
        """(document, its groups of this window as decimal ids), without the mark behind a document's last group."""
        a_ends, b_ends = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_ends[a_last], b_ends[b_last] = 1, 1
        a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        groups = len(a_last)
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=groups))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=groups))])
        a_place, b_place = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_before[b_group + 1]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[a_place], ids[b_place] = a, b
        marks[a_place], marks[b_place] = np.where(a_ends, ord("|"), ord(",")), np.where(b_ends, ord(";"), ord(","))
        written, ends = piece_bpe.decimals(ids, marks)
        last = np.flatnonzero(np.diff(doc, append=-1))  # the last A token of each document here
        began = 0
        for d, to in zip(doc[last].tolist(), ends[a_before[a_group[last] + 1] + b_before[a_group[last] + 1] - 1].tolist(), strict=True):
            if self.open_document == d:
                yield d, b";"
            yield d, written[began : to - 1]
            self.open_document, began = d, to

    open_document = -1


def _pairs(codes: list[np.ndarray], counts: list[np.ndarray], rows: int) -> pa.Array:
    """Each document's pairs with their numbers of links; a document's windows are added up."""
    code = np.concatenate([*codes, np.zeros(0, np.int64)])
    count = np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    code = code[order][first]
    count = np.add.reduceat(count[order], first) if len(first) else count
    offsets = np.searchsorted(code, np.arange(rows + 1) << PAIR_BITS).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((code & ((1 << PAIR_BITS) - 1)) << COUNT_BITS | count))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, keep: list[str], digest: bool = False, window: int = WINDOW) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3`` or its digest) and pairs.

    A is a byte-level BPE of a space and the text, B a BPE of pieces of the text; special tokens' strings
    are plain text. pairs holds each linked pair of ids once, with its number of links (``split_pair``).
    Null, empty, and any text with U+2581 (B writes it as a space): zeros, an empty string and no pairs.
    Rows are independent, so nulls, repeats and clashing names outside ``keep`` don't matter; no rows give no rows.
    """

    def start():
        aligner = Aligner(a_path, b_path, digest, window)

        def work(texts: list[str]) -> list[pa.Array]:
            aligner.open_document = -1
            return aligner.align(texts)

        return work

    return map_text(docs, "text", keep, FIELDS, start, AT_ONCE)


def split_pair(p: Column) -> tuple[Column, Column]:
    """The pair and its number of links."""
    return F.shiftright(p, COUNT_BITS), p.bitwiseAND(F.lit((1 << COUNT_BITS) - 1))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, links (over all rows), best: whether no pair of its B id has more."""
    pair, n = split_pair(F.col("p"))
    counts = materialize(rows.select(F.explode("pairs").alias("p")).groupBy(pair.alias("pair")).agg(F.sum(n).alias("links")), "pair_counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("links").alias("highest"))  # no more rows than B has ids
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def with_counts(rows: DataFrame, head: int = HEAD) -> DataFrame:
    """``rows`` (row, pairs, ...) without pairs, with n_best and count_sum; written rows are needed, as they are read again."""
    counts = pair_counts(rows)
    sizes = {r.e: r.n for r in counts.groupBy(F.floor(F.log2("links")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    bound, held = 63, 0
    while bound > 0 and held + sizes.get(bound - 1, 0) <= head:
        bound -= 1
        held += sizes.get(bound, 0)
    often = F.floor(F.log2("links")) >= bound
    pair, n = split_pair(F.col("p"))
    linked = rows.select("row", F.explode("pairs").alias("p")).select("row", pair.alias("pair"), n.alias("n"))
    found = linked.join(F.broadcast(counts.filter(often)), "pair")
    if held < sum(sizes.values()):
        rare = linked.join(F.broadcast(counts.filter(often).select("pair")), "pair", "left_anti")
        found = found.unionByName(rare.join(counts.filter(~often), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    both = rows.drop("pairs").join(sums, "row", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op12_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    if a_path is None:
        import public_tokenizers

        a_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = align_tokens(docs, a_path, b_path or piece_bpe.piece_path(), ["doc_id"], digest=True)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return with_counts(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERY = ("op12_alignment", op12_alignment)
