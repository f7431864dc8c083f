"""Byte-level BPE encoding and decoding of whole texts.

The pretokeniser's pieces of a batch are merged once for each different piece, through the pair
occurrence index; their ids are kept for the partition's later texts, in a memory of bounded size.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from storyspark.llm.common import map_text, table
from storyspark.llm.pair_index import PairIndex

#: Pieces that a worker remembers, at most; twice as many while the older half fades out.
REMEMBERED = 300_000
#: Fixed value: the pretokeniser of byte-level BPE vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIELDS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


class ByteBpe:
    """``plain``: strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        self.index = PairIndex(path)
        special = {} if plain else self.index.special
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
        self.pieces = regex.compile(PIECES).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) if any(s in t for s in self.special) else [t] for t in texts]
        cut = [[p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pieces(part))] for parts in split]
        self.learn({p for pieces in cut for p in pieces})
        young = self.young
        return [b"".join([young[p] for p in pieces]) for pieces in cut]

    def learn(self, pieces: set[str]) -> None:
        """Afterwards young has all of these."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for p in pieces:
            if p not in young:
                if p in self.special:
                    young[p] = self.special[p]
                elif (ids := old.get(p)) is not None:
                    young[p] = ids
                else:
                    missing.append(p)
        if missing:
            young.update(zip(missing, self.index.merge_all(missing), strict=True))

    def decode(self, ids: bytes) -> str:
        known = self.index.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str, plain: bool = False) -> ByteBpe:
    return ByteBpe(path, plain)


def bpe_encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ids (little-endian unsigned 32-bit), n_tokens and decoded, the text that the ids give.

    Whole texts; a special token's string in a text is that token. Null text counts as empty: no
    ids. Rows are independent, so nulls and repeats in ``keep`` don't matter.
    """

    def start():
        bpe = load(path)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = bpe.encode_batch(texts)
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(bpe.decode, ids), pa.string())]

        return work

    return map_text(docs, "text", keep, FIELDS, start)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with the number and digests of ids and of the decoded text; nothing large leaves a task."""

    def start():
        bpe = load(path)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = bpe.encode_batch(texts)
            decoded = [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)]

        return work

    return map_text(docs, "text", ["doc_id"], DIGESTS, start)


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_digests(table(spark, sf_dir, "documents"), path)


QUERY = ("op7_byte_bpe", op7_byte_bpe)
