"""SentencePiece BPE encoding and decoding of whole texts, through a table of last tokens.

Merging joins the two neighbours whose joint text is the best piece, the leftmost of equals. A token
sequence is the outcome exactly if each of its neighbours stay apart when they are merged alone, so each
prefix of a text has one last token: the piece that ends there, fits behind the last token of the prefix
before it, and is found by an automaton over all pieces. The ids are read from the table backwards; work
is linear in the text however long a word is.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from storyspark.llm.common import map_text, table

#: Words and pairs that a worker remembers, at most; words longer than LONG are never remembered.
REMEMBERED, PAIRS, LONG = 300_000, 1_000_000, 64
#: Words in one set of tables, the binary logarithm of the number of slots for pairs, and what parts words (in no piece).
AT_ONCE, SLOTS, GAP = 50_000, 21, "\0"
#: The letter that stands for a space, what an unknown id decodes to, and the format's piece types.
SPACE, UNKNOWN = "▁", " ⁇ "
NORMAL, UNKNOWN_TYPE, CONTROL, BYTE = 1, 2, 3, 6
NEVER = 1 << 60
FIELDS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
# a byte that can't be decoded becomes one replacement character
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))

_names = [str(i).encode() for i in range(100_000)]
_DIGITS = np.frombuffer(b"".join(x.ljust(6, b" ") for x in _names), np.uint8).reshape(-1, 6)
_WIDTHS = np.array([len(x) for x in _names])


def decimals(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The decimal ids, each followed by its mark, as one string; and where each ends there. Ids are below 100,000."""
    widths = _WIDTHS[ids]
    cells = _DIGITS[ids]
    cells[np.arange(len(ids)), widths] = marks
    return cells[np.arange(6) <= widths[:, None]].tobytes(), np.cumsum(widths + 1)


class PieceBpe:
    """Vocabulary of a BPE model with byte fallback, identity normalisation and a space before each text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or any(p.type not in (NORMAL, UNKNOWN_TYPE, CONTROL, BYTE) or GAP in p.piece for p in model.pieces):
            raise ValueError(f"{path} is not a plain BPE model with byte fallback")
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.of_byte = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == BYTE:
                self.of_byte[int(p[3:5], 16)] = i
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), UNKNOWN_TYPE: lambda p: UNKNOWN.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.bytes_of = [surface[k](p) for p, k in zip(self.pieces, kinds, strict=True)]
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.spaced = {i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL and p.startswith(SPACE)}

        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        scores = sorted({model.pieces[i].score for i in normal}, reverse=True)
        place = {s: r for r, s in enumerate(scores, 1)}
        self.id_of = {self.pieces[i]: i for i in normal}
        #: By text: when a piece is merged; single characters are there from the start.
        self.rank = {self.pieces[i]: place[model.pieces[i].score] if len(self.pieces[i]) > 1 else 0 for i in normal}
        #: By id: texts at the piece's right and left edge while it grows, each with its birth and the merge that ends it.
        self.right: dict[int, list[tuple[str, int, int]]] = {}
        self.left: dict[int, list[tuple[str, int, int]]] = {}
        for p in sorted(self.id_of, key=lambda p: (self.rank[p], len(p))):
            self._grow(p)
        self.longer = ahocorasick.Automaton()  # pieces of one letter are looked up
        self.of_letter = np.full(0x110000, -1, np.int32)
        for i in self.right:
            if len(self.pieces[i]) > 1:
                self.longer.add_word(self.pieces[i], i)
            else:
                self.of_letter[ord(self.pieces[i])] = i
        self.longer.make_automaton()
        self.sizes_list = [len(p) for p in self.pieces]
        self.sizes = np.array(self.sizes_list)
        letters = "".join(re.escape(p) for p in self.id_of if len(p) == 1 and p != SPACE)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id_of)  # then no place is sure to stay unmerged
        self.words = re.compile(f"[{letters}{SPACE}]+|[^{letters}{SPACE}]" if inner else f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]").findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: By pair of ids: whether they stay apart; and the same in slots, of which a pair has one.
        self.apart: dict[int, bool] = {}
        self.slot_key, self.slot_apart = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)

    def _grow(self, piece: str) -> None:
        """Notes the edges of a piece; one that merging never makes, as its parts merge otherwise, gets none."""
        parts, halves = list(piece), (piece, "")
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NEVER:
                return
            k = ranks.index(best)
            halves = (parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(halves)]
        i, born = self.id_of[piece], self.rank[piece]
        if len(piece) == 1:
            self.right[i] = self.left[i] = [(piece, born, NEVER)]
            return
        a, b = (self.id_of[h] for h in halves)
        if self.rank[halves[0]] > born or self.rank[halves[1]] > born:
            raise ValueError(f"piece {piece!r} is better than its parts")
        self.right[i] = [(piece, born, NEVER)] + [(t, x, min(y, born)) for t, x, y in self.right[b]]
        self.left[i] = [(piece, born, NEVER)] + [(t, x, min(y, born)) for t, x, y in self.left[a]]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of these neighbours while they grow; at equal ranks the left one is first."""
        for x, x_born, x_ends in self.right[a]:
            for y, y_born, y_ends in self.left[b]:
                when = max(self.rank.get(x + y, NEVER), x_born, y_born)
                if when < x_ends and when <= y_ends and when < NEVER:
                    return False
        return True

    def _all_apart(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays apart; answers are kept in hashed slots."""
        keys = before.astype(np.int64) << 32 | after
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        out = self.slot_apart[at]
        for k in np.flatnonzero(self.slot_key[at] != keys).tolist():
            key = int(keys[k])
            found = self.apart.get(key)
            if found is None:
                found = self.apart[key] = self._stay_apart(key >> 32, key & 0xFFFFFFFF)
            out[k] = self.slot_apart[at[k]] = found
            self.slot_key[at[k]] = key
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words; the tables of all of them are filled together, prefix length by prefix length."""
        whole = GAP.join(words) + GAP
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        found = np.fromiter(chain.from_iterable(self.longer.iter(whole)), np.int64).reshape(-1, 2)
        single = self.of_letter[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        place = np.flatnonzero(single >= 0)
        end, token = np.concatenate([found[:, 0], place]) + 1, np.concatenate([found[:, 1], single[place]])
        start_of = np.repeat(starts, lengths + 1)
        prefix = end - start_of[end - 1]
        order = np.argsort(prefix, kind="stable")
        end, token, prefix = end[order], token[order], prefix[order]
        begin = end - self.sizes[token]
        first = self.sizes[token] == prefix
        last = np.full(len(whole) + 1, -1, np.int32)
        cuts = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            fits = first[x:y].copy()
            check = np.flatnonzero(~fits)
            fits[check] = self._all_apart(last[begin[x:y][check]], token[x:y][check])
            last[end[x:y][fits]] = token[x:y][fits]
        used = np.zeros(len(whole) + 1, bool)
        at, stop = ends.copy(), starts
        while len(at):
            used[at] = True
            at = at - self.sizes[last[at]]
            more = at > stop
            at, stop = at[more], stop[more]
        places = np.flatnonzero(used)
        ids = last[places].astype("<u4").tobytes()
        bounds = [0, *(np.searchsorted(places, ends, "right") * 4).tolist()]
        return [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return self.encode_spaced([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])

    def encode_spaced(self, texts: Sequence[str], remembered: int = REMEMBERED) -> list[bytes]:
        """The same of texts whose spaces are written as pieces have them, the one in front too."""
        if len(self.young) > remembered:
            self.old, self.young = self.young, {}
        if len(self.apart) > PAIRS:
            self.apart = {}
        cut = [self.words(t) for t in texts]
        young, new, once = self.young, [], {}
        for w in set().union(*cut).difference(young):
            if (ids := self.old.get(w)) is not None:
                young[w] = ids
            elif len(w) == 1 and w not in self.id_of:
                young[w] = np.array([self.of_byte[b] for b in w.encode()], "<u4").tobytes()
            elif len(w) > LONG:
                once[w] = self._encode_long(w)
            else:
                new.append(w)
        for i in range(0, len(new), AT_ONCE):
            young.update(zip(new[i : i + AT_ONCE], self._encode_words(new[i : i + AT_ONCE]), strict=True))
        if not once:
            return [b"".join([young[w] for w in words]) for words in cut]
        return [b"".join([once[w] if w in once else young[w] for w in words]) for words in cut]

    def _encode_long(self, word: str) -> bytes:
        """The same table for one word of any length, in the order of its prefixes."""
        last, apart, sizes = [-1], self.apart, self.sizes_list
        longer = self.longer.iter(word)
        end, token = next(longer, (-1, -1))
        for place, letter in enumerate(map(self.id_of.__getitem__, word)):
            ending = [letter]
            while end == place:
                ending.append(token)
                end, token = next(longer, (-1, -1))
            for t in ending:
                before = last[place + 1 - sizes[t]]
                fits = before < 0 or apart.get(before << 32 | t)
                if fits is None:
                    fits = apart[before << 32 | t] = self._stay_apart(before, t)
                if fits:
                    last.append(t)
                    break
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return np.array(ids[::-1], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The ids' text without the space before it; bytes that are no UTF-8 become replacement characters."""
        listed = np.frombuffer(ids, "<u4").tolist()
        known = self.bytes_of
        if self.silent.isdisjoint(listed):
            text = b"".join([known[i] for i in listed]).decode("utf-8", "each_byte")
        else:  # a control id parts the bytes beside it
            runs = [list(run) for quiet, run in groupby(listed, self.silent.__contains__) if not quiet]
            text = "".join([b"".join([known[i] for i in run]).decode("utf-8", "each_byte") for run in runs])
            listed = runs[0] if runs else []
        return text[1:] if listed and listed[0] in self.spaced else text


@lru_cache(2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ids (little-endian unsigned 32-bit), n_tokens and decoded, the text that the ids give.

    Whole texts; characters that no piece has become byte tokens. Null text counts as empty: no ids.
    Rows are independent, so nulls, repeats and clashing names outside ``keep`` don't matter.
    No rows give no rows.
    """

    def start():
        bpe = load(path)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = bpe.encode_batch(texts)
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(bpe.decode, ids), pa.string())]

        return work

    return map_text(docs, "text", keep, FIELDS, start)


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with the number and digests of ids and of the decoded text; nothing large leaves a task."""

    def start():
        bpe = load(path)

        def listed(ids: bytes) -> bytes:
            numbers = np.frombuffer(ids, "<u4")
            return decimals(numbers, np.full(len(numbers), ord(","), np.uint8))[0][:-1]

        def work(texts: list[str]) -> list[pa.Array]:
            ids = bpe.encode_batch(texts)
            decoded = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(listed(x)).hexdigest() for x in ids]), pa.array(decoded)]

        return work

    return map_text(docs, "text", ["doc_id"], DIGESTS, start)


def op11_piece_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), path or piece_path())


QUERY = ("op11_piece_bpe", op11_piece_bpe)
