"""Packing token sequences online by sums of squares.

Each partition fills its own windows. Every document's ids are cut into whole windows while they
last; the rest goes into the fill level where the sum of the squared numbers of open windows at each
level grows least (Csirik et al. 2006), from one array of counts by level. When a partition ends, open
windows that would need little padding stay as they are; the others' contents are dealt again, cut at
window ends, and the last window is cut into lengths that are powers of two, which need none.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, compress, count, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from storyspark.llm.common import BATCH_BYTES, BATCH_ROWS, release_memory, strings, table
from storyspark.llm.pair_index import PairIndex

WINDOW, END_ID = 4096, 2
#: An open window stays as it is at the end if its padding is at most this share.
SPARE = 1 / 64
#: Words whose ids a worker remembers, and those of AT_ONCE texts more.
REMEMBERED = 120_000
#: Texts whose words are held at a time.
AT_ONCE = 200
#: Beyond Latin letters; U+0130 is among them, as its lower case is two characters.
BEYOND = "[^\x00-\u012f\u0131-\u024f]"
#: Fixed value: the pretokeniser of the word BPE vocabulary.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased texts without letters beyond; lower case may lie further on. Four control characters are no white space.
LETTER, DIGIT = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^ \t-\r\x85\xa0{LETTER}{DIGIT}]+"

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def young_marks(characters: set[str]) -> list[str]:
    """Those of the characters on which two Unicode versions may differ: unassigned here, or combining marks younger than Unicode 3.2.

    Over all assigned characters, others are lower-cased, normalised and cut as the library does.
    """
    return [c for c in characters if c > "\u024f" and (unicodedata.category(c) in ("Cn", "Cs") or unicodedata.combining(c) and unicodedata.ucd_3_2_0.category(c) == "Cn")]


def laid_out(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of things whose ids lie one behind the other, those of these numbers, laid out likewise, and their sizes."""
    taken = sizes[numbers]
    shift = (np.cumsum(sizes) - sizes)[numbers] - (np.cumsum(taken) - taken)
    return ids[np.repeat(shift, taken) + np.arange(int(taken.sum()))], taken


class WordIds:
    """Ids of texts by a lower-casing word BPE file, whose pieces never reach over white space.

    Words are numbered as they come, and a memory holds the ids of all numbers, one word behind the
    other; a text's ids are taken from it by its words' numbers. New words are normalised and cut into
    pieces as the file asks, and their pieces merged. Only words with one of the characters of
    ``young_marks`` go through the library.
    """

    def __init__(self, path: str):
        self.path = path
        self.index = PairIndex(path)
        self.special = {s: np.array([i], "<u4") for s, i in self.index.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        #: Finds what may be a special token's string in a lower-cased text.
        self.maybe_special = re.compile("|".join(re.escape(s.lower()) for s in self.special) or "(?!)").search
        self.pieces = regex.compile(WORD_PIECES).findall
        self.spaces = regex.compile(r"[ \t-\r]+").split
        self.beyond = re.compile(BEYOND).search
        self.latin_pieces = re.compile(LATIN_PIECES).findall
        self.number: dict[str, int] = defaultdict(count().__next__)
        #: By number: how often the word was met, and how many ids it has.
        self.met, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def words(self, text: str) -> list[str]:
        """Lower-cased already where that depends on nothing else.

        Python's white space is white space to the tokeniser, but for four control characters.
        """
        if text.isascii() or not self.beyond(text):
            low = text.lower()
            if not self.maybe_special(low):
                text = low
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in self.spaces(text) if w]
        return text.split()

    def cut(self, word: str) -> list[str]:
        if word.isascii() or not self.beyond(word):
            low = word.lower()
            if not self.maybe_special(low):
                return [low] if low.isalpha() else self.latin_pieces(low)
        out = []
        for k, part in enumerate(self.split(word)):
            if k % 2:
                out.append(part)
            elif part:
                # a capital sigma has one lower case for the file, wherever it stands
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
                out += self.pieces(part.lower())
        return out

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [ids for i in range(0, len(texts), AT_ONCE) for ids in self._encode(texts[i : i + AT_ONCE])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.number) > REMEMBERED:
            self._forget()
        number, numbers = self.number.__getitem__, []
        for t in texts:
            words = self.words(t)
            numbers.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn(list(islice(self.number, len(self.met), None)))
        every = np.concatenate(numbers)
        self.met += np.bincount(every, minlength=len(self.met))
        ids, sizes = laid_out(self.ids, self.sizes, every)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, numbers)])] * 4
        raw = ids.tobytes()
        return [raw[x:y] for x, y in pairwise(upto.tolist())]

    def _learn(self, new: list[str]) -> None:
        """Puts the words with the next numbers into the memory."""
        known: dict[str | tuple[str], np.ndarray] = dict(self.special)  # as (word,): a word's ids by the library
        if unsure := young_marks(set("".join(new))):
            has = re.compile(f"[{''.join(map(re.escape, unsure))}]").search
            known |= {(w,): np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4") for w in filter(has, new)}
        cut = [[(w,)] if (w,) in known else self.cut(w) for w in new] if unsure else list(map(self.cut, new))
        number = defaultdict(count(len(known)).__next__, zip(known, range(len(known)), strict=True))
        numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
        ids, sizes = self.index.merge_by_length(list(islice(number, len(known), None)))
        ids, sizes = np.concatenate([*known.values(), ids]), np.concatenate([[len(x) for x in known.values()], sizes]).astype(np.int64)
        ids, sizes = laid_out(ids, sizes, numbers)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, np.diff(bounds)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        """Keeps the words met most often, at most half of them; what they were met counts half from then on."""
        stay = self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]
        words = list(compress(self.number, stay.tolist()))
        self.number = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.ids = self.ids[np.repeat(stay, self.sizes)]
        self.met, self.sizes = self.met[stay] // 2, self.sizes[stay]


class Packer:
    """Windows of one partition. A piece is (key, start, ids as bytes, tokens of its document)."""

    def __init__(self, first_id: int, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, np.int64)  # open windows by level
        self.open: dict[int, list[list]] = defaultdict(list)  # level: windows, each a list of pieces

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose choice adds least to the sum of squares; ties to the fullest."""
        limit = self.window - size
        levels = np.flatnonzero(self.count[: limit + 1])  # level 0 is never counted
        after = self.count[levels + size].copy()
        after[levels + size == self.window] = 0  # a full window leaves
        grows = np.where(levels + size == self.window, 1 - 2 * self.count[levels], 2 * (after - self.count[levels] + 1))
        new = 2 * self.count[size] + 1 if size < self.window else 0
        if len(levels) and (k := len(grows) - 1 - int(grows[::-1].argmin())) >= 0 and grows[k] <= new:
            return int(levels[k])
        return 0

    def closed(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in pieces:
            yield key, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total, full = len(ids) // 4, self.window * 4
        whole = len(ids) - len(ids) % full
        for i in range(0, whole, full):
            yield from self.closed([(key, i // 4, ids[i : i + full], total)])
        if whole == len(ids):
            return
        size = total - whole // 4
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        pieces.append((key, whole // 4, ids[whole:], total))
        if level + size == self.window:
            yield from self.closed(pieces)
        else:
            self.count[level + size] += 1
            self.open[level + size].append(pieces)

    def finish(self) -> Iterator[tuple]:
        rest = []
        for level, windows in sorted(self.open.items(), reverse=True):
            for pieces in windows:
                if self.window - level <= self.window * SPARE or level & (level - 1) == 0:
                    yield from self.closed(pieces)
                else:
                    rest += pieces
        left = sum(len(p[2]) // 4 for p in rest)
        at = 0
        while left:
            size, room, out = min(self.window, 1 << (left.bit_length() - 1)), 0, []
            room = size
            while room:
                key, start, ids, total = rest[at]
                n = min(room, len(ids) // 4)
                out.append((key, start, ids[: 4 * n], total))
                rest[at] = (key, start + n, ids[4 * n :], total)
                at += n == len(ids) // 4
                room -= n
            left -= size
            yield from self.closed(out)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokeniser and then ``end_id``, so a null or an empty text has
    one. Pieces of a sequence are gapless from offset 0. Sequence ids hold the partition's number in
    their high bits; a task that runs again gives the same rows. Null and repeated ids are carried
    along, each row a document of its own.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    taken = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([taken.schema["doc_id"], *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        end = np.array([end_id], "<u4").tobytes()

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=schema.fieldNames())

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type  # ids of any type
            ids = words.encode_batch(strings(batch.column(1)))
            if rows := [r for key, x in zip(batch.column(0).to_pylist(), ids, strict=True) for r in packer.add(key, x + end)]:
                yield out(rows, kind)
        if rows := list(packer.finish()):
            yield out(rows, kind)
        release_memory()

    return taken.mapInArrow(run, schema)


_KNOWN: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    """A worker's tokeniser and its memory, kept from task to task."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), path or word_bpe_path())


QUERY = ("op8_packing", op8_packing)
