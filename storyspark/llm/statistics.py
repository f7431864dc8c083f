"""Counts of a whole text that the quality operators learn from."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?"

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_short"]
FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])


def repeat_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(grams)) == n:
        return 0
    times = Counter(grams)
    covered = end = 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def dup_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            n += 1
            seen.add(line)
    return n - len(seen), n


def of_text(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: exactly the characters of SPACES

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    dup, lines = dup_lines(raw)
    distinct = set(words)
    return (len(words), len(text) - count(SPACES), count(SYMBOLS), dup, repeat_words(words), lines, count(UPPER), count(DIGITS), count(MARKS), len(distinct), sum(len(w) < 4 for w in words))


def start():
    def work(texts: list[str]) -> list[pa.Array]:
        return [pa.array(c, pa.int64()) for c in zip(*map(of_text, texts), strict=True)]

    return work
