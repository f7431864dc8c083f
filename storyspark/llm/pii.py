"""Personal data: patterns for four kinds, and lexical patterns that these bootstrap.

Base matches are seed entities. The two words before a seed, or the two after it, make a lexical
pattern with a slot on its other side (Agichtein and Gravano 2000, Riloff and Jones 1999). Every place
of a text where such a pattern stands is looked at: its slot holds a seed, another string of the
kind's shape, or nothing like it. Spark scores the graph of patterns and instances in turns: a
pattern is as trustworthy as the share of trusted instances in all its places, an unseen instance as
its patterns make it, and trusted instances count for further patterns. What stands in the slot of a
confident pattern is found, though no base pattern matches it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm.common import arrow_batches, map_text, release_memory, strings, table
from storyspark.plans.cutting import materialize

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; different seeds that make a pattern, and their least share of its places in texts that hold base
#: matches; trusted instances and score of a confident one; confidence of an instance; weight against rare patterns.
ROUNDS, LEAST_SEEDS, SEED_SHARE, LEAST_SUPPORT, PATTERN_CONFIDENCE, INSTANCE_CONFIDENCE, DOUBT = 3, 2, 0.2, 5, 0.8, 0.8, 1.0
#: Patterns that are looked for in one pass over the texts; more of them take more passes.
PATTERNS_AT_ONCE = 200_000
#: Words and marks that a slot may take.
SLOT = 15

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Signs, or words between spaces or underlines, or in brackets.
AT = r"\s?@\s?|\s?[\[({]\s?(?:@|at)\s?[\])}]\s?|[\s_]at[\s_]"
DOT = r"\.|\s\.\s|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|[\s_]dot[\s_]"
HAS_AT = re.compile(r"@|[\s_\[({]at[\s_\])}]", re.I)
#: The shapes that a slot's string may have: an address with or without its domain's last part, four small numbers or
#: groups of hexadecimal digits, 12 to 19 digits, 7 to 15 digits; with any marks between.
SHAPES = (
    re.compile(rf"[^\W_](?:[\w.%+-]*[^\W_])?(?:{AT})[^\W_]+(?:-[^\W_]+)*(?:(?:{DOT})[^\W_]+(?:-[^\W_]+)*)*", re.I),
    re.compile(r"[0-9]{1,3}(?:[\s.,:;_\[\](){}-]{1,3}[0-9]{1,3}){3}|[0-9a-f]{0,4}(?:::?[0-9a-f]{1,4}){2,7}|[0-9a-f]{0,4}::[0-9a-f]{1,4}", re.I),
    re.compile(r"[0-9](?:[\s./_,:-]{0,2}[0-9]){11,18}"),
    re.compile(r"[+(]?[0-9](?:[\s./_,:()-]{0,2}[0-9]){6,14}"),
)
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost non-overlapping matches, found from each @ so that long runs of letters cost nothing."""
    after = 0
    at = text.find("@")
    behind = 0
    while at >= 0:
        low = max(after, behind)
        run = text[low:at]
        start = low + len(run.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
        behind = at + 1
        at = text.find("@", max(behind, after))


def strict(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out)


TOKENS = re.compile(r"\w+|[^\w\s]|\n")
#: What stands before a text's or a line's first word, and after its last one.
EDGE = "\n"


def flat(text: str) -> str:
    """Lower case, digits as 0, of the same length."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return DIGIT.sub("0", lower)


def tokens_of(text: str) -> list[str]:
    """Words, marks and line ends of a flat text, with two edges at either end."""
    return [EDGE, EDGE, *TOKENS.findall(text), EDGE, EDGE]


def bounds_of(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of ``tokens_of``."""
    spans = [m.span() for m in TOKENS.finditer(text)]
    n = len(text)
    return [0, 0, *(s for s, _ in spans), n, n], [0, 0, *(e for _, e in spans), n, n]


def telling(a: str, b: str) -> bool:
    """Whether two tokens say anything: one of them is a word with a letter."""
    return a.isalpha() or b.isalpha()


def patterns_at(tokens: list[str], starts: list[int], ends: list[int], start: int, end: int) -> list[str]:
    """The patterns around a span: ``< a b`` before it, ``> a b`` after it."""
    out = []
    i = max(bisect_right(ends, start), 2)  # tokens before i end at or before the span
    if telling(tokens[i - 2], tokens[i - 1]):
        out.append(f"< {tokens[i - 2]} {tokens[i - 1]}")
    j = min(bisect_left(starts, end), len(tokens) - 2)
    if telling(tokens[j], tokens[j + 1]):
        out.append(f"> {tokens[j]} {tokens[j + 1]}")
    return out


def _key(s: str) -> int:
    """As Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SEED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("instance", T.LongType())])
SEEDS = T.StructType([T.StructField("text_key", T.LongType()), T.StructField("base", T.ArrayType(SPAN)), T.StructField("seeds", T.ArrayType(SEED))])
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SEED = pa.struct([("kind", pa.int32()), ("pattern", pa.string()), ("instance", pa.int64())])


def instance(kind: int, string: str) -> int:
    return _key(f"{kind}{string.lower()}")


def seeds_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Each base match with each of its patterns."""
    if not base:
        return []
    low = flat(text)
    tokens, (starts, ends) = tokens_of(low), bounds_of(low)
    return [{"kind": k, "pattern": p, "instance": instance(k, text[s:e])} for s, k, e in base for p in patterns_at(tokens, starts, ends, s, e)]


def _start_seeds():
    def work(texts: list[str]) -> list[pa.Array]:
        base = [strict(t) for t in texts]
        spans = [[{"kind": k, "start": s, "end": e} for s, k, e in b] for b in base]
        return [pa.array([_key(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array([seeds_of(t, b) for t, b in zip(texts, base, strict=True)], pa.list_(_SEED))]

    return work


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base matches, and their patterns, of every row."""
    return map_text(docs, "text", ["doc_id"], SEEDS, _start_seeds)


def induced_patterns(scanned: DataFrame) -> DataFrame:
    """(kind, pattern) that stand beside at least LEAST_SEEDS different seeds of the kind."""
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.*")
    return seeds.groupBy("kind", "pattern").agg(F.count_distinct("instance").alias("n")).filter(F.col("n") >= LEAST_SEEDS).select("kind", "pattern")


class Slots:
    """Looks for patterns in a text and at what stands in their slots."""

    def __init__(self, patterns: list[tuple[int, str]]):
        self.of: dict[tuple[str, str], list[tuple[int, int, int]]] = {}
        for number, (kind, pattern) in enumerate(patterns):
            side, a, b = pattern.split(" ")
            self.of.setdefault((a, b), []).append((number, kind, 1 if side == "<" else -1))

    def filler(self, text: str, tokens: list[str], starts: list[int], ends: list[int], at: int, step: int, kind: int) -> tuple[int, int] | None:
        """The string of the kind's shape that begins with token ``at``, or the longest one that ends with it; within the line."""
        stop, last = at, at + step * SLOT
        while stop != last and 0 <= stop < len(tokens) and tokens[stop] != EDGE:
            stop += step
        stop -= step
        if (stop - at) * step < 0:
            return None
        shape = SHAPES[kind]
        if step > 0:
            m = shape.match(text, starts[at], ends[stop])
            return m.span() if m and ends[bisect_left(ends, m.end(), at)] == m.end() else None
        while stop <= at:
            if shape.fullmatch(text, starts[stop], ends[at]):
                return starts[stop], ends[at]
            stop += 1
        return None

    def find(self, text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, bool]], list[int]]:
        """(pattern, start, end, instance, whether a seed) of filled slots; the patterns of all places, filled or not."""
        low = flat(text)
        tokens, of = tokens_of(low), self.of
        at = [i for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)) if pair in of]
        if not at:
            return [], []
        hits = [(i + 2 if step > 0 else i - 1, step, number, kind) for i in at for number, kind, step in of[tokens[i], tokens[i + 1]]]
        # a slot holds nothing unless a digit, or an at, is near
        digits = {j + d for j, t in enumerate(tokens) if "0" in t for d in range(-3, 4)}
        ats = {j + d for j, t in enumerate(tokens) if t in ("@", "at") or "_at_" in t for d in range(-8, 13)}
        near = [h for h in hits if 0 <= h[0] < len(tokens) and h[0] in (digits if h[3] else ats)]
        filled = []
        if near:
            starts, ends = bounds_of(low)
            begins, finishes = {(s, k): e for s, k, e in base}, {(e, k): s for s, k, e in base}
            union_start, union_end = _union(base)
            for j, step, number, kind in near:
                seed = None
                if step > 0 and (starts[j], kind) in begins:
                    seed = starts[j], begins[starts[j], kind]
                elif step < 0 and (ends[j], kind) in finishes:
                    seed = finishes[ends[j], kind], ends[j]
                span = seed or self.filler(text, tokens, starts, ends, j, step, kind)
                if span and (seed or not _overlaps(union_start, union_end, *span)):
                    filled.append((number, *span, instance(kind, text[span[0] : span[1]]), seed is not None))
        return filled, [number for _, _, number, _ in hits]


def _union(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Base matches of different kinds may overlap: their union, as disjoint intervals."""
    starts, ends = [], []
    for s, _, e in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _overlaps(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    i = bisect_right(ends, start)
    return i < len(starts) and starts[i] < end


FILLED = T.StructType([T.StructField(n, T.IntegerType()) for n in ("pattern", "start", "end")] + [T.StructField("instance", T.LongType()), T.StructField("seed", T.BooleanType())])
COUNTED = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("n", T.LongType())])
_FILLED = pa.struct([("pattern", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_())])
_COUNTED = pa.struct([("pattern", pa.int32()), ("n", pa.int64())])


def places(docs: DataFrame, patterns: list[tuple[int, str]], first: int = 0, everywhere: bool = True) -> DataFrame:
    """Where patterns stand, numbered from ``first``: doc_id, text_key and filled slots of rows that have any, and counts.

    Counts of all places, filled or not, are one more row of each task. ``everywhere``: in all texts,
    else in those that hold a base match.
    """
    arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(patterns)  # about PATTERNS_AT_ONCE
    taken = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    schema = T.StructType([taken.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("filled", T.ArrayType(FILLED)), T.StructField("counts", T.ArrayType(COUNTED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(known.value)
        counts = np.zeros(len(known.value), np.int64)
        id_type = None

        def made(ids: pa.Array, keys: list, filled: list, counted: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array(filled, pa.list_(_FILLED)), pa.array(counted, pa.list_(_COUNTED))], names=schema.fieldNames())

        for b in batches:
            id_type = b.column(0).type
            rows, keys, filled = [], [], []
            for at, text in enumerate(strings(b.column(1))):
                base = strict(text)
                if base or everywhere:
                    here, numbers = slots.find(text, base)
                    if numbers:
                        np.add.at(counts, numbers, 1)
                    if here:
                        rows.append(at)
                        keys.append(_key(text))
                        filled.append([{"pattern": first + p, "start": s, "end": e, "instance": i, "seed": seed} for p, s, e, i, seed in here])
            yield made(b.column(0).take(pa.array(rows, pa.int64())), keys, filled, [[]] * len(rows))
        if counts.any():
            yield made(pa.nulls(1, id_type), [None], [[]], [[{"pattern": first + p, "n": int(counts[p])} for p in np.flatnonzero(counts).tolist()]])
        release_memory()

    return taken.mapInArrow(run, schema)


def edges_of(found: DataFrame) -> DataFrame:
    """(pattern, instance) with the number of places and whether one of them is a seed."""
    return found.select(F.explode("filled").alias("f")).groupBy("f.pattern", "f.instance").agg(F.count("*").alias("n"), F.max("f.seed").alias("seed"))


def places_of(found: DataFrame) -> DataFrame:
    return found.select(F.explode("counts").alias("c")).groupBy("c.pattern").agg(F.sum("c.n").alias("places"))


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) after the last round of grouped sums over the graph of patterns and instances.

    An instance that is a seed somewhere is trusted everywhere. An unseen one gets 1 - the product of
    (1 - score) over its confident patterns, and is trusted from INSTANCE_CONFIDENCE on.
    """
    edges = materialize(edges_of(found), "edges")
    all_places = materialize(places_of(found), "places")
    trust = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("trust"))
    score = None
    for _ in range(rounds):
        sums = edges.join(trust, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("trust")).alias("good"), F.sum("trust").alias("support"))
        score = sums.join(all_places, "pattern").select("pattern", (F.col("good") / (F.col("places") + DOUBT)).alias("score"), "support")
        score = materialize(score.filter((F.col("support") >= LEAST_SUPPORT) & (F.col("score") >= PATTERN_CONFIDENCE)), "patterns")
        gained = edges.join(score, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("gain"))
        known = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("seed")).join(gained, "instance", "left")
        trust = materialize(known.select("instance", F.greatest("seed", F.when(F.col("gain") >= INSTANCE_CONFIDENCE, F.col("gain")).otherwise(0.0)).alias("trust")), "trust")
    return score.select("pattern", "score")


def dealt(patterns: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(kind, pattern) in lists of about PATTERNS_AT_ONCE; the driver holds one at a time."""
    parts = -(-patterns.count() // PATTERNS_AT_ONCE)
    for part in range(parts):
        if rows := patterns.filter(F.pmod(F.xxhash64("kind", "pattern"), F.lit(parts)) == part).collect():
            yield sorted((r.kind, r.pattern) for r in rows)


def promising(docs: DataFrame, induced: DataFrame) -> DataFrame:
    """The patterns that seeds fill at a share of SEED_SHARE or more of their places in texts with base matches.

    Others, like pairs of common words, would have to be trusted for what stands elsewhere alone.
    """
    spark, kept = docs.sparkSession, None
    for patterns in dealt(induced):
        here = materialize(places(docs, patterns, everywhere=False), "seed-places")
        seeds = edges_of(here).filter("seed").groupBy("pattern").agg(F.sum("n").alias("seeds"))
        good = seeds.join(places_of(here), "pattern").filter(F.col("seeds") >= SEED_SHARE * F.col("places")).select("pattern")
        named = spark.createDataFrame([(i, *p) for i, p in enumerate(patterns)], "pattern int, kind int, name string")
        part = good.join(named, "pattern").select("kind", F.col("name").alias("pattern"))
        kept = part if kept is None else kept.unionByName(part)
    return induced if kept is None else kept


def discovered(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """doc_id, text_key, extra: what stands in slots of confident patterns, for rows that have any."""
    induced = materialize(induced_patterns(scanned), "induced")
    found, kinds, first = None, [], 0
    for patterns in dealt(materialize(promising(docs, induced), "promising")):
        here = materialize(places(docs, patterns, first), "places")
        found = here if found is None else found.unionByName(here)
        cuts = [first + sum(k < kind for k, _ in patterns) for kind in range(len(KINDS) + 1)]
        kinds += [(kind, a, b) for kind, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        first += len(patterns)
    if found is None:
        return docs.sparkSession.createDataFrame([], T.StructType([scanned.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("extra", T.ArrayType(SPAN))]))
    good = confident_patterns(found)
    kind = F.coalesce(*[F.when((F.col("f.pattern") >= a) & (F.col("f.pattern") < b), k) for k, a, b in kinds])
    fresh = found.select("doc_id", "text_key", F.explode(F.filter("filled", lambda f: ~f.seed)).alias("f"))
    hits = fresh.withColumn("kind", kind).join(good, F.col("f.pattern") == good.pattern, "left_semi").select("doc_id", "text_key", F.struct("kind", "f.start", "f.end").alias("s"))
    return hits.groupBy("doc_id", "text_key").agg(F.collect_set("s").alias("extra"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, kind, end), kind by its place in KINDS.

    spans hold base and what confident patterns add, ordered by start, then kind; added ones may
    overlap each other, never a base match. Null text counts as empty and has none. Repeated rows are
    each returned, alike; null ids too. Without enough seeds no pattern is confident, and spans equal
    base. A pattern needs a word; the edge of a text or line alone is none.
    """
    scanned = materialize(scan(docs), "seeds")
    extra = discovered(docs, scanned)
    rows = scanned.join(extra.withColumnsRenamed({"doc_id": "e_id", "text_key": "e_key"}), F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_key") == F.col("e_key")), "left")
    spans = F.transform("base", lambda m: F.struct(m.start.alias("start"), m.kind.alias("kind"), m.end.alias("end")))
    more = F.transform(F.coalesce("extra", F.array().cast("array<struct<kind:int,start:int,end:int>>")), lambda m: F.struct(m.start.alias("start"), m.kind.alias("kind"), m.end.alias("end")))
    return rows.select("doc_id", "text_key", F.array_sort(spans).alias("base"), F.array_sort(F.concat(spans, more)).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span's text replaced by its kind in brackets; of overlapping spans the first one counts."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row, with personal data in text masked and n_chars, if among them, counted anew.

    Base matches are found again where a text is masked, so that only the few rows with discovered
    spans meet a join; Spark broadcasts those while they are few and shuffles otherwise. A null text
    stays null, and so does its n_chars if it was.
    """
    extra = materialize(discovered(docs, materialize(scan(docs), "seeds")), "discovered").withColumnsRenamed({"doc_id": "e_id", "text_key": "e_key"})
    rows = docs.select(*columns).withColumn("e_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("e_text") == F.col("e_key")), "left").select(*columns, "extra")
    schema = docs.select(*columns).schema
    at_text, at_chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            extras = b.column(len(columns)).to_pylist()
            texts = [t if t is None else masked(t, strict(t) + [(x["start"], x["kind"], x["end"]) for x in more or ()]) for t, more in zip(b.column(at_text).to_pylist(), extras, strict=True)]
            made = [b.column(i) for i in range(len(columns))]
            made[at_text] = pa.array(texts, pa.string())
            if at_chars is not None:
                made[at_chars] = pa.array([n if t is None else len(t) for t, n in zip(texts, b.column(at_chars).to_pylist(), strict=True)], made[at_chars].type)
            yield pa.RecordBatch.from_arrays(made, names=columns)
        release_memory()

    return rows.mapInArrow(run, schema)


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERY = ("op5_pii", op5_pii)
