"""Repair of conversation structure by lightest derivations.

Repair is a weighted deduction system. An item (i, q) says that the first i rows are edited and that
their roles have brought the grammar ``(s?(ua)+)?`` into state q; a rule adds one edit to an item. A
second kind of rule has two premises, a repaired stretch from state s to r and the next one from r to q.
An agenda pops items by (cost, audit). Rules are superior and monotone in that order (at equal cost, audits
over the same rows are never each other's prefix), so an item is final when it is popped first.

A conversation is cut into blocks of rows; blocks are derived in parallel for every state that they may
be entered in, and stretches are put together in the conversation's order. A task holds a block, or an
audit, never the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm.common import arrow_batches, table
from storyspark.plans.cutting import materialize

#: Rows and characters of a block, at most (a longer text is a block of its own).
ROWS, CHARS = 256, 1 << 20
#: Costs of edits, and the characters that count as blank.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: The grammar: state and initial to the next state; a conversation ends at its start or after a reply.
EMPTY, SYSTEM, USER, REPLY = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): REPLY, (REPLY, "u"): USER}
GOALS = (EMPTY, REPLY)
LEGAL = {"su", "ua", "au"}
#: The initial that rerole and insert can give in each state.
SPOKEN = {q: c for (q, c) in NEXT if c in "ua"}
ROLES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]


def lightest(axioms: Iterable[tuple[int, str, tuple]], rules: Callable, goals: set | None = None) -> dict[tuple, Weight]:
    """Final weights of items, until all goals are final; ``rules(item, weight, final)`` yields (cost, audit, item) of what follows."""
    agenda, final = list(axioms), {}
    heapify(agenda)
    missing = set(goals) if goals else None
    while agenda:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if missing:
            missing.discard(item)
            if not missing:
                break
        for found in rules(item, (cost, audit), final):
            if found[2] not in final:
                heappush(agenda, found)
    return final


def derive(initials: str, faults: str, start: int) -> dict[int, Weight]:
    """By last state: the lightest edits of these rows from state ``start``."""
    n = len(initials)

    def rules(item, weight, final):
        i, q = item
        cost, audit = weight
        spoken = SPOKEN[q]
        yield cost + INSERT, audit + "I", (i, NEXT[q, spoken])
        if i == n:
            return
        yield cost + DELETE, audit + "D", (i + 1, q)
        fault = faults[i]
        if fault in "bd":
            return
        extra = TRUNCATED if fault == "t" else 0
        if (kept := NEXT.get((q, initials[i]))) is not None:
            yield cost + extra, audit + "K", (i + 1, kept)
        if initials[i] != spoken:
            yield cost + extra + REROLE, audit + "R", (i + 1, NEXT[q, spoken])

    found = lightest([(0, "", (0, start))], rules, {(n, q) for q in range(4) if q >= min(start, USER)})
    return {q: w for (i, q), w in found.items() if i == n}


def compose(left: dict[tuple[int, int], Weight], right: dict[tuple[int, int], Weight]) -> dict[tuple[int, int], Weight]:
    """Stretches (first state, last state) of two neighbours put together."""

    def rules(item, weight, final):
        side, a, b = item
        cost, audit = weight
        for q in range(4):
            if side == 0 and (other := final.get((1, b, q))):
                yield cost + other[0], audit + other[1], (2, a, q)
            elif side == 1 and (other := final.get((0, q, a))):
                yield cost + other[0], other[1] + audit, (2, q, b)

    axioms = [(c, x, (side, *ends)) for side, known in enumerate((left, right)) for ends, (c, x) in known.items()]
    return {(a, b): w for (side, a, b), w in lightest(axioms, rules).items() if side == 2}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the crc32 of ``conv_id:turn`` chooses; a null anywhere counts as one space there, but the turn itself stays null."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), blank)
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), blank).alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    harmed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), harmed.alias("text"), F.explode(times).alias("time")).drop("time")


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


BLOCKS = "block long, roles array<string>, texts array<string>, initials string, faults string, digests array<binary>, begins boolean"


def conversation_blocks(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """conv_id and BLOCKS: rows in the order of conv_id, turn, role and text (nulls first), cut where a conversation or a block ends.

    block counts up in that order. begins: the conversation surely has no block before. faults has a letter for
    each row: b blank, t truncated, o neither. A conversation of any size spreads over the sort's partitions.
    """
    kind = next(f for f in rows.schema.fields if f.name == "conv_id")
    schema = T.StructType([T.StructField("conv_id", kind.dataType), *T.StructType.fromDDL(BLOCKS).fields])
    to_arrow = pa.schema([("block", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("initials", pa.string()), ("faults", pa.string()), ("digests", pa.list_(pa.binary())), ("begins", pa.bool_())])

    def fault(text: str) -> str:
        real = text.rstrip(BLANKS)
        return "b" if not real else "o" if real[-1] in ".!?" else "t"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        roles, texts, size, conv, begins, some = [], [], 0, None, False, False

        def block() -> pa.RecordBatch:
            row = {"block": number, "roles": roles, "texts": texts, "initials": "".join(r[:1] or "\0" for r in roles), "faults": "".join(map(fault, texts)), "digests": list(map(_digest, roles, texts)), "begins": begins}
            made = pa.RecordBatch.from_pylist([row], schema=to_arrow)
            return pa.RecordBatch.from_arrays([pa.array([conv], conv_type), *made.columns], names=schema.fieldNames())

        for b in batches:
            conv_type = b.schema.field(0).type
            for c, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if roles and (c != conv or len(roles) >= most or size + len(text) > CHARS):
                    yield block()
                    number += 1
                    begins = c != conv
                    roles, texts, size = [], [], 0
                elif not some:
                    begins = False  # the partition before may end with this conversation
                some, conv = True, c
                roles.append(role)
                texts.append(text)
                size += len(text)
        if roles:
            yield block()

    arrow_batches(rows.sparkSession)
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return rows.orderBy(*keys).select("conv_id", "role", "text").mapInArrow(run, schema)


def with_duplicates(blocks: DataFrame) -> DataFrame:
    """conv_id, block, initials, faults, begins; d in faults for a row whose role and text an earlier row of the conversation has."""
    one = blocks.select("conv_id", "block", F.posexplode("digests").alias("place", "digest"))
    first = one.groupBy("conv_id", "digest").agg(F.min(F.struct("block", "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = one.join(first.select(F.col("conv_id").alias("c"), F.col("digest").alias("h"), "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("h")))
    again = again.filter(F.struct("block", "place") != F.col("first")).groupBy("block").agg(F.collect_set("place").alias("places"))
    letters = F.transform(F.sequence(F.lit(1), F.length("faults")), lambda i: F.when(F.array_contains("places", i - 1) & (F.substring("faults", i, F.lit(1)) != "b"), "d").otherwise(F.substring("faults", i, F.lit(1))))
    known = F.when(F.col("places").isNull(), F.col("faults")).otherwise(F.array_join(letters, ""))
    return blocks.drop("roles", "texts", "digests").join(again, "block", "left").select("conv_id", "block", "initials", known.alias("faults"), "begins")


def _moves(rows: DataFrame) -> DataFrame:
    """Adds moves: (start, last, cost, audit) of each block for the states that it may be entered in."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("moves array<struct<start:int,last:int,cost:long,audit:string>>").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for initials, faults, begins in zip(*(b.column(c).to_pylist() for c in ("initials", "faults", "begins")), strict=True):
                starts = (EMPTY,) if begins else range(4)
                made.append([{"start": s, "last": q, "cost": c, "audit": a} for s in starts for q, (c, a) in derive(initials, faults, s).items()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def resolve(audit: str, initials: list[str]) -> list[str]:
    """The audit's edits by block, with roles: K and D as they are, U and A rerole, u and a insert."""
    out, q, k = [], EMPTY, 0
    for own in initials:
        edits, left = [], len(own)
        while left:
            e = audit[k]
            k += 1
            c = own[len(own) - left] if e == "K" else SPOKEN[q]
            if e != "D":
                q = NEXT[q, c]
            left -= e != "I"
            edits.append(e if e in "KD" else c.upper() if e == "R" else c)
        out.append("".join(edits))
    while k < len(audit):  # inserted after the last row
        out[-1] += SPOKEN[q]
        q, k = NEXT[q, SPOKEN[q]], k + 1
    return out


DECISIONS = "block long, edits string, audit string, cost long, blank long, duplicate long, truncated long, illegal long"


def decide(rows: DataFrame) -> DataFrame:
    """conv_id and DECISIONS: a row with edits for each block, and one for each conversation with block null and the rest."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(DECISIONS).fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, some, own, stack = None, False, [], []

        def settle() -> list[dict]:
            while len(stack) > 1:
                (_, right), (n, left) = stack.pop(), stack.pop()
                stack.append((n, compose(left, right)))
            cost, audit = min(w for (a, q), w in stack[0][1].items() if a == EMPTY and q in GOALS)
            initials = [i for _, i, _ in own]
            row, faults = "".join(initials), "".join(f for _, _, f in own)
            whole = {"audit": audit, "cost": cost, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t")}
            whole["illegal"] = sum(x + y not in LEGAL for x, y in zip(row, row[1:], strict=False))
            return [whole] + [{"block": b, "edits": e} for (b, _, _), e in zip(own, resolve(audit, initials), strict=True)]

        def send(found: list[tuple]) -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([c if n == "conv_id" else d.get(n) for c, d in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            conv_type, out = b.schema.field(0).type, []
            for r in b.to_pylist():
                if some and r["conv_id"] != conv:
                    out += [(conv, d) for d in settle()]
                    own, stack = [], []
                some, conv = True, r["conv_id"]
                own.append((r["block"], r["initials"], r["faults"]))
                stack.append((1, {(m["start"], m["last"]): (m["cost"], m["audit"]) for m in r["moves"]}))
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:  # stretches of like length
                    (n, right), (_, left) = stack.pop(), stack.pop()
                    stack.append((2 * n, compose(left, right)))
            if out:
                yield send(out)
        if some:
            yield send([(conv, d) for d in settle()])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def apply_edits(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """conv_id, block, roles, texts after repair; a block may end up empty."""
    joined = blocks.select("conv_id", "block", "roles", "texts").join(decisions.filter("block is not null").select("block", "edits"), "block").select("conv_id", "block", "edits", "roles", "texts")
    schema = joined.drop("edits").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = [], []
            for edits, old_roles, old_texts in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                rows, made = zip(old_roles, old_texts, strict=True), []
                for e in edits:
                    if e in ROLES:
                        made.append((ROLES[e], ""))
                        continue
                    role, text = next(rows)
                    if e != "D":
                        made.append((role if e == "K" else ROLES[e.lower()], text))
                roles.append([r for r, _ in made])
                texts.append([t for _, t in made])
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles, lists), pa.array(texts, lists)], names=schema.fieldNames())

    return joined.mapInArrow(run, schema)


def repair(rows: DataFrame, block_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Per conversation its faults, cost and audit (``decide``), and its repaired rows (``apply_edits``).

    rows: conv_id, turn, role, text, no null role or text. Rows go by turn, then role, then text, nulls first; repeated
    rows are rows of their own (and faults); a null conv_id is a conversation. A role that is empty has no initial: its row is
    beside an illegal pair and can't be kept. Texts may be of any length. No rows give no rows. Other columns don't matter.
    """
    blocks = materialize(conversation_blocks(rows, block_rows), "blocks")
    decisions = materialize(decide(_moves(with_duplicates(blocks))), "decisions")
    return decisions, apply_edits(blocks, decisions)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` of all its rows, newline-joined; a conversation streams through its digest."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, filled = None, None, False
        for b in batches:
            out = []
            for c, roles, texts in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, filled = c, hashlib.sha256(), False
                if roles:
                    lines = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))
                    digest.update(("\n" * filled + lines).encode())
                    filled = True
            conv_type = b.schema.field(0).type
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([d for _, d in out])], names=schema.fieldNames())
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([digest.hexdigest()])], names=schema.fieldNames())

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damage(conversations)
    decisions, repaired = repair(rows)
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [conversations.select("conv_id"), gaps, decisions.filter("block is null").drop("block", "edits"), repaired_digests(repaired)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)

    def had(c: str, default: Column) -> Column:
        return F.coalesce(F.max(c), default).alias(c)

    return whole.groupBy("conv_id").agg(*[had(c, F.lit(0).cast("long")) for c in counts], had("audit", F.lit("")), had("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key
  FROM conversations
), k AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(key, lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS kind
  FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM k WHERE kind = 3
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS c,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS real
  FROM d
), f AS (
  SELECT *, CASE WHEN real = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(real, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault,
    c || lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM o
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), steps(q, c, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, q2, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
edits AS (
  SELECT conv_id, i, q, q2, 'K' AS e, CASE fault WHEN 't' THEN 5 ELSE 0 END AS cost FROM f JOIN steps USING (c) WHERE fault IN ('o', 't')
  UNION ALL SELECT conv_id, i, q, q2, 'R', CASE fault WHEN 't' THEN 6 ELSE 1 END FROM f JOIN steps ON steps.c <> 's' WHERE fault IN ('o', 't')
  UNION ALL SELECT conv_id, i, q, q, 'D', 2 FROM f, (VALUES (0), (1), (2), (3)) AS v(q)
), best(conv_id, i, q, w) AS (
  SELECT conv_id, CAST(0 AS BIGINT), q2, printf('%012d', cost) || letters FROM s, inserts WHERE q = 0
  UNION ALL
  SELECT b.conv_id, e.i, n.q2, min(printf('%012d', CAST(substr(b.w, 1, 12) AS BIGINT) + e.cost + n.cost) || substr(b.w, 13) || e.e || n.letters)
  FROM best b JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.q = b.q JOIN inserts n ON n.q = e.q2
  GROUP BY b.conv_id, e.i, n.q2
), w AS (
  SELECT s.conv_id, CAST(substr(min(w), 1, 12) AS BIGINT) AS cost, substr(min(w), 13) AS audit
  FROM s JOIN best b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = s.n AND b.q IN (0, 3) GROUP BY s.conv_id
), l AS (
  SELECT conv_id, p, substr(audit, p, 1) AS e, count(*) FILTER (substr(audit, p, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i
  FROM (SELECT conv_id, audit, unnest(generate_series(1, length(audit))) AS p FROM w)
), m AS (
  SELECT l.conv_id, p, e, f.role, f.text, f.c, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS m
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND e <> 'I' WHERE e <> 'D'
), r AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m + opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS h
  FROM (SELECT *, coalesce(max(CASE WHEN m = 1 AND e = 'K' AND c = 's' THEN 1 END) OVER (PARTITION BY conv_id), 0) AS opened FROM m)
  GROUP BY conv_id
)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id
"""
QUERY = ("op13_chat_repair", op13_chat_repair)
