"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, its reply as the
only text under the loss mask. A turn is written as ``[role]text</s>``. Inside roles and texts three
characters are escaped, backslash, ``[`` and ``<``, to a backslash and a letter, so a control string
can't appear in a text and plain splitting reads an output back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm.common import table

END = "</s>"


def escaped(c: Column) -> Column:
    for plain, code in (("\\", "\\e"), ("[", "\\b"), ("<", "\\l")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in (("<", "\\l"), ("[", "\\b"), ("\\", "\\e")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, target, formatted, loss_start, loss_chars: one row for each example.

    target counts turns from 1; loss_start and loss_chars are the span of the escaped reply, in code
    points from 0. A conversation that doesn't end with an assistant turn has one more row, for
    its whole text, with target null and an empty span: its last turns are in no example but are kept.
    Turns go by turn, then role, then text (nulls first); null role and text count as empty; repeated
    rows are turns of their own; a null conv_id is a conversation. No rows give no rows.
    """
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    heads = F.transform("t", lambda t: F.concat(F.lit("["), F.replace(escaped(t.role), F.lit("]"), F.lit("\\r")), F.lit("]")))
    bodies = F.transform("t", lambda t: escaped(t.text))
    whole = whole.withColumns({"head": heads, "body": bodies})
    whole = whole.withColumn("written", F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(END))))
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i).role == "assistant")
    last = F.element_at("t", -1).role == "assistant"
    rows = whole.withColumn("target", F.explode(F.when(last, at).otherwise(F.concat(at, F.array(F.lit(None).cast("int"))))))
    context = F.array_join(F.slice("written", 1, F.col("target") - 1), "")
    reply = F.element_at("body", F.col("target"))
    example = F.concat(context, F.element_at("head", F.col("target")), reply, F.lit(END))
    return rows.select(
        "conv_id",
        "target",
        F.when(F.col("target").isNull(), F.array_join("written", "")).otherwise(example).alias("formatted"),
        F.when(F.col("target").isNull(), 0).otherwise(F.length(context) + F.length(F.element_at("head", F.col("target")))).cast("long").alias("loss_start"),
        F.when(F.col("target").isNull(), 0).otherwise(F.length(reply)).cast("long").alias("loss_chars"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.slice(F.split(formatted, END, -1), 1, F.size(F.split(formatted, END, -1)) - 1)
    return F.transform(pieces, lambda p: F.struct(unescaped(F.replace(F.substring_index(F.substring(p, F.lit(2), F.length(p)), "]", 1), F.lit("\\r"), F.lit("]"))).alias("role"), unescaped(F.substring(p, F.instr(p, "]") + 1, F.length(p))).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from nothing but its formatted rows and their spans."""
    span = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    rows = examples.select("conv_id", "target", F.length("formatted").cast("long").alias("chars"), "formatted", F.when(F.col("target").isNotNull(), F.struct("target", unescaped(span).alias("text"))).alias("loss"))
    by = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "chars").alias("longest"), F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x.text), "").alias("loss"), F.sum("chars").alias("formatted_chars")
    )
    turns = read_back(F.col("longest"))
    return by.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, i AS turn, if(i = 0, 'user', 'assistant') AS role, '{said}' AS text FROM (SELECT explode(array(0L, 1L)) AS i)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(extra)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(text) + 6
      + length(role) - length(replace(replace(replace(replace(role, chr(92), ''), '[', ''), '<', ''), ']', ''))
      + length(text) - length(replace(replace(replace(text, chr(92), ''), '[', ''), '<', '')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
QUERY = ("op9_chat_format", op9_chat_format)
