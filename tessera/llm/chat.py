"""Chat formatting of typed content parts (DataFrame functions only).

A message has a role and parts: text, image, audio or document. A visitor takes the
parts in order; text is escaped, and every other part becomes a placeholder such as
`<image 3>`, numbered through the conversation, with its reference and the tokens that
it expands to recorded beside it. A turn is

    <s>[INST]role[/INST]parts</s>

A role or text that holds one of these marks, or a placeholder, gets a backslash after
the mark's first character (one more if it has some there), so nothing that a user
writes reads as a mark, and taking one backslash out gives the text back exactly.

The loss mask is carried by segments: a formatted conversation is an ordered list of
(text, loss), and loss is true for the texts of assistants and nothing else.

Turns are formatted in blocks of BLOCK turn numbers, so that a conversation with very
many turns is spread over many groups; only placing its blocks, a row each, goes by
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turn numbers that make up one block.
BLOCK = 64
#: Pixels of a side of the square that is one token; tokens of a second; tokens of a page.
PATCH, SECOND, PAGE = 28, 25, 512
KINDS = ("image", "audio", "document")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

OPEN, BETWEEN, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What follows the first character and its backslashes in a mark or placeholder.
_REST = rf"(/?s>|/?INST\]|(?:{'|'.join(KINDS)}) [0-9]+>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*+){_REST}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*+){_REST}", "$1$2$3")


def tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for: squares of PATCH pixels, SECOND a second, PAGE a page; at least 1, nulls count as least."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(1)) / PATCH)
    n = F.when(part["type"] == "image", side("width") * side("height"))
    n = n.when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND))
    n = n.when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE)
    return F.greatest(n, F.lit(1)).cast("long")


def format_blocks(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, parts) -> a row for each block of turns of a conversation, in the order of `block`.

    conv_id, block, n_turns, n_chars (code points of the block's text), segments
    (array of (text, loss)), attachments (array of (nth, kind, ref, n_tokens)).
    Turns go by turn number (null first), then role, then parts; messages that repeat
    are turns of their own. A null role is empty; null parts, and a null part, are no
    parts; a part of a type that is none of KINDS counts as text, a null text as empty.
    Null conversation ids are one conversation. An empty table gives an empty one. Other columns are not
    read. All messages of one turn number (of one conversation) are in one block.
    """
    m = messages.select("conv_id", F.floor(F.col("turn") / block).alias("block"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull()).alias("parts"))
    own = Window.partitionBy("conv_id", "block")
    m = m.withColumn("pos", F.row_number().over(own.orderBy("turn", "role", "parts")))
    p = m.select("conv_id", "block", "pos", "role", F.size("parts").alias("n_parts"), F.posexplode_outer("parts").alias("i", "part"))
    other = F.col("part.type").isin(*KINDS)
    p = p.select(
        "conv_id", "block", "pos", F.coalesce("i", F.lit(0)).alias("i"), "role", "n_parts",
        F.when(other, F.col("part.type")).alias("kind"), F.when(other, F.col("part.ref")).alias("ref"), F.when(other, tokens(F.col("part"))).alias("n_tokens"),
        F.when(~F.coalesce(other, F.lit(False)), escaped(F.coalesce("part.text", F.lit("")))).alias("text"),
    )
    p = p.withColumn("nth", F.count("kind").over(own.orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("i") == 0, F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BETWEEN))).otherwise("")
    last = F.when(F.col("i") + 1 >= F.col("n_parts"), F.lit(CLOSE)).otherwise("")
    loss = (F.col("role") == "assistant") & F.col("kind").isNull()
    row = F.struct("pos", "i", first.alias("first"), "text", loss.alias("loss"), "kind", "nth", "ref", "n_tokens", last.alias("last"))
    b = p.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("pos").cast("long").alias("n_turns"), F.count("kind").alias("n_files"))
    # the number of each block's first placeholder: a running sum over blocks
    order = Window.partitionBy("conv_id").orderBy("block")
    b = b.withColumn("before", F.sum("n_files").over(order) - F.col("n_files"))

    def pieces(r: Column) -> Column:
        mark = F.concat(F.lit("<"), r["kind"], F.lit(" "), (r["nth"] + F.col("before")).cast("string"), F.lit(">"))
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        return F.array(plain(r["first"]), F.struct(F.coalesce(r["text"], mark).alias("text"), r["loss"].alias("loss")), plain(r["last"]))

    segments = F.filter(F.flatten(F.transform("rows", pieces)), lambda s: s["text"] != "")
    files = F.transform(F.filter("rows", lambda r: r["kind"].isNotNull()), lambda r: F.struct((r["nth"] + F.col("before")).alias("nth"), r["kind"].alias("kind"), r["ref"].alias("ref"), r["n_tokens"].alias("n_tokens")))
    b = b.select("conv_id", "block", "n_turns", segments.alias("segments"), files.alias("attachments"))
    return b.select("conv_id", "block", "n_turns", F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])).alias("n_chars"), "segments", "attachments")


def whole(blocks: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, n_chars, segments, attachments. Its text has to fit a row, as a digest of it must."""
    every = F.array_sort(F.collect_list(F.struct("block", "segments", "attachments")))
    c = blocks.groupBy("conv_id").agg(F.sum("n_chars").alias("n_chars"), every.alias("blocks"))
    return c.select("conv_id", "n_chars", *[F.flatten(f"blocks.{k}").alias(k) for k in ("segments", "attachments")])


def text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from formatted text; placeholders stay in the text where they stood."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        both = F.split(F.substr(t, F.lit(len(OPEN) + 1)), r"\[/INST\]", 2)
        return F.struct(unescaped(both[0]).alias("role"), unescaped(both[1]).alias("text"))

    return F.transform(turns, turn)


def masked(segments: Column) -> Column:
    """The text under the loss mask, as it was written."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def from_texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages of one text part each."""
    part = F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col("text"), F.lit("ref"), F.lit(None).cast("string"), *[x for k, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")) for x in (F.lit(k), F.lit(None).cast(t))])
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    c = whole(format_blocks(from_texts(rows))).select("conv_id", "n_chars", text(F.col("segments")).alias("formatted"), masked(F.col("segments")).alias("learned"))
    c = c.withColumn("turns", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP12_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, regexp_replace(role || '|' || text, '([<\[])(\\*)(/?s>|/?INST\]|(?:image|audio|document) [0-9]+>)', '\1\\\2\3', 'g') AS safe FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length('<s>[INST][/INST]</s>') + length(safe) - 1)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
