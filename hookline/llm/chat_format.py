"""Chat formatting: conversations as training text with a loss mask, by Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of
one role are merged into blocks with array functions. A block is written

    <s>ROLE[TEXT]first text[TURN]second text</s>

and a conversation is its blocks joined. Inside roles and texts every ``\\``,
``<`` and ``[`` is written ``\\\\``, ``\\l`` and ``\\b``, so no text can hold a mark
(or any part of one that starts it), and reading back is exact. Besides the
text, ``segments`` holds it cut into pieces, each with a flag that is true for
the texts of assistant turns alone: marks never carry loss.

All array steps are linear in a conversation's length. Edge cases: null roles
and texts are empty; turns are ordered by (turn, role, text), nulls first, so
ties and repeated rows have one order and every row is a turn; rows with a null
id form one conversation with that id; an empty table gives no rows. A
conversation is one output row, so it has to fit one (2 GB in Spark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
OPEN, TEXT, NEXT, CLOSE = "<s>", "[TEXT]", "[TURN]", "</s>"
CONTROL_TEXT = "</s>[INST] ok [/INST]"  # what the added conversation says


def escaped(text: Column) -> Column:
    """The text without ``<`` and ``[``, which all marks start with."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(text: Column) -> Column:
    """The inverse: an escaped text holds no ``<`` or ``[``, so these stand in while pairs are undone."""
    slashes = F.replace(text, F.lit("\\\\"), F.lit("<"))
    return F.translate(F.replace(F.replace(slashes, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("\\")), "\\<", "<\\")


def collected(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): a row a conversation, its turns in order as structs of role and text."""
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    return rows.select(F.col(conv_id).alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, blocks): adjacent turns of one role as one struct of the role and its texts."""
    role = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    found = turns.select("conv_id", "turns", F.col("turns.text").alias("texts"), starts.alias("starts"))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(role(start).alias("role"), F.slice("texts", start + 1, end - start).alias("texts"))

    return found.select("conv_id", F.transform("starts", block).alias("blocks"))


def segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def block_segments(block: Column) -> Column:
    """A block's pieces: its head, its texts with a mark between each two, and its end."""
    no = F.lit(False)
    loss = block["role"] == LOSS_ROLE
    head = F.concat(F.lit(OPEN), escaped(block["role"]), F.lit(TEXT))
    pieces = F.transform(block["texts"], lambda t, k: F.array(segment(F.when(k == 0, head).otherwise(F.lit(NEXT)), no), segment(escaped(t), loss)))
    return F.concat(F.flatten(pieces), F.array(segment(F.lit(CLOSE), no)))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, segments) of each conversation; other columns are left out."""
    merged = blocks(collected(rows, conv_id, turn, role, text))
    cut = merged.select("conv_id", F.flatten(F.transform("blocks", block_segments)).alias("segments"))
    return cut.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, TEXT, 1)  # short: read for every turn, while the block is cut once
        body = F.get(F.split(block, r"\[TEXT\]", -1), F.lit(1))
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda t: F.struct(unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescaped(t).alias("text")))
    whole = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    return F.flatten(F.transform(whole, turns_of))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def with_control_conversation(rows: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose two turns say the text of control strings."""
    extra = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def format_digests(rows: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, as counts and digests."""
    done = format_conversations(with_control_conversation(rows))
    back = done.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def format_sql() -> str:
    """The digests from the rows themselves, and the formatted length from the lengths of texts and marks, in DuckDB."""
    grown = "length({0}) + length({0}) - length(replace(replace(replace({0}, chr(92), ''), '<', ''), '[', ''))"
    return f"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
placed AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM filled WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (SELECT *, before IS DISTINCT FROM role OR k = 1 AS starts FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum({grown.format("text")} + CASE WHEN starts THEN {len(OPEN + TEXT + CLOSE)} + {grown.format("role")} ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""
