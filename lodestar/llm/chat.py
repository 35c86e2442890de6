"""Chat formatting (4): conversations of typed content parts, as one marked text with a loss mask.

A visitor goes over a turn's parts in order. Text is escaped; an image, audio or document part
becomes a placeholder, and its reference and expanded token count go to the attachments. Control
strings inside texts and roles are escaped reversibly: a backslash becomes `\\e`, the first
character of a control string `\\l` or `\\b`, so that an escaped text holds no control string.

Only DataFrame functions are used. A conversation's turns are gathered in one row, as its text is.

Defined results: null or empty texts are empty; a null role is an empty role; a null part or a part
without a type is text; any type but text, image and audio is a document. Turns go by (turn, role,
parts), nulls first, and equal rows all stay. A null conv_id is a conversation. An empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}

#: Tokens that a part without a count takes.
EXPANDED = {"image": 576, "audio": 250, "document": 1024}

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, r"<(/?s>)", r"\\l$1")
    return F.regexp_replace(out, r"\[(/?INST\]|IMG\]|AUDIO\]|DOC\])", r"\\b$1")


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def kind(part: Column) -> Column:
    given = F.coalesce(part["type"], F.lit("text"))
    return F.when(given.isin("text", "image", "audio"), given).otherwise("document")


def visited(part: Column) -> Column:
    """A part's piece of the body."""
    out = F.when(kind(part) == "text", escaped(part["text"]))
    for name, mark in PLACEHOLDERS.items():
        out = out.when(kind(part) == name, F.lit(mark))
    return out


def attachment(part: Column, at: Column) -> Column:
    tokens = part["tokens"]
    for name, n in EXPANDED.items():
        tokens = F.when(tokens.isNull() & (kind(part) == name), F.lit(n).cast("long")).otherwise(tokens)
    return F.struct(at.cast("int").alias("turn_index"), kind(part).alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as messages of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start and length in code points of what `train_role`
    says), attachments (turn_index, type, ref, tokens in placeholder order), attachment_tokens."""
    rows = messages.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts")).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    said = F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(OPEN), escaped(m["role"]), F.lit(CLOSE)).alias("head"), F.array_join(F.transform(m["parts"], visited), "").alias("body")))
    files = F.flatten(F.transform("m", lambda m, i: F.transform(F.filter(m["parts"], lambda p: kind(p) != "text"), lambda p: attachment(p, i))))
    chats = chats.select("conv_id", said.alias("t"), files.alias("attachments"))
    start = F.struct(F.lit(len(BEGIN)).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin, n = acc["at"] + F.length(t["head"]), F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), n.alias("length")))
        return F.struct((begin + n + len(END)).cast("int").alias("at"), F.when(t["role"] == train_role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
    return chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        formatted.alias("formatted"),
        F.aggregate("t", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), text with placeholders where parts were."""
    inner = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    turns = F.split(inner, END, -1)
    turns = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        head = F.substring_index(t, CLOSE, 1)
        body = F.substr(t, F.length(head) + len(CLOSE) + 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substr(formatted, s["start"] + 1, s["length"])), ""))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id and digests of what formatted texts say when read back."""
    turns, loss = parsed(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss_spans"))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The query's result in DuckDB SQL.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\e'), '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\]|IMG\]|AUDIO\]|DOC\])', '\\b\1', 'g') AS et,
            regexp_replace(regexp_replace(replace(role, '\', '\e'), '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\]|IMG\]|AUDIO\]|DOC\])', '\\b\1', 'g') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  3 + sum(6 + length(er) + 7 + length(et) + 4)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
