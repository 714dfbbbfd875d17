"""Chat formatting with typed content parts (native: DataFrame and SQL functions only).

A conversation is a set of rows ``(conv_id, turn, role, text)``; optionally a ``parts`` column,
``array<struct<type:string, text:string, ref:string, units:int>>``, replaces ``text`` where it is not null. A visitor
over the ordered parts keeps texts, turns every image, audio and document into an ordered placeholder, and records the
attachment's reference and the number of tokens its placeholder stands for.

Template, for each turn in order::

    <|turn|>ROLE \\n BODY <|end|>

Inside roles and texts ``~`` is written ``~0``, ``<`` is ``~1``, ``[`` is ``~2`` and, in roles, a line feed is ``~3``, so no
text can hold a control string of this template or of ``[INST]``-like ones, and the original is restored exactly.

Defined results: parts of other kinds keep their text and, if they have a reference, are attachments of kind ``other`` that expand
to nothing; null text, role: empty; ties (same turn) are ordered by role, then text; repeated rows are all kept; null
``conv_id`` is a conversation of its own; an empty table gives an empty result; other columns are ignored.
The one unbounded value is a conversation itself, which is the output row; rows are pre-collected on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
_ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(c: Column, role: bool = False) -> Column:
    for raw, coded in _ESCAPES + ((("\n", "~3"),) if role else ()):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for raw, coded in reversed((*_ESCAPES, ("\n", "~3"))):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def _expanded(part: Column) -> Column:
    per = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        per = F.when(part["type"] == kind, F.lit(n)).otherwise(per)
    return per * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))


def _attached(part: Column) -> Column:
    """Whether a part is an attachment: of a known kind, or of any other with a reference."""
    kind = F.coalesce(part["type"], F.lit(""))
    return kind.isin(*TOKENS_PER_UNIT) | ((kind != "text") & part["ref"].isNotNull())


def _visit(part: Column) -> Column:
    """What a part leaves in the body: its escaped text, or a placeholder with kind and token count."""
    known = F.coalesce(part["type"].isin(*TOKENS_PER_UNIT), F.lit(False))
    attachment = F.concat(F.lit("<|"), F.when(known, part["type"]).otherwise("other"), F.lit(":"), _expanded(part).cast("string"), F.lit("|>"))
    text = escape(F.coalesce(part["text"], F.lit("")))
    return F.when(known, attachment).when(_attached(part), F.concat(text, attachment)).otherwise(text)


def format_chat(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, attachments, attachment_tokens): one row per conversation."""
    as_part = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), as_part) if "parts" in rows.columns else as_part.cast(f"array<{PART}>")
    turn = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    turns = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    one = lambda t: F.concat(F.lit(TURN), escape(t["role"], role=True), F.lit("\n"), F.array_join(F.transform(t["parts"], _visit), ""), F.lit(END))
    found = F.filter(F.flatten(F.transform("ts", lambda t: t["parts"])), _attached)
    attachments = F.transform(found, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("n_tokens")))
    return turns.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", one), "").alias("formatted"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0), lambda n, a: n + a["n_tokens"]).cast("long").alias("attachment_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; placeholders stay in the text."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def one(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        body = F.substring(piece, at + F.lit(1), F.length(piece) - at - F.lit(len(END)))
        return F.struct(unescape(F.substring(piece, F.lit(1), at - F.lit(1))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all derived from the formatted string."""
    back = formatted.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("ts"))
    loss = F.array_join(F.transform(F.filter("ts", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_chat(rows.unionByName(probe)))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), chr(10), '~3'))
     + length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
