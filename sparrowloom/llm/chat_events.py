"""Chat formatting: conversations rebuilt from event logs, then rendered.

Events (conv_id, seq, kind, turn, role, text) are folded per message before any
conversation is put together:

    message     opens the turn's message with a role and a text
    delta       appends its text to the turn's open message
    edit        replaces the turn's text by its own
    regenerate  empties the turn and every later one; what follows fills them anew

An event is void if a later edit or message of its turn, or a later regenerate
of its turn or an earlier one, replaces it; the message is the join, in order,
of those that remain. Windows over the log decide that; then one aggregation per
message and one per conversation build the texts.

The template frames a turn as <|im_start|>role, line break, text, <|im_end|>,
line break. Control strings inside a role or text (CONTROL, of several model
families) get a backslash after their first character, and backslashes double,
so that a text never ends or opens a turn; unescaping gives back every
character. The loss mask covers the assistant's escaped texts: spans of
characters and of bytes in the rendered string.

A rendered conversation is one value, so one conversation's turns meet in one
group: its size is that of the output row.

Defined results: a null text is empty, a null role is an empty role; events
with a null conv_id belong to one conversation of null id, those with a null
turn to a turn before all others; events of equal seq apply in the order of
kind (regenerate, message, edit, delta), then text, and repeats apply again; a
null seq comes before all others; a null or unknown kind fails the job, since
what it means cannot be told; a turn without any event in force is left out; a
long text is one value like any other; an empty log gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

# Strings with a meaning to common chat templates, as patterns split after their first character.
CONTROL = (
    ("<", r"\|"),
    ("<", r"/?s>"),
    ("<", r"/?SYS>"),
    ("<", r"</?SYS>>"),
    ("<", r"start_of_turn>"),
    ("<", r"end_of_turn>"),
    (r"\[", r"/?INST\]"),
    (r"\[", r"/?SYSTEM_PROMPT\]"),
)

_ESCAPED = "(" + "|".join(f"{first}(?={'|'.join(rest for own, rest in CONTROL if own == first)})" for first in dict.fromkeys(f for f, _ in CONTROL)) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _ESCAPED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role's line breaks are escaped too, since the first plain one ends the header."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages in force when the log ends."""
    kind = F.col("kind")
    rank = F.when(kind == "regenerate", 0).when(kind == "message", 1).when(kind == "edit", 2).when(kind == "delta", 3)
    rank = rank.otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    own = events.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("seq").cast("bigint").alias("seq"),
        rank.alias("rank"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63))).alias("turn_key"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The place of an event in the log; the latest reset of a turn is a regenerate of it or of an earlier one.
    at = F.struct("seq", "rank")
    regenerated = F.max(F.when(F.col("rank") == 0, at)).over(Window.partitionBy("conv_id").orderBy("turn_key").rangeBetween(Window.unboundedPreceding, 0))
    replaced = F.max(F.when(F.col("rank").isin(1, 2), at)).over(Window.partitionBy("conv_id", "turn_key"))
    marked = own.withColumn("at", at).withColumn("regenerated", regenerated).withColumn("replaced", replaced)
    alive = marked.where("rank <> 0 and (regenerated is null or at > regenerated) and (replaced is null or at >= replaced)")
    return (
        alive.groupBy("conv_id", "turn_key")
        .agg(F.max_by("role", F.struct(F.col("role") != "", "seq", "role")).alias("role"), F.array_sort(F.collect_list(F.struct("seq", "rank", "text"))).alias("parts"), F.first("turn").alias("turn"))
        .select("conv_id", "turn", "turn_key", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans of the mask as start and end characters and bytes, from 0, end exclusive."""
    parts = messages.select("conv_id", "turn_key", "role", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    sized = parts.withColumn("piece", F.concat("head", "body", F.lit(f"{CLOSE}\n")))
    before = Window.partitionBy("conv_id").orderBy("turn_key").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    octets = F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.octet_length("head")
    placed = sized.select(
        "conv_id",
        F.struct(
            "turn_key",
            "piece",
            F.when(
                F.col("role") == loss_role,
                F.struct(chars.alias("start"), (chars + F.length("body")).alias("end"), octets.alias("start_byte"), (octets + F.octet_length("body")).alias("end_byte")),
            ).alias("span"),
        ).alias("turn"),
    )
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold_events(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns of role and text, loss_text, formatted_chars), parsed from the rendered string and its mask alone."""
    chunks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda c: c != "")
    header = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"
    turn = lambda c: F.struct(
        unescape(F.regexp_extract(c, header, 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(c, header, ""), r"(?s)<\|im_end\|>\n\z", "")).alias("text"),
    )
    octets = F.encode("formatted", "utf-8")
    cut_out = lambda s: unescape(F.decode(F.substring(octets, s["start_byte"].cast("int") + 1, (s["end_byte"] - s["start_byte"]).cast("int")), "utf-8"))
    return formatted.select(
        "conv_id",
        F.transform(chunks, turn).alias("turns"),
        F.array_join(F.transform("loss_spans", cut_out), "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a log that folds to them.

    An assistant's text is streamed in two deltas; of those some (by conversation
    and place) were first another draft, which an edit replaces, or which is
    regenerated. Other texts come whole. Every row is a turn of its own; rows of
    equal turn go by role, then text, nulls first.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    event = lambda n, kind, text: F.struct((F.col("turn") * 8 + n).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = lambda n: [event(n, "message", F.lit("")), event(n + 1, "delta", F.substring(text, F.lit(1), half)), event(n + 2, "delta", F.substring(text, half + 1, F.length(text)))]
    draft = event(0, "message", F.lit("draft: ")), event(1, "delta", F.reverse(text))
    edited = F.array(*draft, event(2, "edit", F.substring(text, F.lit(1), half)), event(3, "delta", F.substring(text, half + 1, F.length(text))))
    again = F.array(*draft, event(2, "regenerate", F.lit("")), *streamed(3))
    spot = F.coalesce("conv_id", F.lit(0)) + F.col("turn")
    events = F.when(F.coalesce(F.col("role") != "assistant", F.lit(True)), F.array(event(0, "message", text))).when(F.pmod(spot, F.lit(7)) == 0, again).when(F.pmod(spot, F.lit(3)) == 0, edited).otherwise(F.array(*streamed(0)))
    rows = conversations.select("conv_id", place.alias("turn"), "role", "text")
    return rows.select("conv_id", "turn", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "turn", "role", "e.text")


def digest(parsed: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(odd).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return digest(read_back(format_conversations(events_of(rows.unionByName(extra)))))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'),
      '<(\||/?s>|/?SYS>|</?SYS>>|start_of_turn>|end_of_turn>)', '<\\\1', 'g'),
      '\[(/?INST\]|/?SYSTEM_PROMPT\])', '[\\\1', 'g') AS body
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
