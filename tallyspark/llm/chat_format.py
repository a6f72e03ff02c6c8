"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, runs of turns with one role become one message, and
messages become one string. A message is ``<s>role``, then ``[INST]text[/INST]`` for each of its turns, then ``</s>``.
Inside roles and texts a backslash is doubled and a control string gets one backslash after its first character, so
control strings mark structure only and every text can be read back.

Results: one row for each conversation id, null among them. Turns are ordered by turn (null first), then role, then text,
so ties and repeated rows have a defined place. A null role or text is an empty string. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
TRAINED_ROLE = "assistant"
_CONTROL = r"(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    # A single backslash between the two parts can only come from escaping; all others are in pairs.
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + _CONTROL, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(
    turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """Rows (id_column, segments, formatted): ``formatted`` is the text of all segments end to end, and a segment's
    ``loss`` says whether its text, still escaped, is learned."""
    empty = F.lit("")
    rows = turns.select(
        F.col(id_column).alias("id"), F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), empty).alias("role"), F.coalesce(F.col(text_column), empty).alias("text"),
    )
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = rows.groupBy("id").agg(sorted_turns.alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(
        index, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"])
    )
    grouped = grouped.withColumn("starts", starts)

    def message(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        role = F.get("turns", start)["role"]
        texts = F.transform(F.slice("turns", start + 1, end - start), lambda t: t["text"])
        return F.struct(role.alias("role"), texts.alias("texts"))

    grouped = grouped.select("id", F.transform("starts", message).alias("messages"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)

    def segments(m: Column) -> Column:
        inner = F.transform(
            m["texts"],
            lambda t: F.array(
                segment(F.lit(BEGIN), no), segment(escape(t), m["role"] == trained_role), segment(F.lit(END), no)
            ),
        )
        opened = F.array(segment(F.concat(F.lit(OPEN), escape(m["role"])), no))
        return F.concat(opened, F.flatten(inner), F.array(segment(F.lit(CLOSE), no)))

    made = grouped.select("id", F.flatten(F.transform("messages", segments)).alias("segments"))
    return made.select(
        F.col("id").alias(id_column), "segments", F.array_join(F.col("segments.text"), "").alias("formatted")
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of structs (role, text)."""
    messages = F.split(formatted, r"</s>")

    def turns(message: Column) -> Column:
        parts = F.split(F.substring(message, len(OPEN) + 1, 2**31 - 1), r"\[INST\]")
        return F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda part: F.struct(
                unescape(F.get(parts, F.lit(0))).alias("role"),
                unescape(F.left(part, F.length(part) - len(END))).alias("text"),
            ),
        )

    return F.flatten(F.transform(messages, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")
