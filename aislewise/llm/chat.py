"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it are context, and only its
own text is under the loss mask. A conversation whose last turn is not an assistant's gets one
more row without a trainable span, so that the output holds every turn.

Each turn is ``<|im_start|>role LF text<|im_end|> LF``. A control string inside a text gets one
backslash after its first character, and one that already has some gets one more; taking one
away restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aislewise.llm.common import text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
#: First character, backslashes, rest of a control string (ChatML and bracket style).
_REST = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE = r"(<|\[)(\\*)" + _REST
UNESCAPE = r"(<|\[)\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_turns(turns: Column) -> Column:
    """array<struct<role, text>> to an array of formatted turns."""
    return F.transform(turns, lambda t: F.concat(
        F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))


def parse_turns(formatted: Column) -> Column:
    """A formatted text back to array<struct<role, text>>."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1),
                         lambda p: F.substring(p, len(START) + 1, 2 ** 31 - 1))
    return F.transform(bodies, lambda b: F.struct(
        _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text")))


def examples(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to examples (conv_id, target, text, loss_start,
    loss_length): ``target`` counts from 0, the span is in characters of ``text``.

    Turns are ordered by (turn, role, text), so ties and repeated rows have one order and all
    stay. A null text or role is empty. A null conv_id is one conversation. The row without a
    trainable span has loss_length 0. A conversation is one row here, as its longest example is.
    """
    turn = F.struct(F.col("turn"), text_or_empty("role").alias("role"),
                    text_or_empty("text").alias("text"))
    whole = (conversations.select("conv_id", turn.alias("item")).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list("item")).alias("turns"))
             .withColumn("parts", format_turns(F.col("turns"))))
    last = F.size("turns") - 1
    wanted = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (
        F.get("turns", i)["role"] == trained_role))
    exploded = whole.select("conv_id", "turns", "parts", F.explode(wanted).alias("target"))
    reply = F.get("turns", F.col("target"))
    trained = reply["role"] == trained_role
    context = F.array_join(F.slice("parts", F.lit(1), F.col("target")), "")
    head = F.length(context) + F.lit(len(START) + 1) + F.length(_escape_role(reply["role"]))
    return exploded.select(
        "conv_id", "target",
        F.array_join(F.slice("parts", F.lit(1), F.col("target") + 1), "").alias("text"),
        head.cast("long").alias("loss_start"),
        F.when(trained, F.length(escape(reply["text"]))).otherwise(0).cast("long")
        .alias("loss_length"))


def loss_text(text: Column, start: Column, length: Column) -> Column:
    return unescape(F.substr(text, start.cast("int") + 1, length.cast("int")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars (characters of all its examples)."""
    whole = formatted.groupBy("conv_id").agg(
        F.max_by("text", "target").alias("longest"),
        F.sort_array(F.collect_list(F.struct("target", loss_text(
            F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("text"))))
        .alias("replies"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    turns = whole.select(
        "conv_id", "formatted_chars", parse_turns(F.col("longest")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["text"]), "").alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
