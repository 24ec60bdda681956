"""Chat formatting by prefix-target expansion, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template. A turn is <|role|>text</s>.
OPEN, CLOSE, END = "<|", "|>", "</s>"
ASSISTANT = "assistant"
# Strings that could be mistaken for its marks, or for those of other common templates; escaped in roles and texts.
CONTROL_STRINGS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"<\||\|>|</s>|<s>|\[/?INST\]|<</?SYS>>"
_ESCAPED = r"<\\\||\|\\>|<\\/s>|<\\s>|\[\\/?INST\]|<\\</?SYS>>"


def escape(text: Column) -> Column:
    """A control string gets a backslash after its first character, which breaks it; a backslash is doubled."""
    return F.regexp_replace(text, rf"(?s)(?={_CONTROL})(.)|(\\)", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s)(?={_ESCAPED})(.)\\|\\(\\)", "$1$2")


def prefix_target_examples(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One example per assistant turn: all turns before it as context, and only its own text trainable.

    Rows: the key, example (place of its last turn, from 1), formatted (the example's text), loss_start and loss_chars
    (its trainable code points, from 0), and is_last (it holds the whole conversation). A conversation that does not
    end in an assistant turn has one more row, without trainable text, so that no turn is lost.

    Turns are ordered by ``turn``; ties, also repeated rows, by role and text, each kept. Missing roles and texts count
    as empty; turns without a key form one conversation. Only these four columns are read. The turns of a conversation
    meet in one row, as the example that holds them all requires. The rendered text is kept once; every example is a
    prefix of it, cut when its row is read, so nothing that is stored or shuffled grows with the square of a
    conversation. An empty table gives an empty result.
    """
    rows = turns.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "key",
        "turn",
        "role",
        "text",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumns({"head_chars": F.char_length("head"), "body_chars": F.char_length("body")})
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("head_chars") + F.col("body_chars") + F.lit(len(END))
    placed = rows.select(
        "key",
        F.struct(
            F.row_number().over(order).alias("example"),
            F.concat("head", "body", F.lit(END)).alias("turn_text"),
            (F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.col("head_chars")).alias("body_at"),
            F.col("body_chars").alias("body_chars"),
            (F.col("role") == ASSISTANT).alias("target"),
        ).alias("t"),
    )
    conversations = placed.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    conversations = conversations.select(
        "key",
        F.array_join("ts.turn_text", "").alias("rendered"),
        F.size("ts").alias("n_turns"),
        F.filter(
            F.arrays_zip(
                F.col("ts.example").alias("example"),
                F.col("ts.body_at").alias("body_at"),
                F.col("ts.body_chars").alias("body_chars"),
                F.col("ts.target").alias("target"),
            ),
            lambda t: t["target"] | (t["example"] == F.size("ts")),
        ).alias("ends"),
    )
    examples = conversations.select("key", "rendered", "n_turns", F.explode("ends").alias("e"))
    end = F.col("e.body_at") + F.col("e.body_chars") + F.lit(len(END))
    return examples.select(
        F.col("key").alias(key),
        F.col("e.example").cast("long").alias("example"),
        F.substring(F.col("rendered"), F.lit(1), end.cast("int")).alias("formatted"),
        F.col("e.body_at").cast("long").alias("loss_start"),
        F.when(F.col("e.target"), F.col("e.body_chars")).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
        (F.col("e.example") == F.col("n_turns")).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), with the escapes undone."""
    pieces = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(F.regexp_extract(piece, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
            unescape(F.regexp_extract(piece, r"(?s)^<\|.*?\|>(.*)$", 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The trainable text of an example, with the escapes undone."""
    return unescape(F.substring(formatted, (loss_start + 1).cast("int"), loss_chars.cast("int")))


def conversation_digest(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: its turns and trainable texts as digests, and the total length."""
    loss = read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    lines = F.transform(
        read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    read = examples.select(
        key,
        F.char_length("formatted").alias("chars"),
        F.struct("example", loss.alias("loss")).alias("target"),
        F.when(F.col("is_last"), F.array_join(lines, "")).alias("turns"),
        F.when(F.col("is_last"), F.col("example")).alias("n_turns"),
    )
    digest = read.groupBy(key).agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns").alias("turns"),
        F.array_join(F.sort_array(F.collect_list("target"))["loss"], "").alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    return digest.select(
        key,
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("losses").cast("long").alias("loss_chars"),
        F.sha2("losses", 256).alias("loss_sha256"),
        "formatted_chars",
    )
