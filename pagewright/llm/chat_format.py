r"""Chat formatting by prefix-target expansion. DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, then
the reply, which alone is trainable. A conversation that doesn't end with an assistant turn
has one more example without a target, so that no turn is lost. A turn is written as

    ### ROLE: TEXT</turn>\n

In ROLE and TEXT each backslash is doubled and a backslash is put inside ``</``, ``##`` and
(in ROLE) ``: ``; so ``</turn>`` only ever ends a turn, and deleting the backslash before any
character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
HEAD, COLON, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("</"), F.lit("<\\/")), "#(?=#)", r"#\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, example (the number of its last turn), formatted, and target_start and
    target_end, the code points of ``formatted`` under the loss mask (null: none).

    Rows with the same turn are ordered by role and text; repeated rows are turns of their
    own; null text and role count as empty, a null turn comes first, rows with a null conv_id
    are one conversation. An empty table gives no rows; other columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # Turns are numbered and rendered once; examples are prefixes of the same array.
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(COLON)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("reply"))).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["reply"] | (i == F.size("turns")))
    each = whole.select("conv_id", "turns", F.explode(ends).alias("example"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    each = each.select("conv_id", "example", context.alias("context"), F.element_at("turns", F.col("example")).alias("last"))
    start = F.when(F.col("last.reply"), F.length("context") + F.length("last.head"))
    return each.select(
        "conv_id",
        (F.col("example") - 1).alias("example"),
        F.concat("context", "last.head", "last.body", F.lit(END)).alias("formatted"),
        start.alias("target_start"),
        (start + F.length("last.body")).alias("target_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a formatted example."""
    parts = F.split(formatted, r"</turn>\n")

    def turn(part: Column) -> Column:
        at = F.instr(part, COLON)
        role = part.substr(F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        return F.struct(unescape(role).alias("role"), unescape(part.substr(at + len(COLON), F.length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped; empty where there is no target."""
    return F.coalesce(unescape(formatted.substr(start + 1, end - start)), F.lit(""))


def chat_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars and n_examples."""
    loss = masked_text(F.col("formatted"), F.col("target_start"), F.col("target_end"))
    by_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = read_turns(F.col("longest"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by_conv.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
