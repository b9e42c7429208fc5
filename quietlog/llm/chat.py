"""Chat formatting with a grammar round trip, in Spark SQL functions only.

A conversation is rendered as turns ``### role: text</turn>`` and a line end; in the grammar
a text holds neither ``### `` nor ``</turn>``. Every turn is parsed again with `parse`; only if
the parsed turn differs from its source are the control strings in its text escaped, and
the whole conversation is parsed and compared once more. A backslash after the first character breaks a control string up, so an
escaped text holds none, and one more backslash escapes the escape. The parser always
takes one such backslash away; texts without control strings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "</turn>\n"
_HEAD = "### "
_AFTER_ROLE = ": "
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>")
    return F.regexp_replace(text, r"#(\\*)## ", r"#\\$1## ")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)/turn>", r"<$1/turn>")
    return F.regexp_replace(text, r"#\\(\\*)## ", r"#$1## ")


def _escape_role(role: Column) -> Column:
    """Roles are names; characters that end a role or a turn are spelled out."""
    for plain, spelled in (("~", "~0"), (":", "~1"), ("<", "~2"), ("\n", "~3"), ("\r", "~4")):
        role = F.replace(role, F.lit(plain), F.lit(spelled))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, spelled in (("\r", "~4"), ("\n", "~3"), ("<", "~2"), (":", "~1"), ("~", "~0")):
        role = F.replace(role, F.lit(spelled), F.lit(plain))
    return role


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_HEAD), _escape_role(role), F.lit(_AFTER_ROLE), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns. A text that breaks the grammar is null."""
    turns = F.split(formatted, r"</turn>\n", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn(part: Column) -> Column:
        head = F.regexp_extract(part, r"^### [^:]*: ", 0)
        role = F.substring(head, F.lit(len(_HEAD) + 1), F.length(head) - (len(_HEAD) + len(_AFTER_ROLE)))
        body = F.substring(part, F.length(head) + 1, F.length(part))
        valid = ~(F.contains(body, F.lit(_HEAD)) | F.contains(body, F.lit("</turn>")))
        return F.struct(_unescape_role(role).alias("role"), F.when(valid, unescape(body)).alias("text"))

    return F.transform(turns, turn)


def _recovers(rendered: Column, role: Column, text: Column) -> Column:
    """True if the rendered turn parses to exactly this one turn."""
    turns = parse(rendered)
    first = F.try_element_at(turns, F.lit(1))
    return (F.size(turns) == 1) & first["role"].eqNullSafe(role) & first["text"].eqNullSafe(text)


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    loss_spans are (start, length) in code points of ``formatted``: the texts of the turns
    of `loss_role`, in order, still escaped.

    Null text or role: empty. Rows with equal turn (and null turns, which come first)
    are ordered by role, then text; repeated rows stay. Null conv_id: a conversation of its
    own. Empty table: no rows. Other columns are ignored. A conversation that can't be
    recovered from its output stops the job.
    """
    role, text = F.col("role"), F.col("text")
    raw = F.col("raw")
    turns = (
        conversations.select(
            F.col("conv_id"), F.col("turn"),
            F.coalesce(role.cast("string"), F.lit("")).alias("role"),
            F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        )
        .withColumn("raw", _render(role, text))
        .select(
            "conv_id", "turn", "role", "text",
            F.when(_recovers(raw, role, text), raw).otherwise(_render(role, escape(text))).alias("rendered"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("rendered").cast("long")).over(order), F.lit(0).cast("long"))
    head = F.length(_escape_role(role)) + len(_HEAD) + len(_AFTER_ROLE)
    placed = turns.withColumn("before", before).select(
        "conv_id",
        F.struct("before", "turn", "role", "text", "rendered").alias("t"),
        F.when(
            role == F.lit(loss_role),
            F.struct(
                (F.col("before") + head).alias("start"),
                (F.length("rendered") - head - len(END)).cast("long").alias("length"),
            ),
        ).alias("loss"),
    )
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns"), F.array_sort(F.collect_list("loss")).alias("loss_spans")
    ).select(
        "conv_id", "loss_spans", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.rendered"), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    checked = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation not recovered: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return whole.select("conv_id", "n_turns", checked.alias("formatted"), "loss_spans")


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, one turn behind the other."""
    return F.array_join(
        F.transform(
            loss_spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )
