"""Chat formatting that survives a round trip.

A conversation is rendered turn by turn as ``### role: text</turn>`` and a line end. What was rendered is parsed again by the
grammar below, and a turn whose role or text comes back other than it went in is rendered anew with its control strings escaped;
its header then is ``###! ``. After escaping, no control string is left inside a text, so the second parse is always identical;
the last column says so for each conversation.

    conversation = { turn }
    turn         = ( "### " role ": " text | "###! " escaped role ": " escaped text ) "</turn>" line end

Neither role nor text of a plain turn holds ``###`` or ``</turn>``, and a plain role holds no colon. Everything is built-in
functions: one shuffle by conversation, a window for the offsets of the loss mask and an aggregate over the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's fixed strings.
PLAIN, ESCAPED, ROLE_END, TURN_END = "### ", "###! ", ": ", "</turn>\n"
#: Control strings and what stands for them; the escape character goes first when escaping and last when reading.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (":", "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    for control, mark in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(control), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for control, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(control))
    return text


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of struct(escaped, role, text). A piece that is no turn has a null role and text."""
    pieces = F.split(formatted, TURN_END.replace("\n", r"\n"))

    def turn(piece: Column) -> Column:
        escaped = F.startswith(piece, F.lit(ESCAPED))
        body = F.when(escaped, F.substr(piece, F.lit(len(ESCAPED) + 1))).otherwise(F.substr(piece, F.lit(len(PLAIN) + 1)))
        at = F.instr(body, ROLE_END)
        sound = (escaped | F.startswith(piece, F.lit(PLAIN))) & (at > 0) & ~F.contains(body, F.lit("###")) & ~F.contains(body, F.lit("</turn>"))
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(ROLE_END))
        read = lambda x: F.when(sound, F.when(escaped, unescape(x)).otherwise(x))
        return F.struct(escaped.alias("escaped"), read(role).alias("role"), read(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask (array of struct(start, length, escaped), in code points) and round_trip.

    Turns stand in the order of their number, null first; turns of one number by role and text, repeated rows as often as they
    occur. Null roles and texts count as empty. Rows without a conversation id form one conversation with a null id. The mask
    covers the text, without header and end, of each turn whose role is ``loss_role``. An empty input has no rows; other columns
    are not read, whatever their names. A conversation, and so a very long text, is a row, in the memory of a task as a whole.
    """
    source = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    plain = F.concat(F.lit(PLAIN), "role", F.lit(ROLE_END), "text", F.lit(TURN_END))
    tried = source.withColumn("plain", plain).withColumn("parsed", parse(F.col("plain")))
    first = F.get("parsed", F.lit(0))
    same = (F.size("parsed") == 1) & first.role.eqNullSafe(F.col("role")) & first.text.eqNullSafe(F.col("text"))
    marked = tried.withColumn("escaped", ~same).drop("parsed")
    with_escapes = F.concat(F.lit(ESCAPED), escape(F.col("role"), role=True), F.lit(ROLE_END), escape(F.col("text")), F.lit(TURN_END))
    rendered = marked.withColumn("rendered", F.when(F.col("escaped"), with_escapes).otherwise(F.col("plain"))).drop("plain")

    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    header = F.when(F.col("escaped"), F.length(escape(F.col("role"), role=True)) + len(ESCAPED)).otherwise(F.length("role") + len(PLAIN)) + len(ROLE_END)
    placed = rendered.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0))).withColumn("header", header)
    span = F.struct(
        (F.col("start") + F.col("header")).alias("start"), (F.length("rendered") - F.col("header") - len(TURN_END)).cast("long").alias("length"), F.col("escaped")
    )
    one = F.struct("start", "rendered", "role", "text", F.when(F.col("role") == loss_role, span).alias("span"))
    grouped = placed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(one)).alias("all"))
    joined = grouped.select("conv_id", "n_turns", F.array_join("all.rendered", "").alias("formatted"), F.filter("all.span", F.isnotnull).alias("loss_mask"), "all")
    back = parse(F.col("formatted"))
    return joined.select("conv_id", "n_turns", "formatted", "loss_mask", (F.transform(back, lambda t: F.struct(t.role, t.text)) == F.transform("all", lambda t: F.struct(t.role, t.text))).alias("round_trip"))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under a loss mask, unescaped, nothing between."""

    def read(span: Column) -> Column:
        raw = F.substr(formatted, (span.start + 1).cast("int"), span.length.cast("int"))
        return F.when(span.escaped, unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(loss_mask, read), "")
