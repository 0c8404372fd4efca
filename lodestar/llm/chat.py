"""Prefix-target expansion of conversations, with DataFrame functions only.

A turn is written as ``### role: text </turn>`` and a line feed. Control strings inside roles and texts are
escaped with U+241B: the sign itself as U+241B e, ``###`` as U+241B h, ``</turn>`` as U+241B t, and in roles the
colon as U+241B c; so the sign always stands before one of these letters, and the last colon-space rule below
can't be met by content. ``unescape`` turns it back exactly.

Every assistant turn is an example: all earlier turns are its context, and only its own text is trainable.
An example is a row with its whole context and its reply, so the output is quadratic in a conversation's length;
turns behind the last example are a row of their own without a context. ``digest`` reads these rows back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
# The sign and, for each control string, the letter behind the sign.
SIGN = "␛"
TEXT_CODES = (("###", "h"), ("</turn>", "t"))
ROLE_CODES = (*TEXT_CODES, (":", "c"))
TARGET = "assistant"
RUN = 256
"""Turns of a conversation are summed up in runs of so many turn numbers, so that a long one is dealt over tasks."""


def escape(text: Column, codes=TEXT_CODES) -> Column:
    out = F.replace(text, F.lit(SIGN), F.lit(f"{SIGN}e"))
    for what, letter in codes:
        out = F.replace(out, F.lit(what), F.lit(SIGN + letter))
    return out


def unescape(text: Column, codes=TEXT_CODES) -> Column:
    out = text
    for what, letter in reversed(codes):
        out = F.replace(out, F.lit(SIGN + letter), F.lit(what))
    return F.replace(out, F.lit(f"{SIGN}e"), F.lit(SIGN))


def written_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, ROLE_CODES), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def read_role(turn: Column) -> Column:
    return unescape(F.substring(turn, F.lit(len(OPEN) + 1), F.instr(turn, MIDDLE) - F.lit(len(OPEN) + 1)), ROLE_CODES)


def read_text(turn: Column) -> Column:
    at = F.instr(turn, MIDDLE) + F.lit(len(MIDDLE))
    return unescape(F.substring(turn, at, F.length(turn) - at - F.lit(len(CLOSE) - 1)))


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position, start, written, target, loss_start, loss_chars of every row of (conv_id, turn, role, text).

    position counts a conversation's rows from 0, in the order of turn, role, text (null turns first); start is
    the number of transcript characters before. target: an assistant turn; loss_start, loss_chars: the span of
    its text in written (0 characters otherwise). Null roles and texts are empty; rows with a null conv_id are
    one conversation; repeated rows are turns of their own; other columns are not read; empty tables give empty ones.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"run": F.floor(F.col("turn") / RUN), "written": written_turn(F.col("role"), F.col("text"))})
    near = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    placed = rows.withColumns({"_pos": F.row_number().over(near) - 1, "_end": F.sum(F.length("written")).over(near.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "run").agg(F.count("*").alias("n"), F.sum(F.length("written")).alias("c"))
    runs = runs.select(F.col("conv_id").alias("_c"), F.col("run").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_s"))
    joined = placed.join(runs, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("run").eqNullSafe(F.col("_r")))
    target = F.col("role") == TARGET
    return joined.select(
        "conv_id",
        "turn",
        (F.col("_pos") + F.col("_n")).alias("position"),
        (F.col("_end") + F.col("_s") - F.length("written")).alias("start"),
        "written",
        target.alias("target"),
        (F.instr("written", MIDDLE) + F.lit(len(MIDDLE) - 1)).cast("long").alias("loss_start"),
        F.when(target, F.length(escape(F.col("text")))).otherwise(0).cast("long").alias("loss_chars"),
    )


def expanded(formatted: DataFrame) -> DataFrame:
    """conv_id, position, target, last, context, reply, loss_start, loss_chars from the rows of transcripts.

    One row for each assistant turn, with the text of all turns before it; last marks a conversation's last one.
    The turns behind it, all turns if there is none, are one more row, not a target, with an empty context.
    """
    turn = F.struct("position", "start", "written", "target", "loss_start", "loss_chars")
    per = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    per = per.withColumn("end", F.coalesce(F.array_max(F.filter("rows", lambda r: r["target"])["position"]), F.lit(-1)))
    per = per.withColumns({"own": F.filter("rows", lambda r: r["target"]), "rest": F.filter("rows", lambda r: r["position"] > F.col("end"))})
    rest = F.struct(F.get("rest", F.lit(0))["position"].alias("position"), F.lit(0).cast("long").alias("start"), F.concat_ws("", F.col("rest.written")).alias("written"), F.lit(False).alias("target"), F.lit(0).cast("long").alias("loss_start"), F.lit(0).cast("long").alias("loss_chars"))
    all_rows = F.when(F.size("rest") > 0, F.concat("own", F.array(rest))).otherwise(F.col("own"))
    each = per.select("conv_id", "end", F.concat_ws("", F.col("rows.written")).alias("whole"), F.explode(all_rows).alias("r"))
    return each.select(
        "conv_id",
        "r.position",
        "r.target",
        (F.col("r.position") == F.col("end")).alias("last"),
        F.substring("whole", F.lit(1), F.col("r.start").cast("int")).alias("context"),
        F.col("r.written").alias("reply"),
        "r.loss_start",
        "r.loss_chars",
    )


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, position, context, context_chars, reply, loss_start, loss_chars: one row for each assistant turn."""
    return expanded(transcripts(turns)).where("target").select("conv_id", "position", "context", F.length("context").cast("long").alias("context_chars"), "reply", "loss_start", "loss_chars")


def rendered(turns: DataFrame, conv_id, position: int) -> str:
    """The whole text of one example: its context and its reply."""
    rows = transcripts(turns).where((F.col("conv_id") == conv_id) & (F.col("position") <= position))
    return "".join(r[0] for r in rows.orderBy("position").select("written").collect())


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    formatted_chars counts every example's context and reply, and the turns behind the last example (all turns
    if there is none). The turns are read from the last example and what is behind it. A SHA-256 can't be
    split, so a conversation's text meets in one task.
    """
    whole = F.concat("context", "reply")
    loss = unescape(F.substring("reply", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    rows = expanded(formatted).select(
        "conv_id",
        F.length(whole).alias("chars"),
        F.when(F.col("last") | ~F.col("target"), F.struct("position", whole.alias("text"))).alias("piece"),
        F.when(F.col("target"), F.struct("position", loss.alias("text"))).alias("loss"),
    )
    per = rows.groupBy("conv_id").agg(F.sum("chars").alias("chars"), F.sort_array(F.collect_list("piece")).alias("pieces"), F.sort_array(F.collect_list("loss")).alias("losses"))
    parts = F.split(F.concat_ws("", F.col("pieces.text")), CLOSE)  # content has no close; the last part is empty
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.concat(x, F.lit(CLOSE)))
    per = per.select("conv_id", "chars", turns.alias("turns"), F.concat_ws("", F.col("losses.text")).alias("loss"))
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda x: F.concat(read_role(x), F.lit("\n"), read_text(x), F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
