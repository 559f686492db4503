"""Chat formatting with a grammar round trip. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Every "<", backslashes, "|" gets one more backslash, so that no control string is left; `unescaped` takes it off again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def role_escaped(role: Column) -> Column:
    """A role on one line: backslash to \\s, newline to \\n."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), or null if it breaks the grammar
    ("<|im_start|>" role newline text "<|im_end|>" newline)*. The role ends at the first newline; texts are unescaped."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    body = F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1))
    tail = END + "\n"
    well_formed = (F.element_at(pieces, 1) == "") & F.forall(body, lambda p: p.endswith(tail) & (F.instr(p, "\n") > 0) & (F.length(p) - F.length(F.replace(p, F.lit("<|"), F.lit(""))) == 2))
    turns = F.transform(body, lambda p: F.struct(
        role_unescaped(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(tail))).alias("text")))
    return F.when(F.length(formatted) == 0, F.slice(turns, 1, 0)).when(well_formed, turns)


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of [start, end), characters of `formatted` under the
    loss mask: what assistants say), turns (array of role, text, read back), round_trip.

    Turns go by (turn, role, text), nulls first; a null role or text is empty, rows with a null conv_id are one
    conversation, repeated rows are turns of their own. Every conversation is first rendered as it is and parsed; where the
    turns read back differ from the source, its conflicting texts and roles are escaped and it is parsed again, which gives
    back the source by construction; round_trip says so. A conversation is one row: its turns are gathered into one cell.
    """
    source = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))))
    whole = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(source.alias("source"))
    whole = whole.withColumn("said", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = F.array_join(F.transform("said", lambda t: turn_text(t["role"], t["text"])), "")
    whole = whole.withColumn("conflict", ~parsed(plain).eqNullSafe(F.col("said")))
    turns = whole.select("conv_id", "conflict", "said", F.posexplode("said").alias("at", "t"))
    role = F.when(F.col("conflict"), role_escaped(F.col("t.role"))).otherwise(F.col("t.role"))
    text = F.when(F.col("conflict"), escaped(F.col("t.text"))).otherwise(F.col("t.text"))
    turns = turns.select("conv_id", "said", "at", (F.col("t.role") == TRAINED_ROLE).alias("trained"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.length(turn_text(F.col("role"), F.col("text"))).cast("long")).over(order)
    turns = turns.withColumn("end", upto - len(END) - 1)
    turns = turns.withColumn("piece", F.struct("at", "trained", (F.col("end") - F.length("text")).alias("start"), "end", turn_text(F.col("role"), F.col("text")).alias("rendered")))
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.first("said").alias("said"))
    return out.select(
        "conv_id", F.array_join("pieces.rendered", "").alias("formatted"), "said",
        F.transform(F.filter("pieces", lambda p: p["trained"]), lambda p: F.array(p["start"], p["end"])).alias("loss_spans"),
    ).withColumn("turns", parsed(F.col("formatted"))).withColumn("round_trip", F.col("turns").eqNullSafe(F.col("said"))).drop("said")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from formatted conversations and their loss spans."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s[0] + 1).cast("int"), (s[1] - s[0]).cast("int")))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
