"""Chat formatting by folding an event log (DataFrame functions only).

A conversation is a log of events ``(conv_id, seq, message, kind, role, text)``:

``delta``       appends its text to the message,
``edit``        replaces what the message holds,
``regenerate``  empties the message and withdraws every later message that had
                begun before it (they answered the withdrawn text).

The log is folded per message first and per conversation afterwards, so that a
much-edited message or a busy key is combined before conversations meet.

Defined results: null texts and roles are empty; a null ``seq`` or ``message``
sorts first; events with equal ``seq`` are ordered by kind, then text; a null
``conv_id`` is a conversation of its own; an empty log gives no rows; columns
beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_END = "</turn>"
HEAD = "### "


def escape(text: Column) -> Column:
    """Make control strings impossible inside a text; :func:`unescape` reverses it.

    Backslashes double, ``#`` gets one in front, and the end mark is broken
    after its first character.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit(TURN_END), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def title(role: Column) -> Column:
    """Roles as they stand in headers; ``: `` cannot occur inside."""
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of finished conversations, one ``delta`` for each row of ``(conv_id, turn, role, text)``.

    Rows that share a turn stay apart: ``role`` and ``text`` order them and
    repeated rows are numbered.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select(
        "conv_id", F.col("turn").alias("seq"), F.struct("turn", "role", "text", "copy").alias("message"), F.lit("delta").alias("kind"), "role", "text"
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, role, text)`` of an event log."""
    reset = F.max(F.when(F.col("kind") != "delta", F.col("seq")))
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    messages = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        reset.alias("reset"),
        F.min("seq").alias("begun"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
    )
    alive = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    # among events at the seq of the reset itself, the deltas sort before it and are gone
    alive = F.filter(alive, lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset")) | (e["kind"] != "delta"))
    messages = messages.select(
        "conv_id", "message", "begun", "redone",
        F.element_at(F.col("log.role"), 1).alias("role"),
        F.array_join(F.transform(alive, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "").alias("text"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    withdrawn = F.coalesce(F.max("redone").over(before) > F.col("begun"), F.lit(False))
    return messages.withColumn("gone", withdrawn).filter(~F.col("gone")).select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One training text per conversation: ``(conv_id, formatted)``."""
    turn = F.concat(F.lit(HEAD), title(F.col("role")), F.lit(": "), escape(F.col("text")), F.lit(TURN_END + "\n"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", turn.alias("t")))).alias("turns")).select(
        "conv_id", F.array_join(F.col("turns.t"), "").alias("formatted")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read rendered texts back: adds ``turns``, an array of ``(role, text, start, length, in_loss)``.

    ``start`` and ``length`` give each text's place in ``formatted`` in code
    points; the loss mask is the places with ``in_loss`` (assistant texts).
    """
    parts = F.split("formatted", TURN_END + "\n", -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(body: Column, start: Column) -> Column:
        cut = F.instr(body, ": ")
        role = unescape(body.substr(F.lit(len(HEAD) + 1), cut - len(HEAD) - 1))
        raw = body.substr(cut + 2, F.length(body))
        return F.struct(
            role.alias("role"), unescape(raw).alias("text"), (start + cut + 1).cast("long").alias("start"),
            F.length(raw).cast("long").alias("length"), (role == "assistant").alias("in_loss"),
        )

    with_ends = formatted.withColumn("bodies", bodies).withColumn("starts", F.expr(
        f"slice(aggregate(bodies, array(0), (a, b) -> array_append(a, element_at(a, -1) + length(b) + {len(TURN_END) + 1})), 1, size(bodies))"
    ))
    return with_ends.withColumn("turns", F.zip_with("bodies", "starts", turn)).drop("bodies", "starts")


def format_log(events: DataFrame) -> DataFrame:
    """Fold an event log, render it, and give the texts with their parsed turns."""
    return parse(render(fold(events)))
