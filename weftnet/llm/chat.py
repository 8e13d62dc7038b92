"""Chat formatting from event logs, in DataFrame functions only.

A log holds one row for each event: conv_id, seq, turn, kind, role, text. Messages are folded first, by conversation
and turn, so that a conversation with very many events is spread over tasks; then conversations are rendered. Turns are
marked by control strings; the same strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

START, STOP, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Kinds after which a message holds the event's own text and nothing from before.
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    r"""\ becomes \\ and then <| becomes <\|, so that no control string is left and each \ is followed by \ or |."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def fold(events: DataFrame, *more: str) -> DataFrame:
    """The messages that stand at the end of a log: conv_id, turn, role, text (and more, further parts of a turn's key).

    Events of a turn count in the order of seq, ties by kind, role and text. message, edit and regenerate set the text;
    delta appends; delete removes the turn until it is set again. A regeneration also removes all later turns whose
    events came before it. Null texts are empty; the role is the last one given, or empty; null keys form groups like
    others. Further columns are ignored, texts may have any length, and an empty log gives no messages.
    """
    key = ["conv_id", "turn", *more]
    of = events.select(*key, F.struct("seq", "kind", "role", "text").alias("e")).groupBy(*key).agg(F.sort_array(F.collect_list("e")).alias("log"))
    reset = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(-1)))
    seqs = F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    now = of.select(
        *key, F.slice("log", F.greatest(reset, F.lit(0)) + 1, F.size("log")).alias("log"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_max(seqs).alias("regenerated"), F.array_max(F.transform("log", lambda e: e["seq"])).alias("seen"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", *more).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("regenerated").over(before) > F.col("seen"), F.lit(False)) | (F.coalesce(F.col("log")[0]["kind"], F.lit("")) == "delete")
    text = F.array_join(F.transform("log", lambda e: F.coalesce(e["text"], F.lit(""))), "")
    return now.withColumn("gone", gone).where(~F.col("gone")).select(*key, "role", text.alias("text"))


def render(messages: DataFrame, *more: str, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of formatted, for each text to learn).

    Messages without role or text count as empty ones. One row for each conversation: its length is bounded by what a
    row can hold. No rows give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    order = ["turn", *more]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        messages.select("conv_id", *order, head.alias("head"), escape(text).alias("body"), (role == loss_role).alias("loss"))
        .withColumn("piece", F.concat("head", "body", F.lit(STOP)))
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    )
    part = F.struct(*order, "piece", "loss", F.col("start").cast("int").alias("start"), F.length("body").alias("length"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"], p["length"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, unescaped."""
    raw = F.split(formatted, r"\Q" + STOP + r"\E")
    raw = F.slice(raw, 1, F.size(raw) - 1)
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substr(x, F.length(role(x)) + 2)
    named = lambda x: F.struct(unescape(F.replace(role(x), F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(body(x)).alias("text"))
    return F.transform(F.transform(raw, lambda x: F.substr(x, F.lit(len(START) + 1))), named)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: one message event for each row; rows of the same turn stay apart (copy)."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select(
        "conv_id", "turn", (F.row_number().over(same) - 1).alias("copy"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )


def streamed(conversations: DataFrame) -> DataFrame:
    """Finished turns as the log of how they might have come: each is drafted, regenerated, streamed, edited and streamed on.

    A row becomes a draft in two parts, a regeneration, its first third, an edit to its first half and the other half, in this
    order of seq; only the edit and what follows it stand in the end.
    """
    rows = events_of(conversations)
    n = F.length(F.coalesce("text", F.lit("")))
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    head = lambda size: F.substr("text", F.lit(1), size)
    steps = (("message", F.lit("A draft")), ("delta", F.lit(" that is dropped.")), ("regenerate", F.lit("")), ("delta", head(third)), ("edit", head(half)), ("delta", F.substr("text", half + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(k == 0), F.col("role")).alias("role"), text.alias("text")) for k, (kind, text) in enumerate(steps)))
    return rows.select("conv_id", "turn", "copy", F.explode(each).alias("e")).select("conv_id", "turn", "copy", "e.*")


def format_chats(conversations: DataFrame, log: Callable[[DataFrame], DataFrame] = events_of) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) rendered through the event log that log makes of them.

    Null roles and texts are empty, null ids and turns form groups like others and come first; rows of one turn all stay, in
    the order of role and text; texts of any length are rendered whole; further columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    return render(fold(log(conversations), "copy"), "copy")
