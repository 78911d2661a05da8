"""Chat transcripts rebuilt from an event log and rendered for training, in native Spark functions only.

A log has a row per event: conversation, sequence number, kind, role and text.

* ``message``: a new message with a first text, which may be empty
* ``delta``: text streamed to the end of the latest message
* ``edit``: the latest message's text so far is replaced
* ``regenerate``: as ``edit``, but the answer is streamed again, so the text may be empty
* ``delete``: the latest message goes, with what is streamed to it later; an edit brings it back

Sequence numbers order a conversation; equal numbers are ordered by kind, role and text.  An event before any
message is ignored, as is one of an unknown kind; a null role or text is empty; a null conversation is one of
its own.  Counting messages and replacements turns the fold into grouping: the events of a message since its
last replacement, in order, are its text.

The template writes ``<|role|>``, a new line, the text, ``<|end|>`` and a new line for each turn.  Inside texts
and roles a run of backslashes between ``<`` and ``|``, or between ``|`` and ``>`` in roles, gets one more, and
loses it when read back; so no text can close a turn or open another.

A rendered conversation is one string, as training needs it, and so one row: Spark bounds it at 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape_text(role), r"\|(\\*)>", r"|$1\\>")


def unescape_role(role: Column) -> Column:
    return unescape_text(F.regexp_replace(role, r"\|\\(\\*)>", "|$1>"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the messages that stand at the end of each conversation's log."""
    kinds = F.array(*[F.lit(k) for k in ("message", "delta", "edit", "regenerate", "delete")])
    rows = events.select(
        "conv_id", "seq", F.array_position(kinds, F.col("kind")).cast("int").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("kind > 0")
    order = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumns({
        "position": F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order),
        "version": F.sum(F.when(F.col("kind") == 2, 0).otherwise(1)).over(order),
        "event": F.count(F.lit(1)).over(order),
    }).filter("position > 0")
    parts = numbered.groupBy("conv_id", "position", "version").agg(
        F.max("kind").alias("kind"),
        F.max_by("role", F.when(F.col("kind") == 1, 1).otherwise(0)).alias("role"),
        F.array_sort(F.collect_list(F.struct("event", "text"))).alias("parts"))
    latest = parts.groupBy("conv_id", "position").agg(
        F.max_by(F.struct("kind", "parts"), "version").alias("last"),
        F.min_by("role", "version").alias("role"))
    return latest.filter("last.kind < 5").select(
        "conv_id", "position", "role", F.array_join(F.col("last.parts")["text"], "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one string.

    Spans are (start, length) in code points of the formatted string, of the escaped texts a model learns from.
    """
    role, text = escape_role(F.col("role")), escape_text(F.col("text"))
    turns = messages.select(
        "conv_id", "position", (F.col("role") == TRAINED_ROLE).alias("trained"),
        F.concat(F.lit("<|"), role, F.lit("|>\n")).alias("head"), text.alias("body"))
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(END)
    placed = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", F.concat("head", "body", F.lit(END)).alias("turn"), "trained", "start",
        F.char_length("body").alias("length")))).alias("turns"))
    return whole.select(
        "conv_id", F.array_join(F.col("turns")["turn"], "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(
            t["start"].alias("start"), t["length"].cast("long").alias("length"))).alias("loss_spans"))


def parse(formatted: DataFrame, *kept: str) -> DataFrame:
    """(conv_id, formatted, kept columns, turns): roles and texts read back from rendered strings, in order."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>\n"), 1, F.size(F.split("formatted", r"<\|end\|>\n")) - 1)
    return formatted.select("conv_id", "formatted", *kept, pieces.alias("pieces")).select(
        "conv_id", "formatted", *kept, F.transform("pieces", lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"),
            unescape_text(F.substr(p, F.locate("|>\n", p) + F.lit(3))).alias("text"))).alias("turns"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold a log and render what stands: conv_id, formatted, loss_spans."""
    return render(fold_events(events))


def learned(formatted: DataFrame) -> DataFrame:
    """The rows with ``learned``: what the loss mask covers of the rendered string, cut out of it and unescaped, in order."""
    return formatted.withColumn("learned", F.array_join(F.transform("loss_spans", lambda s: unescape_text(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what can be read back from rendered conversations and their masks."""
    read = parse(learned(formatted), "learned")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def log_of(conversations: DataFrame, turn: str = "turn") -> DataFrame:
    """An event log (conv_id, seq, kind, role, text) that ends in the given messages, taken as a chat service writes one.

    Messages stand in order of turn, role and text.  Each arrives in halves, as a message and a delta; by a hash of its
    place it was first a draft that an edit replaces, or an answer that is given up and streamed again.
    """
    order = Window.partitionBy("conv_id").orderBy(turn, "role", "text")
    rows = conversations.select("conv_id", turn, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("place"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))

    def events(*kinds):
        return F.array(*[F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(kinds)])

    story = F.pmod(F.xxhash64("conv_id", "place"), F.lit(3))
    told = F.when(story == 0, events(("message", first), ("delta", rest))).when(
        story == 1, events(("message", F.concat(F.lit("draft of "), rest)), ("delta", first), ("edit", first), ("delta", rest))).otherwise(
        events(("message", F.lit("")), ("delta", rest), ("regenerate", F.lit("")), ("delta", first), ("delta", rest)))
    return placed.select("conv_id", "role", "place", F.explode(told).alias("e")).select(
        "conv_id", (F.col("place") * 8 + F.col("e.step")).cast("long").alias("seq"), "e.kind", "role", "e.text")
