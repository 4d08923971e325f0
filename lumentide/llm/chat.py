"""Chat formatting from event logs, with DataFrame functions alone.

A log row is an event of a conversation: ``message`` begins a message, ``delta`` adds to
one, ``edit`` replaces its text and ``regenerate`` empties it for the deltas that follow.
Rows are ordered by ``seq`` within their conversation, folded into final messages and
rendered with marked turns. ``&`` and ``<|`` inside texts are escaped, so that a text
can't forge a control string and reading back gives what was written.

Cases: null text and role count as empty; events of one ``seq`` go message, regenerate,
edit, delta, then by role and text, so ties and repeated rows have one defined order
(a repeated message is a message of its own). A delta or edit before any message makes
a message of the role it has. A null conversation id is a conversation. Extra columns are ignored.
An empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def message_events(messages: DataFrame, seq: str = "turn") -> DataFrame:
    """A table of finished messages as a log of ``message`` events."""
    return messages.select("conv_id", F.col(seq).alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("long").alias("target"))


def streamed_events(messages: DataFrame, seq: str = "turn") -> DataFrame:
    """A log that leads to a table of finished messages. Texts come in two deltas; of three messages one is drafted and regenerated before, and one is sent unfinished and edited."""
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    clean = messages.select("conv_id", F.col(seq).alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = clean.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail, none = F.substr("text", F.lit(1), half), F.substr("text", half + 1), F.lit("")

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(events)])

    plain = log(("message", none), ("delta", head), ("delta", tail))
    redone = log(("message", tail), ("delta", head), ("regenerate", none), ("delta", head), ("delta", tail))
    edited = log(("message", head), ("delta", F.lit(" ...")), ("edit", F.col("text")))
    turn = F.col("message") % 3
    events = numbered.select("conv_id", "role", "message", F.explode(F.when(turn == 0, redone).when(turn == 1, plain).otherwise(edited)).alias("e"))
    return events.select("conv_id", (F.col("message") * 8 + F.col("e.step")).alias("seq"), "e.kind", "role", "e.text", F.col("message").alias("target"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message (from 1), role, text. ``target`` names the message that an event changes, else the latest."""
    clean = events.select(
        "conv_id", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("target").cast("long").alias("target"),
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind_rank"),
    )
    ordered = Window.partitionBy("conv_id").orderBy("seq", "kind_rank", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.greatest(F.sum((F.col("kind") == "message").cast("long")).over(so_far), F.lit(1))
    placed = clean.select("*", F.row_number().over(ordered).alias("at"), F.when(F.col("kind") == "message", latest).otherwise(F.coalesce("target", latest)).alias("message"))
    event = F.struct("at", "kind", "role", "text")
    folded = placed.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("events"))
    begins = F.array_max(F.transform("events", lambda e: F.when(e["kind"] == "delta", F.lit(0)).otherwise(e["at"])))
    live = F.filter("events", lambda e: e["at"] >= F.col("begins"))
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    return folded.withColumn("begins", begins).select("conv_id", "message", F.element_at("events", 1)["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (start from 1 and length, in code points of ``formatted``)."""
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head") + 1
    parts = parts.select("conv_id", F.struct("message", "piece", (F.col("role") == loss_role).alias("loss"), start.cast("int").alias("start"), F.length("body").alias("length")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, START.replace("|", "\\|")), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")
