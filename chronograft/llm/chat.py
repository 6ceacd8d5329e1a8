r"""Chat formatting from event logs.

A log has one row an event: (conversation, sequence, message, kind, role, text), the kinds being

    message     starts a message, or replaces it whole
    delta       appends streamed text
    edit        replaces the text so far, later deltas append to it
    regenerate  drops the text so far; its own text, if any, begins the new one
    delete      takes the message away unless a later event starts it again

Events are folded by message first: the last event that isn't a delta sets the text, and the deltas after it
are joined to it once, so a stream of any length takes time in proportion to it. Then messages are ordered within
their conversation by windows, which spill, and joined to one text. A message stands where its first event
does. A conversation is one row of the result, so its messages end in one task; its events needn't.

The template of a turn is

    ### role: text</turn>\n

and texts and roles are escaped reversibly: ``\`` as ``\\``, ``#`` as ``\#`` and ``</`` as ``<\/``; in roles a space
as ``\ `` too. No escaped text holds ``##`` or ``</``, so no control string is found in one, and no escaped role
holds a space after anything but ``\``, so a turn's role ends at its first ``: ``. A backslash and the character after
it read as that character.

Defined cases: null texts and roles are empty; null kinds are messages; an unknown kind acts as an edit; a null
sequence comes first; events that tie in sequence are ordered by kind, role and text; messages that start together
are ordered by message, role and text; repeated messages are turns each if their ids differ; null conversation ids
form one conversation; an empty log gives no rows; a conversation whose messages are all deleted gives none. Texts and
roles may be of any length. Other columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronograft.llm.text import let

END = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/"), *([(" ", "\\ ")] if role else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """(conversation, at, message, role, text): each message after all of its events."""
    event = F.struct("sequence", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conversation", "message").agg(F.sort_array(F.collect_list(event)).alias("e"))

    def folded(e: Column) -> Column:
        reset = F.array_max(F.transform(e, lambda x, i: F.when(x["kind"] != "delta", i + 1).otherwise(0)))
        begun = let(reset, lambda r: F.slice(e, F.greatest(r, F.lit(1)), F.size(e)))
        named = F.filter(F.transform(e, lambda x: x["role"]), lambda x: x != "")
        return F.struct(
            F.get(e, F.lit(0))["sequence"].alias("at"),
            F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(begun, lambda x: F.when(x["kind"] == "delete", "").otherwise(x["text"])), "").alias("text"),
            (F.element_at(e, -1)["kind"] != "delete").alias("there"),
        )

    done = grouped.select("conversation", "message", let(F.col("e"), folded).alias("m")).where("m.there")
    return done.select("conversation", F.col("m.at").alias("at"), "message", F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conversation, formatted, loss_spans) of each conversation.

    loss_spans: array of (start, length) in bytes of the formatted text as UTF-8, one for each text of
    the role ``learn``, in order.
    """
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    turns = messages.select("conversation", "at", "message", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    size = lambda c: F.octet_length(c).cast("long")
    order = Window.partitionBy("conversation").orderBy("at", "message", "role", "text")
    before = F.coalesce(F.sum(size("head") + size("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select(
        "conversation", F.row_number().over(order).alias("nr"), F.concat("head", "body", F.lit(END)).alias("line"),
        F.when(F.col("role") == learn, F.struct((before + size("head")).alias("start"), size("body").alias("length"))).alias("span"))
    grouped = placed.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("nr", "line", "span"))).alias("t"))
    return grouped.select(
        "conversation", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a rendering holds."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        cut = F.struct(piece.alias("p"), F.substring_index(piece, ": ", 1).alias("h"))
        return let(cut, lambda x: F.struct(
            unescape(F.substring(x["h"], F.lit(5), F.length(x["h"]))).alias("role"),
            unescape(F.substring(x["p"], F.length(x["h"]) + 3, F.length(x["p"]))).alias("text")))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    raw = F.struct(F.encode(formatted, "utf-8").alias("b"), spans.alias("s"))
    cut = lambda b, s: F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")), "utf-8")
    return let(raw, lambda x: F.array_join(F.transform(x["s"], lambda s: unescape(cut(x["b"], s))), ""))


def table_events(table: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as the event log of a live session.

    Each message is streamed by several events of which the fold has to restore it, by turns: halves as deltas;
    a draft that is regenerated and streamed in thirds; half a text and a stray delta, then an edit; a message that is
    deleted and started again. A row's message is its place in its conversation.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = table.select(F.col("conv_id").alias("conversation"), place.alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n, text = F.length("text"), F.col("text")
    part = lambda a, b: F.substring(text, a + 1, b - a)
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    zero = F.lit(0)

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in events])

    kinds = [
        log(("message", part(zero, half)), ("delta", part(half, n))),
        log(("message", F.reverse(part(zero, half))), ("regenerate", part(zero, third)), ("delta", part(third, 2 * third)), ("delta", part(2 * third, n))),
        log(("message", part(zero, half)), ("delta", F.lit(" stray")), ("edit", text)),
        log(("message", F.lit("gone")), ("delete", F.lit("")), ("message", part(zero, third)), ("delta", part(third, n))),
    ]
    which = F.pmod("message", F.lit(4))
    events = F.when(which == 0, kinds[0]).when(which == 1, kinds[1]).when(which == 2, kinds[2]).otherwise(kinds[3])
    out = rows.select("conversation", "message", "role", F.posexplode(events).alias("i", "e"))
    return out.select("conversation", (F.col("message") * 8 + F.col("i")).alias("sequence"), "message", F.col("e.kind").alias("kind"),
                      F.when(F.col("i") == 0, F.col("role")).alias("role"), F.col("e.text").alias("text"))


def chat(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Renderings of an event log: (conversation, formatted, loss_spans)."""
    return render(fold_messages(events), learn)
