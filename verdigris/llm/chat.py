"""Chat formatting by event-sourced reconstruction; DataFrame functions only.

A log row is an event of a conversation.  Kinds:

* ``message``     the whole text of a message (also what a null or unknown kind means);
* ``delta``       text appended to its message, as streamed;
* ``edit``        the text from here on is this one;
* ``regenerate``  what came before is withdrawn; later deltas build the answer anew (its own text starts it);
* ``delete``      the message goes, unless a later event starts it again.

Events of one ``message_id`` fold in order of ``seq`` into one message, which stands where its first event stood.  An event
without a ``message_id`` is a message of its own.

Defined results: null text is empty; null role is ``''``; a null ``seq`` sorts first; events with the same ``seq`` fold in
order of kind, role and text; repeated rows count as often as they stand there; a null conversation id is a conversation; an
empty log gives no rows; other columns are ignored, whatever their names.  Texts may be of any length.  Events and turns are
put together by stretches of ``STEP`` sequence numbers first; a finished conversation is one string, so one row, as its
readers need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Sequence numbers that fall in one step are put together first; the steps are then joined in order.
STEP = 256


def escaped(c: Column) -> Column:
    """No control string is left in the result; :func:`unescaped` gives the text back."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\n"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\n"), F.lit("\n")))


def last_known(array: str) -> Column:
    """The last role in an array of structs that is not null."""
    return F.get(F.reverse(F.filter(F.transform(array, lambda x: x["role"]), lambda r: r.isNotNull())), F.lit(0))


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message_id", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: (conv_id, seq, role, text).

    ``seq`` is that of the message's first event, the role that of the last event with one.  Streams are folded in two
    steps, by stretches of ``STEP`` sequence numbers and then by message, so a long stream is summed up where it is read.
    """
    e = events.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(seq).cast("long"), F.lit(-(2**62))).alias("seq"), F.col(message).cast("string").alias("mid"),
        F.when(F.col(kind).isin("delta", "edit", "regenerate", "delete"), F.col(kind)).otherwise("message").alias("kind"),
        F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    alone = e.where("mid is null and kind <> 'delete'").select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text")
    e = e.where("mid is not null").select("conv_id", "mid", F.floor(F.col("seq") / STEP).alias("step"), F.struct("seq", "kind", "role", "text").alias("e"))
    part = e.groupBy("conv_id", "mid", "step").agg(F.array_sort(F.collect_list("e")).alias("es"))
    starts = F.transform("es", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1)))
    part = part.withColumn("cut", F.array_max(starts)).select(
        "conv_id", "mid",
        F.struct(
            "step", F.col("es")[0]["seq"].alias("first"), (F.col("cut") >= 0).alias("fresh"),
            F.when(F.col("cut") >= 0, F.get("es", F.greatest("cut", F.lit(0)))["kind"]).alias("kind"),
            F.array_join(F.transform(F.slice("es", F.greatest("cut", F.lit(0)) + 1, F.size("es")), lambda x: x["text"]), "").alias("text"),
            last_known("es").alias("role"),
        ).alias("p"),
    )
    whole = part.groupBy("conv_id", "mid").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    whole = whole.withColumn("cut", F.greatest(F.array_max(F.transform("ps", lambda p, i: F.when(p["fresh"], i).otherwise(F.lit(0)))), F.lit(0)))
    kept = F.slice("ps", F.col("cut") + 1, F.size("ps"))
    whole = whole.select(
        "conv_id", F.col("ps")[0]["first"].alias("seq"), F.coalesce(last_known("ps"), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"), F.get("ps", F.col("cut"))["kind"].alias("kind"),
    )
    return alone.unionByName(whole.where("kind is null or kind <> 'delete' or text <> ''").select("conv_id", "seq", "role", "text"))


def format_conversations(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation from messages (conv_id, seq, role, text): ``formatted`` and ``loss_spans``.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and text escaped.  ``loss_spans`` lists, in order, for
    each turn of ``learn_role`` its index, where the turn begins, and the half-open span of its text in ``formatted``, all in
    code points.  Turns are rendered and joined by stretches of ``STEP`` sequence numbers before a conversation's
    stretches meet, so the shuffle of a long conversation is spread.
    """
    turn = messages.select(
        "conv_id", F.floor(F.col("seq") / STEP).alias("step"),
        F.struct(
            "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    chunk = turn.groupBy("conv_id", "step").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rendered = chunk.select(
        "conv_id", "step",
        F.transform("ts", lambda t: F.struct(F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learn_role).alias("learn"))).alias("ts"),
    )
    tail = len(END) + 1
    size = lambda t: F.length(t["head"]).cast("long") + F.length(t["body"]) + tail
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    laid = rendered.select(
        "conv_id", "step", "ts",
        F.aggregate("ts", zero, lambda acc, t: F.struct((acc["at"] + size(t)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))).alias("lay"),
    )
    parts = laid.select(
        "conv_id",
        F.struct(
            "step", F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))), "").alias("text"),
            F.col("lay.at").alias("chars"), F.size("ts").cast("long").alias("turns"),
            F.filter(
                F.transform("ts", lambda t, i: F.when(t["learn"], F.struct(i.cast("long").alias("turn"), F.get("lay.starts", i).alias("turn_start"), (F.get("lay.starts", i) + F.length(t["head"])).alias("start"), (F.get("lay.starts", i) + F.length(t["head"]) + F.length(t["body"])).alias("end")))),
                lambda s: s.isNotNull(),
            ).alias("spans"),
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    origin = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("turns"), F.array().cast("array<struct<chars:bigint,turns:bigint>>").alias("at"))
    whole = whole.withColumn(
        "lay", F.aggregate("ps", origin, lambda acc, p: F.struct((acc["chars"] + p["chars"]).alias("chars"), (acc["turns"] + p["turns"]).alias("turns"), F.concat(acc["at"], F.array(F.struct(acc["chars"].alias("chars"), acc["turns"].alias("turns")))).alias("at")))
    )
    moved = F.transform("ps", lambda p, i: F.transform(p["spans"], lambda s: F.struct((s["turn"] + F.get("lay.at", i)["turns"]).alias("turn"), (s["turn_start"] + F.get("lay.at", i)["chars"]).alias("turn_start"), (s["start"] + F.get("lay.at", i)["chars"]).alias("start"), (s["end"] + F.get("lay.at", i)["chars"]).alias("end"))))
    return whole.select("conv_id", F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("formatted"), F.flatten(moved).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What :func:`format_conversations` wrote: (conv_id, turns array<struct<role,text>>, loss_texts array<string>, formatted_chars).

    Turns come from the formatted text alone; loss texts are cut out of it by ``loss_spans``.
    """
    out = formatted.select("conv_id", "formatted", "loss_spans", F.filter(F.split("formatted", "<\\|im_end\\|>\\n"), lambda b: b != "").alias("blocks"))
    body = lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b))
    return out.select(
        "conv_id",
        F.transform("blocks", lambda b: F.struct(unescaped_role(F.substring_index(body(b), "\n", 1)).alias("role"), unescaped(F.substring(b, F.lit(len(START) + 2) + F.length(F.substring_index(body(b), "\n", 1)), F.length(b))).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.get("blocks", s["turn"].cast("int")), (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss_texts"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
