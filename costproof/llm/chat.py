"""Chat formatting from event logs.

A log holds, per conversation and in sequence, messages and what happened to them: streamed deltas, edits and
regenerations. It is partitioned once by conversation; windows in sequence order fold it into final messages, and
these are rendered with a template whose control strings cannot occur in a text. Only built-in functions are used.

A rendered conversation is one string, so its messages meet in one task, as its row does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template, and the control strings of other templates that texts may hold.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"([<\[])({0})(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    r"""``text`` with a backslash more inside each control string, after its first character.

    ``<s>`` becomes ``<\s>`` and ``<\s>`` becomes ``<\\s>``, so no text holds a control string afterwards and
    :func:`unescaped` restores it.
    """
    return F.regexp_replace(text, CONTROL.format(r"\\*"), r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The text that :func:`escaped` was given."""
    return F.regexp_replace(text, CONTROL.format(r"\\+").replace(r"(\\+)", r"\\(\\*)"), "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` of a log ``conv_id, seq, message, kind, role, text``.

    By ``kind``: ``message`` opens a message with its first text; ``delta`` appends; ``edit`` puts another text in
    its place; ``regenerate`` does the same and discards what later messages had until then. Other kinds
    count as deltas. Null texts are empty; a message takes the first role it names and an empty one if it names
    none; events of equal ``seq`` are taken in the order of their texts. A log without rows gives no messages.
    """
    log = events.select(
        "conv_id", "seq", F.col("message").cast("long").alias("message"), "kind", "role",
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    branch = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    log = log.withColumn("cut", branch).where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    own = Window.partitionBy("conv_id", "message")
    opens = F.col("kind").isin("message", "edit", "regenerate")
    log = log.withColumn("role", F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(own)["role"])
    log = log.withColumn("from", F.max(F.when(opens, F.col("seq"))).over(own))
    log = log.where(F.col("from").isNull() | (F.col("seq") >= F.col("from")))
    texts = F.sort_array(F.collect_list(F.struct("seq", (~opens).alias("later"), "text")))
    return log.groupBy("conv_id", "message").agg(
        F.coalesce(F.max("role"), F.lit("")).alias("role"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask``: each conversation as one text.

    ``loss_mask`` lists, as byte offsets in UTF-8, the spans of assistant texts to be learned. A null role or text
    is an empty one; messages of equal number stand in the order of their pieces. No messages, no conversations.
    """
    messages = messages.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(MIDDLE))
    parts = messages.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message", "piece").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(before), F.lit(0)) + F.octet_length("head")
    span = F.struct(begin.alias("start"), (begin + F.octet_length("body")).alias("end"))
    parts = parts.withColumn("span", span)
    grouped = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message", "piece", "span", (F.col("role") == TRAINED).alias("trained")))).alias("p")
    )
    return grouped.select(
        "conv_id",
        F.array_join("p.piece", "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["trained"]), lambda x: x["span"]).alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns of a rendered conversation."""
    pieces = F.split(formatted, END.replace("|", r"\|") + "\n")
    middle = MIDDLE.replace("|", r"\|")

    def turn(piece: Column) -> Column:
        halves = F.split(piece, middle, 2)
        role = F.substring(halves[0], len(START) + 1, 1 << 30)
        return F.struct(unescaped(role).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def masked(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    data = formatted.cast("binary")

    def cut(span: Column) -> Column:
        part = F.substring(data, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return unescaped(part.cast("string"))

    return F.array_join(F.transform(loss_mask, cut), "")
