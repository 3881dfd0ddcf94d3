"""Column helpers over prompt blocks: ``array<struct<text:string, cache:string>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions.grading import let

BLOCK_TYPE = "array<struct<text:string,cache:string>>"


def block(text: Column, cache: Column | None = None) -> Column:
    """One block struct."""
    return F.struct(
        text.alias("text"), (F.lit(None) if cache is None else cache).cast("string").alias("cache")
    )


def texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b["text"])


def joined(blocks: Column, separator: str = "\n\n") -> Column:
    """All block texts in wire order."""
    return F.array_join(texts(blocks), separator)


def last_breakpoint(blocks: Column) -> Column:
    """1-based position of the last block with a breakpoint, 0 when there is none."""
    marked = F.transform(blocks, lambda b, i: F.when(b["cache"].isNotNull(), i + 1).otherwise(0))
    return F.coalesce(F.array_max(marked), F.lit(0))


def static_prefix(blocks: Column) -> Column:
    """Texts up to and including the last breakpoint; empty when there is none."""
    last = last_breakpoint(blocks)
    return F.when(last > 0, joined(F.slice(blocks, F.lit(1), F.greatest(last, F.lit(1))))).otherwise(
        F.lit("")
    )


def prefix_ttl(blocks: Column, default: str = "5m") -> Column:
    """Lifetime the last breakpoint asked for."""
    named = F.filter(blocks, lambda b: b["cache"].isNotNull())
    return F.coalesce(F.try_element_at(named, F.lit(-1))["cache"], F.lit(default))


def is_volatile(text: Column, tokens: Column) -> Column:
    """Whether a block plausibly differs between requests.

    A template variable or a volatile phrase always counts; a date, time or UUID only in a block
    short enough to be a header line.
    """
    stamped = F.lit(False)
    for pattern in fixed.STAMP_PATTERNS:
        stamped = stamped | text.rlike(pattern)
    return text.rlike(fixed.VOLATILE_PHRASE) | (
        (tokens <= fixed.VOLATILE_BLOCK_MAX_TOKENS) & stamped
    )


def words(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0))


def grams_of(of: Column) -> Column:
    """Distinct 3-grams of an array of words."""
    count = F.size(of)
    at = lambda i: F.concat_ws(" ", F.get(of, i), F.get(of, i + 1), F.get(of, i + 2))
    return F.when(
        count >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count - 3, F.lit(0))), at))
    ).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct lower-case word 3-grams."""
    return let(words(text), grams_of)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two 3-gram sets; 0 when either is empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / either)


# Texts are compared over this many characters at an end first; most differ there.
NEAR = 64


def _bisected(left: Column, right: Column) -> Column:
    """Characters two texts share from the start, by bisection on equal prefixes; both are computed once."""

    def search(both: Column) -> Column:
        shortest = F.least(F.length(both["left"]), F.length(both["right"]))

        def halve(state: Column, _: Column) -> Column:
            middle = ((state["low"] + state["high"] + 1) / 2).cast("int")
            same = F.substr(both["left"], F.lit(1), middle) == F.substr(both["right"], F.lit(1), middle)
            done = state["low"] >= state["high"]
            return F.struct(
                F.when(done | ~same, state["low"]).otherwise(middle).alias("low"),
                F.when(done | same, state["high"]).otherwise(middle - 1).alias("high"),
            )

        steps = F.ceil(F.log2(shortest + 2)).cast("int")
        bounds = F.struct(F.lit(0).alias("low"), shortest.alias("high"))
        return F.aggregate(F.sequence(F.lit(1), steps), bounds, halve)["low"]

    return let(F.struct(left.alias("left"), right.alias("right")), search)


def common_prefix_length(left: Column, right: Column) -> Column:
    """Characters two texts share from the start, or null; only texts with equal starts are compared whole."""
    start = lambda t, n: F.substr(t, F.lit(1), F.lit(n))
    shortest = F.least(F.length(left), F.length(right))
    return (
        F.when(left.isNull() | right.isNull(), F.lit(None).cast("int"))
        .when(start(left, 1) != start(right, 1), F.lit(0))
        .when(start(left, NEAR) != start(right, NEAR), _bisected(start(left, NEAR), start(right, NEAR)))
        .when(left == right, shortest)
        .otherwise(_bisected(left, right))
    )


def common_suffix_length(left: Column, right: Column) -> Column:
    """Characters two texts share from the end, or null; only texts with equal ends are turned round whole."""
    end = lambda t, n: F.right(t, F.lit(n))
    shortest = F.least(F.length(left), F.length(right))
    near = _bisected(F.reverse(end(left, NEAR)), F.reverse(end(right, NEAR)))
    return (
        F.when(left.isNull() | right.isNull(), F.lit(None).cast("int"))
        .when(end(left, 1) != end(right, 1), F.lit(0))
        .when(end(left, NEAR) != end(right, NEAR), near)
        .when(left == right, shortest)
        .otherwise(_bisected(F.reverse(left), F.reverse(right)))
    )


def common_prefix(left: Column, right: Column) -> Column:
    """The shared start of two texts."""
    return F.substr(left, F.lit(1), common_prefix_length(left, right))
