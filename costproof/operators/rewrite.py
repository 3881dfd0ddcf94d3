"""Bulk prompt rewrites: each fix is one projection over the request table, no shuffle.

A fix adds its name to ``applied`` where it changed a request and leaves every other row as it was.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from costproof import fixed
from costproof.functions import blocks as B
from costproof.functions import tokens as T
from costproof.operators.lint import LINE_BREAK, rx

_WORDS = re.compile(r"[a-z0-9']+")


def _volatile(b: Column) -> Column:
    return B.is_volatile(b["text"], T.approx_tokens(b["text"]))


def _flagged(df: DataFrame) -> DataFrame:
    """Which system blocks are volatile, computed once per row."""
    return _start(df).withColumn("_vs", F.transform("system", _volatile))


def _pick(blocks: str, flags: str, wanted: bool) -> Column:
    """Blocks whose flag has the wanted value."""
    return F.transform(
        F.filter(F.arrays_zip(F.col(blocks), F.col(flags)), lambda z: z[flags] == F.lit(wanted)),
        lambda z: z[blocks],
    )


def _plain(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: B.block(b["text"]))


def _mark_last(blocks: Column, ttl: Column) -> Column:
    last = F.size(blocks) - 1
    return F.transform(
        blocks, lambda b, i: B.block(b["text"], F.when(i == last, ttl).otherwise(b["cache"]))
    )


def _change(df: DataFrame, name: str, fires: Column, **columns: Column) -> DataFrame:
    out = df.withColumn("_fires", F.coalesce(fires, F.lit(False)))
    values = {c: F.when(F.col("_fires"), v).otherwise(F.col(c)) for c, v in columns.items()}
    values["applied"] = F.when(
        F.col("_fires"), F.array_append("applied", F.lit(name))
    ).otherwise(F.col("applied"))
    return out.withColumns(values).drop("_fires")


def _start(df: DataFrame) -> DataFrame:
    return df if "applied" in df.columns else df.withColumn("applied", F.array().cast("array<string>"))


def move_volatile_after_breakpoint(df: DataFrame) -> DataFrame:
    """Per-request content goes to the end of the system prompt; the breakpoint to the last stable
    block."""
    staged = _flagged(df).withColumn("_prefix", B.static_prefix(F.concat("system", "user")))
    staged = staged.withColumn("_v", _pick("system", "_vs", True)).withColumn(
        "_s", _pick("system", "_vs", False)
    )
    inside = F.exists("_v", lambda b: F.col("_prefix").contains(b["text"]))
    ttl = F.coalesce(
        F.try_element_at(F.filter("system", lambda b: b["cache"].isNotNull()), F.lit(1))["cache"],
        F.lit("5m"),
    )
    fires = (F.size("_v") > 0) & (F.size("_s") > 0) & ((F.col("_prefix") == "") | inside)
    rebuilt = F.concat(_mark_last(_plain(F.col("_s")), ttl), _plain(F.col("_v")))
    return _change(staged, "move_volatile_after_breakpoint", fires, system=rebuilt).drop(
        "_v", "_s", "_vs", "_prefix"
    )


def reorder_static_first(df: DataFrame) -> DataFrame:
    """Large documents move from the user part into the system prompt, in front of what varies."""
    staged = _flagged(df).withColumn(
        "_ds",
        F.transform("user", lambda b: T.approx_tokens(b["text"]) > fixed.DOCUMENT_TOKENS),
    )
    staged = staged.withColumn("_docs", _pick("user", "_ds", True)).withColumn(
        "_rest", _pick("user", "_ds", False)
    )
    front = _mark_last(
        F.concat(_plain(_pick("system", "_vs", False)), _plain(F.col("_docs"))), F.lit("5m")
    )
    rest = F.when(F.size("_rest") > 0, F.col("_rest")).otherwise(
        F.array(B.block(F.lit(""))).cast(B.BLOCK_TYPE)
    )
    return _change(
        staged,
        "reorder_static_first",
        F.size("_docs") > 0,
        system=F.concat(front, _plain(_pick("system", "_vs", True))),
        user=rest,
    ).drop("_docs", "_rest", "_ds", "_vs")


def _last_stable(df: DataFrame) -> DataFrame:
    marks = F.transform("_vs", lambda v, i: F.when(v, -1).otherwise(i))
    return _flagged(df).withColumn("_last", F.coalesce(F.array_max(marks), F.lit(-1))).drop("_vs")


def add_breakpoint_after_static(df: DataFrame) -> DataFrame:
    """A breakpoint on the last system block that is identical across calls, where none is set."""
    unset = ~F.exists("system", lambda b: b["cache"].isNotNull())
    marked = F.transform(
        "system",
        lambda b, i: B.block(b["text"], F.when(i == F.col("_last"), F.lit("5m")).otherwise(b["cache"])),
    )
    return _change(
        _last_stable(df), "add_breakpoint_after_static", unset & (F.col("_last") >= 0), system=marked
    ).drop("_last")


def move_breakpoint_to_static_end(df: DataFrame) -> DataFrame:
    """Take every breakpoint off and set one on the last stable block."""
    moved = F.transform(
        "system", lambda b, i: B.block(b["text"], F.when(i == F.col("_last"), F.lit("5m")))
    )
    return _change(
        _last_stable(df), "move_breakpoint_to_static_end", F.col("_last") >= 0, system=moved
    ).drop("_last")


def strip_courtesy_text(text: Column) -> Column:
    """A text without filler phrases and the gaps they leave."""
    out = F.regexp_replace(text, rx(fixed.COURTESY), "")
    for pattern, replacement in fixed.COURTESY_GAPS:
        out = F.regexp_replace(out, rx(pattern), replacement)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def strip_courtesy(df: DataFrame) -> DataFrame:
    """Only the matched phrases go, never the clause around them."""
    df = _start(df)
    hit = lambda b: b["text"].rlike(rx(fixed.COURTESY))
    cleaned = F.transform(
        "system",
        lambda b: B.block(
            F.when(hit(b), strip_courtesy_text(b["text"])).otherwise(b["text"]), b["cache"]
        ),
    )
    return _change(df, "strip_courtesy", F.exists("system", hit), system=cleaned)


def _drop_repeated(text: str) -> str:
    """One block's text without lines that repeat an earlier kept one.

    Lines are compared through an index of the grams two similar sets must share, so a long prompt
    is not compared line by line with itself.
    """
    kept: list[str] = []
    index: dict[tuple[str, ...], list[frozenset]] = {}
    for line in text.splitlines():
        bare = line.strip().lstrip("-*").strip()
        words = _WORDS.findall(bare.lower()) if len(bare) >= 20 else []
        grams = frozenset(zip(words, words[1:], words[2:], strict=False))
        if grams:
            need = math.ceil(fixed.DUPLICATE_THRESHOLD * len(grams) - 1e-9)
            heads = sorted(grams)[: len(grams) - need + 1]
            near = {g for head in heads for g in index.get(head, ())}
            if any(len(grams & g) / len(grams | g) >= fixed.DUPLICATE_THRESHOLD for g in near):
                continue
            for head in heads:
                index.setdefault(head, []).append(grams)
        kept.append(line)
    return "\n".join(kept)


@F.pandas_udf(ArrayType(StringType()))
def _drop_repeated_lines(blocks: pd.Series) -> pd.Series:
    return blocks.map(
        lambda texts: None if texts is None else [_drop_repeated(t) for t in texts],
        na_action="ignore",
    )


def remove_duplicate_instructions(df: DataFrame) -> DataFrame:
    """Drop the later of two system lines that say the same thing.

    The sequential rule (only kept lines count) runs per request as a small Arrow helper.
    """
    staged = _start(df).withColumn("_texts", _drop_repeated_lines(B.texts(F.col("system"))))
    breaks = lambda name, text: F.aggregate(
        name, F.lit(0), lambda a, b: a + F.regexp_count(text(b), F.lit(LINE_BREAK))
    )
    fires = breaks("_texts", lambda t: t) < breaks(
        "system", lambda b: F.regexp_replace(b["text"], f"(?:{LINE_BREAK})$", "")
    )
    cleaned = F.transform(
        F.arrays_zip("system", "_texts"),
        lambda z: B.block(z["_texts"], z["system"]["cache"]),
    )
    return _change(staged, "remove_duplicate_instructions", fires, system=cleaned).drop("_texts")


def add_output_contract(df: DataFrame, max_tokens: int = fixed.CONTRACT_MAX_TOKENS) -> DataFrame:
    """Insert the contract in front of any breakpoint and lower the cap."""
    df = _start(df)
    first_line = fixed.OUTPUT_CONTRACT.split("\n")[0]
    present = B.joined(F.col("system")).contains(first_line)
    marked = F.transform("system", lambda b: b["cache"].isNotNull())
    at = F.array_position(marked, True).cast("int")
    text = F.lit(fixed.OUTPUT_CONTRACT)
    holder = F.element_at("system", F.greatest(at, F.lit(1)))
    with_mark = F.concat(
        F.slice("system", F.lit(1), F.greatest(at - 1, F.lit(0))),
        F.array(B.block(holder["text"]), B.block(text, holder["cache"])),
        F.slice("system", F.greatest(at + 1, F.lit(1)), F.size("system")),
    )
    in_front = F.concat(F.array(B.block(text)), F.col("system"))
    return _change(
        df,
        "add_output_contract",
        ~present,
        system=F.when(at > 0, with_mark).otherwise(in_front),
        max_tokens=F.lit(max_tokens),
    )


FIXES = {
    "reorder_static_first": reorder_static_first,
    "move_volatile_after_breakpoint": move_volatile_after_breakpoint,
    "add_breakpoint_after_static": add_breakpoint_after_static,
    "move_breakpoint_to_static_end": move_breakpoint_to_static_end,
    "remove_duplicate_instructions": remove_duplicate_instructions,
    "strip_courtesy": strip_courtesy,
    "add_output_contract": add_output_contract,
}


def request_tokens(system: str = "system", user: str = "user") -> Column:
    """Input tokens of a request: the system part and the user part counted apart."""
    return T.approx_tokens(B.joined(F.col(system))) + T.approx_tokens(B.joined(F.col(user)))


def apply_safe_fixes(requests: DataFrame, order: tuple[str, ...] = fixed.SAFE_FIX_ORDER) -> DataFrame:
    """All fixes in order, with tokens, cacheable tokens and caps before and after."""
    wire = F.concat(F.col("system"), F.col("user"))
    staged = _flagged(requests).withColumn("_prefix", B.static_prefix(wire))
    df = staged.select(
        *requests.columns,
        "applied",
        request_tokens().alias("input_before"),
        T.approx_tokens(F.col("_prefix")).alias("cacheable_before"),
        F.col("max_tokens").alias("max_before"),
        F.exists(
            _pick("system", "_vs", True),
            lambda b: (F.col("_prefix") != "") & F.col("_prefix").contains(b["text"]),
        ).alias("prefix_was_volatile"),
    )
    for name in order:
        df = FIXES[name](df)
    return df.select(
        "*",
        request_tokens().alias("input_after"),
        T.approx_tokens(B.static_prefix(wire)).alias("cacheable_after"),
        F.col("max_tokens").alias("max_after"),
    )


def savings_per_1k(
    p_input: Column, p_output: Column, p_read: Column, scale: float = 1.0
) -> Column:
    """``struct(cache, input, output, net)`` a set of fixes is worth per 1,000 calls."""
    k = F.lit(1000.0 * scale)
    cache = F.greatest(F.lit(0), F.col("cacheable_after") - F.col("cacheable_before"))
    fresh_before = F.greatest(F.lit(0), F.col("input_before") - F.col("cacheable_before"))
    fresh_after = F.greatest(F.lit(0), F.col("input_after") - F.col("cacheable_after"))
    cut = F.greatest(F.lit(0), F.col("max_before") - F.col("max_after"))
    a = cache * (p_input - p_read) * k
    b = (fresh_before - fresh_after) * p_input * k
    c = cut * p_output * k
    return F.struct(
        a.alias("cache"), b.alias("input"), c.alias("output_upper_bound"), (a + b + c).alias("net")
    )


def step_savings(
    p_input: Column, p_output: Column, p_read: Column, scale: float = 1.0
) -> Column:
    """The same for one fix: a prefix that used to move counts whole, and added input is a cost."""
    k = F.lit(1000.0 * scale)
    grown = F.greatest(F.lit(0), F.col("cacheable_after") - F.col("cacheable_before"))
    newly = F.when(F.col("prefix_was_volatile"), F.col("cacheable_after")).otherwise(grown)
    delta = F.col("input_after") - F.col("input_before")
    a = newly * (p_input - p_read) * k
    b = F.greatest(F.lit(0), -delta) * p_input * k
    d = F.greatest(F.lit(0), delta) * p_input * k
    c = F.greatest(F.lit(0), F.col("max_before") - F.col("max_after")) * p_output * k
    return F.struct(
        a.alias("cache"), b.alias("input"), d.alias("input_cost"), c.alias("output_upper_bound"),
        (a + b + c - d).alias("net"),
    )
