"""Conversations priced turn by turn, with a cache entry that expires.

Without refresh on read the expiry clock starts at the last *write*, so what a turn does depends on
which turn wrote before it. A conversation is folded in chunks of turns, so no task ever holds a whole
long one; what a chunk starts from is the last write before it. Those writes come from a graph: every
turn points at the turn that would write next if it had written itself, and the writes are the turns
reached from the first one. Pointer doubling finds them in as many rounds as the logarithm of their
number, whatever the prefixes do. Conversations of one chunk have no pointers, and no round.

The clock of a conversation does not run back: a turn with an earlier time than one before it counts
at the latest time seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import blocks as B
from costproof.functions import tokens as T
from costproof.operators.ranks import next_marked, positions, previous_row
from costproof.runtime import cut

CHUNK = 256
STATE = "struct<key:string,written:double,ttl:int,prev:string,clock:double>"


def turns_from_blocks(turns: DataFrame, ratio: Column | float = 1.0, default_ttl: str = "5m") -> DataFrame:
    """Prefix, lifetimes and token counts of turns given as blocks.

    Tokens are the approximate counter's, scaled by ``ratio`` into the model's own units.
    """
    scale = F.lit(ratio) if isinstance(ratio, float) else ratio
    prefix = B.static_prefix(F.col("blocks"))
    staged = turns.withColumn("prefix", prefix).withColumn("text", B.joined(F.col("blocks")))
    return staged.select(
        "*",
        F.when(F.col("prefix") != "", B.prefix_ttl(F.col("blocks"), default_ttl))
        .otherwise(F.lit(default_ttl))
        .alias("ttl"),
        T.model_tokens(T.approx_tokens(F.col("prefix")), scale).alias("prefix_tokens"),
        T.model_tokens(T.approx_tokens(F.col("text")), scale).alias("total_tokens"),
    )


def paced(turns: DataFrame, gap_seconds: Column | float, start: Column | None = None) -> DataFrame:
    """Turn times from a declared gap: ``start + gap x index`` in seconds."""
    gap = F.lit(gap_seconds) if isinstance(gap_seconds, (int, float)) else gap_seconds
    begin = F.lit(0.0) if start is None else start
    return turns.withColumn("at_seconds", begin + gap * F.col("turn_index"))


def group_consecutive(tasks: DataFrame, order: str, size: int) -> DataFrame:
    """Consecutive tasks in conversations of ``size``; a trailing group of one joins the one before."""
    ranked = positions(tasks, order, "_pos")
    total = tasks.agg(F.count("*").alias("_n"))
    group = F.floor(F.col("_pos") / size)
    lonely = (F.col("_n") > size) & (F.col("_n") % size == 1) & (F.col("_pos") == F.col("_n") - 1)
    session = F.when(lonely, group - 1).otherwise(group)
    staged = ranked.crossJoin(F.broadcast(total)).withColumn("session_id", session)
    return staged.withColumn("turn_index", F.col("_pos") - F.col("session_id") * size).drop(
        "_pos", "_n"
    )


def _step(refresh: bool):
    """One turn: struct(state, events) -> struct(state, events + this one)."""

    def merge(acc: Column, row: Column) -> Column:
        s = acc["state"]
        at = F.greatest(s["clock"], row["at"])
        known = F.coalesce(s["key"] == row["key"], F.lit(False))
        expired = F.coalesce(at - s["written"] > s["ttl"], F.lit(False))
        read = known & ~expired
        event = (
            F.when(~row["cacheable"], "uncacheable")
            .when(read, "read")
            .when(known & expired, "expired")
            .when(s["key"].isNotNull(), "changed")
            .otherwise("write")
        )
        writes = row["cacheable"] & ~read
        renewed = writes | (row["cacheable"] & read) if refresh else writes
        state = F.struct(
            F.when(writes, row["key"]).otherwise(s["key"]).alias("key"),
            F.when(renewed, at).otherwise(s["written"]).alias("written"),
            F.when(writes, row["ttl"]).otherwise(s["ttl"]).alias("ttl"),
            row["key"].alias("prev"),
            at.alias("clock"),
        )
        same = F.coalesce(s["prev"] == row["key"], F.lit(False))
        out = F.struct(
            row["turn_index"].alias("turn_index"), event.alias("event"), same.alias("same_prefix")
        )
        return F.struct(state.alias("state"), F.concat(acc["events"], F.array(out)).alias("events"))

    return merge


def _fold(refresh: bool) -> Column:
    start = F.struct(
        F.col("entry").alias("state"),
        F.array().cast("array<struct<turn_index:bigint,event:string,same_prefix:boolean>>").alias("events"),
    )
    return F.aggregate("rows", start, _step(refresh))


def _pointers(turns: DataFrame, session: str, refresh: bool) -> DataFrame:
    """``session, i, to``: the cacheable turn that writes next if turn ``i`` writes.

    ``turns``: the cacheable ones, with ``i, key, at, ttl`` and the key and time of the one before. In
    the order of time stand the turns and, without refresh, the moments at which their entries would
    end; each takes the next change of prefix, or the next turn, that follows it.
    """
    change = F.when(F.col("prev_key").isNotNull() & (F.col("prev_key") != F.col("key")), F.col("i"))
    if refresh:
        gap = {f"over_{v}": F.when(F.col("at") - F.col("prev_at") > v, F.col("i")) for v in fixed.TTL_SECONDS.values()}
        linked = next_marked(turns, [session], ["i"], {"change": change, **gap})
        end = F.lit(None).cast("bigint")
        for v in fixed.TTL_SECONDS.values():
            end = F.when(F.col("ttl") == v, F.col(f"over_{v}")).otherwise(end)
        return linked.select(session, "i", F.least("change", end).alias("to"))
    moments = F.explode(F.array(
        F.struct(F.col("at").alias("moment"), F.lit(0).alias("kind")),
        F.struct((F.col("at") + F.col("ttl")).alias("moment"), F.lit(1).alias("kind")),
    ))
    line = turns.select(session, "i", change.alias("changed"), moments.alias("_m")).select(session, "i", "changed", "_m.*")
    turn = F.col("kind") == 0
    linked = next_marked(
        line, [session], ["moment", "kind", "i"],
        {"change": F.when(turn, F.col("changed")), "turn": F.when(turn, F.col("i"))},
    )
    found = linked.select(session, "i", F.when(turn, F.col("change")).otherwise(F.col("turn")).alias("to"))
    return found.groupBy(session, "i").agg(F.min("to").alias("to"))


def _reached(first: DataFrame, pointers: DataFrame, session: str) -> DataFrame:
    """Every ``session, i`` that a chain of pointers reaches from ``first``, doubling its steps each round."""
    reached, steps = cut(first), cut(pointers.where("to IS NOT NULL"))
    while True:
        new = cut(reached.join(steps, [session, "i"]).select(session, F.col("to").alias("i")))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        on = steps.select(session, F.col("i").alias("to"), F.col("to").alias("beyond"))
        steps = cut(steps.join(on, [session, "to"]).select(session, "i", F.col("beyond").alias("to")))


def _entries(chunks: DataFrame, session: str, refresh: bool) -> DataFrame:
    """``session, _chunk, entry``: what chunks after the first of a conversation start from.

    No conversation of several chunks, no entry: then there is no graph to draw.
    """
    order = Window.partitionBy(session).orderBy("_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(session)
    # One row per chunk, without the turns, is what these windows see.
    ends = chunks.select(
        session, "_chunk",
        F.array_max(F.transform("rows", lambda r: r["at"])).alias("latest"),
        F.element_at("rows", -1)["key"].alias("last_key"),
    )
    ends = ends.select(
        session, "_chunk", F.max("latest").over(before).alias("clock"), F.lag("last_key").over(order).alias("prev"),
        (F.min("_chunk").over(whole) < F.max("_chunk").over(whole)).alias("_several"),
    ).where("_several")
    if ends.isEmpty():
        return ends.select(session, "_chunk", F.lit(None).cast(STATE).alias("entry"))
    long = chunks.join(ends, [session, "_chunk"])
    clocked = F.aggregate(
        "rows",
        F.struct(F.col("clock"), F.array().cast("array<struct<i:bigint,key:string,at:double,ttl:int,cacheable:boolean>>").alias("out")),
        lambda acc, r: F.struct(
            F.greatest(acc["clock"], r["at"]).alias("clock"),
            F.concat(acc["out"], F.array(F.struct(
                r["turn_index"].alias("i"), r["key"].alias("key"), F.greatest(acc["clock"], r["at"]).alias("at"),
                r["ttl"].alias("ttl"), r["cacheable"].alias("cacheable"),
            ))).alias("out"),
        ),
    )["out"]
    turns = long.select(session, "_chunk", F.inline(clocked)).where("cacheable").drop("cacheable")
    turns = cut(previous_row(turns, [session], "i", ["key", "at"]))
    first = turns.groupBy(session).agg(F.min("i").alias("i"))
    writes = _reached(first, _pointers(turns, session, refresh), session)
    entry = F.struct("i", F.col("key"), F.col("at").alias("written"), "ttl")
    last = turns.join(writes, [session, "i"]).groupBy(session, "_chunk").agg(F.max(entry).alias("write"))
    seen = F.last("write", ignorenulls=True).over(before)
    if refresh:  # the entry in hand was renewed by the last cacheable turn before the chunk
        last = last.join(turns.groupBy(session, "_chunk").agg(F.max("at").alias("renewed")), [session, "_chunk"], "right")
        renewed = F.max("renewed").over(before)
    else:
        last, renewed = last.withColumn("renewed", F.lit(None).cast("double")), F.lit(None).cast("double")
    joined = ends.join(last, [session, "_chunk"], "left").select(
        session, "_chunk", "prev", "clock", seen.alias("write"), renewed.alias("_renewed")
    )
    state = F.struct(
        F.col("write.key").alias("key"), F.coalesce("_renewed", "write.written").alias("written"),
        F.col("write.ttl").alias("ttl"), F.col("prev"), F.col("clock"),
    )
    return joined.where("clock IS NOT NULL").select(session, "_chunk", state.cast(STATE).alias("entry"))


def cache_events(
    turns: DataFrame,
    session: str = "session_id",
    refresh_on_read: bool = False,
    minimum: Column | int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """What the cache did at every turn: write, read, expired, changed or uncacheable.

    ``turns``: session, ``turn_index, prefix, prefix_tokens, ttl, at_seconds``. Only a digest of the
    prefix travels through the fold. Result: session, ``turn_index, event, same_prefix``.
    """
    floor = F.lit(minimum) if isinstance(minimum, int) else minimum
    seconds = F.lit(fixed.TTL_SECONDS["5m"])
    for name, value in fixed.TTL_SECONDS.items():
        seconds = F.when(F.col("ttl") == name, F.lit(value)).otherwise(seconds)
    row = F.struct(
        F.col("turn_index").cast("bigint").alias("turn_index"),
        F.md5("prefix").alias("key"),
        ((F.col("prefix") != "") & (F.col("prefix_tokens") >= floor)).alias("cacheable"),
        F.col("at_seconds").cast("double").alias("at"),
        seconds.cast("int").alias("ttl"),
    )
    chunks = (
        turns.select(session, F.floor(F.col("turn_index") / chunk).alias("_chunk"), row.alias("_r"))
        .groupBy(session, "_chunk")
        .agg(F.sort_array(F.collect_list("_r")).alias("rows"))
    )
    chunks = cut(chunks)
    entries = _entries(chunks, session, refresh_on_read)
    folded = chunks.join(entries, [session, "_chunk"], "left").withColumn("_f", _fold(refresh_on_read))
    return folded.select(session, F.explode("_f.events").alias("_e")).select(
        session, "_e.turn_index", "_e.event", "_e.same_prefix"
    )


def price_turns(
    turns: DataFrame,
    session: str = "session_id",
    refresh_on_read: bool = False,
    minimum: Column | int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Turns with their cache event, buckets and cost.

    Each turn carries the price columns of the model that answered it (``input, output,
    cache_write_5m, cache_write_1h, cache_read`` as ``p_*``); give every turn one model's prices for
    the single-price reading. Cost is in the money unit of the prices, per token.
    """
    events = cache_events(turns, session, refresh_on_read, minimum, chunk)
    joined = turns.join(events, [session, "turn_index"])
    writes = F.col("event").isin("write", "changed", "expired")
    hour = F.col("ttl") == "1h"
    cached = F.col("event") != "uncacheable"
    zero = F.lit(0).cast("bigint")
    priced = joined.select(
        "*",
        F.when(cached, F.greatest(zero, F.col("total_tokens") - F.col("prefix_tokens")))
        .otherwise(F.col("total_tokens"))
        .alias("uncached_input"),
        F.when(writes & ~hour, F.col("prefix_tokens")).otherwise(zero).alias("write_5m"),
        F.when(writes & hour, F.col("prefix_tokens")).otherwise(zero).alias("write_1h"),
        F.when(F.col("event") == "read", F.col("prefix_tokens")).otherwise(zero).alias("read"),
    )
    cost = (
        F.col("uncached_input") * F.col("p_input")
        + F.col("write_5m") * F.col("p_cache_write_5m")
        + F.col("write_1h") * F.col("p_cache_write_1h")
        + F.col("read") * F.col("p_cache_read")
        + F.col("output_tokens") * F.col("p_output")
    )
    return priced.withColumn("cost", cost)


def session_totals(priced: DataFrame, keys: list[str]) -> DataFrame:
    """One row per conversation: bucket totals, misses, expired entries, both stability measures,
    and what compaction cost, dropped and made to be written again.

    ``prefix_stability_read`` counts reads, ``prefix_identical_share`` counts unchanged prefixes.
    """
    steps = F.count("*") - 1
    compaction = F.col("label") == "compaction"
    dropped = F.col("dropped_tokens") if "dropped_tokens" in priced.columns else F.lit(0)
    return priced.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.sum("uncached_input").alias("uncached_input"),
        F.sum("write_5m").alias("write_5m"),
        F.sum("write_1h").alias("write_1h"),
        F.sum("read").alias("read"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("event").isin("write", "changed", "expired").cast("int")).alias("misses"),
        F.sum((F.col("event") == "expired").cast("int")).alias("expired_entries"),
        F.sum("cost").alias("cost"),
        F.when(steps > 0, F.sum((F.col("event") == "read").cast("int")) / steps)
        .otherwise(1.0)
        .alias("prefix_stability_read"),
        F.when(steps > 0, F.sum(F.col("same_prefix").cast("int")) / steps)
        .otherwise(1.0)
        .alias("prefix_identical_share"),
        F.sum(F.when(compaction, 1).otherwise(0)).alias("compaction_turns"),
        F.sum(F.when(compaction, F.col("cost")).otherwise(0)).alias("compaction_cost"),
        F.sum(F.when(compaction, dropped).otherwise(0)).alias("dropped_tokens"),
        F.sum(
            F.when(F.col("event") == "changed", F.col("write_5m") + F.col("write_1h")).otherwise(0)
        ).alias("rewritten_tokens"),
    )


def arm_totals(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Conversations of one policy: totals, cost per success, mean stability."""
    correct = F.sum("successes")
    return sessions.groupBy(*keys).agg(
        F.count("*").alias("sessions"),
        F.sum("turns").alias("turns"),
        correct.alias("successes"),
        F.sum("cost").alias("cost"),
        F.when(correct > 0, F.sum("cost") / correct).alias("cost_per_success"),
        F.avg("prefix_stability_read").alias("prefix_stability"),
        F.sum("expired_entries").alias("expired_entries"),
        F.sum("compaction_cost").alias("compaction_cost"),
        F.sum("dropped_tokens").alias("dropped_tokens"),
        F.sum("rewritten_tokens").alias("rewritten_tokens"),
    )


def budget_gap(carried: Column, budget: Column | int) -> Column:
    """What a summary at its declared size would have added to a turn, at the rate the turn paid."""
    full = F.lit(budget) if isinstance(budget, int) else budget
    gap = F.greatest(F.lit(0), full - carried)
    rate = (
        F.when(F.col("write_1h") > 0, F.col("p_cache_write_1h"))
        .when(F.col("write_5m") > 0, F.col("p_cache_write_5m"))
        .when(F.col("read") > 0, F.col("p_cache_read"))
        .otherwise(F.col("p_input"))
    )
    return F.when((gap > 0) & (carried > 0), gap * rate).otherwise(F.lit(0))


def policy_winner(low: Column, high: Column, low_at_budget: Column, high_at_budget: Column) -> Column:
    """A policy wins only if both intervals lie on its side of 1."""
    return (
        F.when((low > 1) & (low_at_budget > 1), "immutable")
        .when((high < 1) & (high_at_budget < 1), "compact")
        .otherwise("neither")
    )


def session_findings(turns: DataFrame, session: str = "session_id", scale: float = 1.0) -> DataFrame:
    """Rules over the turns of one conversation, compaction turns left out.

    ``turns``: session, ``turn_index, text, prefix, prefix_tokens, label`` and prices ``p_*``; money
    is ``tokens x rate x scale`` per 1,000. Transitions use a lag that is safe for hot conversations;
    stranded text is a common prefix from two aggregates.
    """
    tail = F.when(
        (F.col("prefix") != "") & F.startswith("text", F.col("prefix")),
        F.substr(F.col("text"), F.length("prefix") + 1),
    ).otherwise(F.col("text"))
    work = turns.where(F.col("label") != "compaction").withColumn("tail", tail)
    staged = work.withColumn("prefix_key", F.md5("prefix")).withColumn("tail_len", F.length("tail"))
    linked = previous_row(staged, [session], "turn_index", ["prefix_key", "tail_len"])
    changed = F.col("prev_prefix_key").isNotNull() & (
        F.col("prefix_key") != F.col("prev_prefix_key")
    )
    compacted = changed & (F.col("tail_len") < F.col("prev_tail_len"))
    g = linked.groupBy(session).agg(
        F.count("*").alias("turns"),
        F.min_by("prefix_tokens", "turn_index").alias("first_tokens"),
        F.min_by(F.col("prefix") != "", "turn_index").alias("has_prefix"),
        F.sum(changed.cast("int")).alias("rewrites"),
        F.sum(compacted.cast("int")).alias("compactions"),
        F.sum(F.when(compacted, F.col("prefix_tokens")).otherwise(0)).alias("reestablished"),
        F.min("tail").alias("_lo"),
        F.max("tail").alias("_hi"),
        *[F.max(f"p_{c}").alias(f"p_{c}") for c in ("input", "cache_write_5m", "cache_read")],
    ).where(F.col("turns") >= 2)
    stable = B.common_prefix(F.col("_lo"), F.col("_hi"))
    g = g.withColumn("_stable", stable).withColumn(
        "stranded",
        F.when(
            F.length("_stable") >= fixed.MIN_STRANDED_CHARS, T.approx_tokens(F.col("_stable"))
        ).otherwise(0),
    )
    k = F.lit(1000.0 * scale)
    write_gap = (F.col("p_cache_write_5m") - F.col("p_cache_read")).cast("double")
    read_gap = (F.col("p_input") - F.col("p_cache_read")).cast("double")
    n = F.col("turns")

    def finding(rule: str, fires: Column, amount: Column) -> Column:
        return F.when(
            fires,
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit("Cache").alias("group"),
                amount.alias("per_1k"),
                F.lit("measured").alias("confidence"),
            ),
        )

    found = F.array_compact(
        F.array(
            finding(
                "PL15",
                F.col("has_prefix") & (F.col("rewrites") >= n - 1),
                F.col("first_tokens") * write_gap * F.col("rewrites") * k / n,
            ),
            finding(
                "PL16",
                F.col("stranded") >= fixed.MIN_STRANDED_TOKENS,
                F.col("stranded") * read_gap * k,
            ),
            finding(
                "PL17",
                F.col("compactions") > 0,
                F.col("reestablished") * write_gap * k / n,
            ),
        )
    )
    return g.select(session, "turns", F.explode(found).alias("_f")).select(session, "turns", "_f.*")
