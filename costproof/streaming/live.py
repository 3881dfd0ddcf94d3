"""Structured Streaming over a live trace ledger.

Each function maps a streaming DataFrame to a streaming DataFrame (or starts a query that needs a
batch function); the caller names sink, trigger and checkpoint. Event time is ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from costproof import fixed
from costproof.operators import drift as D
from costproof.operators import spend as S


DAY = 86_400
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state with timers needs, for queries started from here on."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_spend(calls: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Spend by model and tumbling window; calls inside the watermark are still added."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "model")
        .agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "model", "calls", "cost")
    )


def live_budget(calls: DataFrame, cap: Column, late: str = "1 hour") -> DataFrame:
    """Budget state by day, from the same rule as the batch job."""
    spent = (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"))
        .agg(F.sum("cost").alias("spent"))
    )
    return spent.select(
        F.col("window.start").alias("day"), "spent", S.budget_state(F.col("spent"), cap).alias("_b")
    ).select("day", "spent", "_b.fraction", "_b.state", "_b.remaining")


class _DayAlerts(StatefulProcessor):
    """Spend of one day and the highest level announced; gone once the watermark has passed the day."""

    def __init__(self, cap: float):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "spent bigint, level int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spent, level = self.day.get() if self.day.exists() else (0, 0)
        if not self.day.exists():
            self.handle.registerTimer((key[0] + DAY) * 1000)
        for row in sorted(rows, key=lambda r: r["second"]):  # a day has 1,440 minutes
            spent += row["cost"]
            fraction = spent / self.cap if self.cap > 0 else 1.0
            reached = 2 if fraction >= 1 else 1 if fraction >= fixed.BUDGET_WARNING else 0
            for i in range(level + 1, reached + 1):
                yield Row(day_seconds=key[0], state=("warning", "stopped")[i - 1], spent=spent)
            level = max(level, reached)
        self.day.update((spent, level))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.day.clear()
        yield from ()

    def close(self) -> None:
        pass


def budget_alerts(calls: DataFrame, cap: float, late: str = "1 hour") -> DataFrame:
    """One alert per day and crossing of 80 % and 100 %; a minute that crosses both gives both.

    Spend is first summed by minute in the engine, so the state of a day receives minutes and not
    calls, and minutes are complete when they come. A day's state ends with the day: a timer clears it
    when the watermark passes midnight, after which no minute of the day can arrive. Days are UTC.
    """
    keyed_state(calls.sparkSession)
    minutes = (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 minute"))
        .agg(F.sum("cost").cast("bigint").alias("cost"))
        .select(F.window_time("window").alias("at"), F.unix_seconds("window.start").alias("second"), "cost")
    )
    days = minutes.select("at", (F.col("second") - F.col("second") % DAY).alias("day_seconds"), "second", "cost")
    alerts = days.groupBy("day_seconds").transformWithState(
        _DayAlerts(cap), "day_seconds bigint, state string, spent bigint", "append", "eventTime"
    )
    return alerts.select(F.timestamp_seconds("day_seconds").alias("day"), "state", "spent")


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Conversations by inactivity."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "session_id")
        .agg(F.count("*").alias("turns"), F.sum("cost").alias("cost"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "session_id", "turns", "cost")
    )


_PRICES = ("input", "output", "cache_write_5m", "cache_write_1h", "cache_read")
_TURN = (
    "at double, prefix_key string, prefix_tokens bigint, total_tokens bigint, output_tokens bigint, ttl string, "
    + ", ".join(f"p_{name} bigint" for name in _PRICES)
)
_ENTRY = "entry string, written double, life int, newest bigint, clock double, seen bigint"


class _TurnCosts(StatefulProcessor):
    """One conversation: the cache entry in hand, and turns that wait for one before them."""

    def __init__(self, minimum: int, refresh: bool, keep_ms: int):
        self.minimum, self.refresh, self.keep_ms = minimum, refresh, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", _ENTRY)
        self.waiting = handle.getMapState("waiting", "turn_index bigint", _TURN)

    def _get(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, 0.0, 0, -1, 0.0, 0]

    def _priced(self, key, index: int, turn: tuple, state: list) -> Row:
        at, prefix, prefix_tokens, total, output, ttl, p_input, p_output, p_5m, p_1h, p_read = turn
        entry, written, life, _, clock, _ = state
        at = max(at, clock)
        fresh, cost = total, 0
        if not prefix or prefix_tokens < self.minimum:
            event = "uncacheable"
        else:
            fresh = max(0, total - prefix_tokens)
            gone = at - written > life
            if entry == prefix and not gone:
                event, cost = "read", prefix_tokens * p_read
                written = at if self.refresh else written
            else:
                event = "expired" if entry == prefix else "write" if entry is None else "changed"
                cost = prefix_tokens * (p_1h if ttl == "1h" else p_5m)
                entry, written, life = prefix, at, fixed.TTL_SECONDS.get(ttl, fixed.TTL_SECONDS["5m"])
        state[:5] = entry, written, life, index, at
        return Row(session_id=key[0], turn_index=index, event=event, cost=cost + fresh * p_input + output * p_output)

    def _next_in_line(self, key, state: list) -> Iterator[Row]:
        while self.waiting.containsKey((state[3] + 1,)):
            index = state[3] + 1
            turn = self.waiting.getValue((index,))
            self.waiting.removeKey((index,))
            yield self._priced(key, index, turn, state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._get()
        arrived = sorted(((r["turn_index"], int(r["at"] * 1000), tuple(r)[3:]) for r in rows), key=lambda r: r[0])
        for index, ms, turn in arrived:
            state[5] = max(state[5], ms)
            if index <= state[3]:
                yield Row(session_id=key[0], turn_index=index, event="late", cost=None)
            elif index == state[3] + 1:
                yield self._priced(key, index, turn, state)
                yield from self._next_in_line(key, state)
            else:
                self.waiting.updateValue((index,), turn)
                self.handle.registerTimer(max(ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.state.update(tuple(state))
        self.handle.registerTimer(state[5] + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        state, now = self._get(), timerValues.getCurrentWatermarkInMs()
        # Turns whose time the watermark has passed wait no longer, nor do those before them.
        due = {k[0]: int(v[0] * 1000) for k, v in self.waiting.iterator()}
        last = max((i for i, ms in due.items() if ms <= now), default=None)
        for index in sorted(due):
            if last is not None and index <= last:
                turn = self.waiting.getValue((index,))
                self.waiting.removeKey((index,))
                yield self._priced(key, index, turn, state)
        yield from self._next_in_line(key, state)
        if now >= state[5] + self.keep_ms:
            self.state.clear()
            self.waiting.clear()
        else:
            self.state.update(tuple(state))

    def close(self) -> None:
        pass


def live_turn_costs(
    turns: DataFrame, minimum: int = 0, late: str = "10 minutes", refresh_on_read: bool = False,
    keep_days: int = 30,
) -> DataFrame:
    """Every turn priced as the batch fold prices it, with the cache entry kept per conversation.

    ``turns``: ``session_id, ts, turn_index, prefix, prefix_tokens, total_tokens, output_tokens, ttl``
    and prices ``p_*``. A turn is priced at once when the one before it has been; a turn that came too
    early waits in keyed state, until the missing ones arrive or the watermark has passed its time. A
    turn that arrives when a later one has been priced comes out with event ``late`` and no cost.

    An entry's lifetime ends by the clock of the turns, as in the batch fold, so a conversation that
    falls silent for hours resumes with ``expired`` or ``changed``; what stays is one small row. A timer
    clears it ``keep_days`` after the last turn; only a silence longer than that begins anew.
    """
    keyed_state(turns.sparkSession)
    slim = turns.withWatermark("ts", late).select(
        "session_id", "ts", "turn_index", F.col("ts").cast("double").alias("at"),
        F.when(F.col("prefix") != "", F.md5("prefix")).alias("prefix_key"),
        *[F.col(c).cast("bigint").alias(c) for c in ("prefix_tokens", "total_tokens", "output_tokens")], "ttl",
        *[F.col(f"p_{c}").cast("bigint").alias(f"p_{c}") for c in _PRICES],
    )
    return slim.groupBy("session_id").transformWithState(
        _TurnCosts(minimum, refresh_on_read, keep_days * DAY * 1000),
        "session_id bigint, turn_index bigint, event string, cost bigint", "append", "eventTime",
    )


def turn_tables(path: str):
    """A ``foreachBatch`` function: priced turns to ``path/priced``, late ones to ``path/late``.

    A batch that is tried again replaces its own rows in both.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        late = F.col("event") == "late"
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/priced/batch={number}")
        batch.where(late).drop("event", "cost").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.unpersist()

    return write


def deduplicate_calls(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Replayed calls dropped by request key."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_key"])


def sliding_mix(calls: DataFrame, width: str = "7 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Question types and lengths counted over sliding windows."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", width, step), "question_type", "tokens")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "question_type", "tokens", "n")
    )


def drift_batch(certified: DataFrame, lengths: DataFrame, path: str):
    """A ``foreachBatch`` function comparing each finished window with the certified fingerprint."""

    def compare(batch: DataFrame, number: int) -> None:
        starts = batch.select("start").distinct()
        mix = D.type_mix(batch, ["start"], weight="n")
        out = D.divergence(
            starts.crossJoin(certified), mix, starts.crossJoin(lengths),
            D.length_quantiles(batch, ["start"], weight="n"), ["start"],
        )
        # A batch that is tried again replaces its own rows.
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return compare


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever store the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


LOOKS = "certificate_id string, batch bigint"


def canary_batch(certificates: DataFrame, looks_path: str, today: Column):
    """A ``foreachBatch`` function taking a look from arriving graded pairs and appending it.

    Pairs: ``certificate_id, b_correct, c_correct``. A certificate takes one look per batch that has pairs
    of it; its number counts the batches before.
    """
    from costproof.operators import certificates as CE

    def look(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        observed = CE.paired_delta(batch, ["certificate_id"]).select(
            "certificate_id", F.lit(number).cast("bigint").alias("batch"), today.alias("taken_on"), "delta", "standard_error"
        )
        taken = spark.createDataFrame([], LOOKS)
        if _exists(spark, looks_path):
            # The folder names the batch; a batch tried again does not see its own rows.
            earlier = spark.read.schema(LOOKS).parquet(looks_path)
            taken = earlier.where(F.col("batch") < number)
        standing = certificates.join(observed.select("certificate_id"), "certificate_id", "left_semi")
        looks = CE.take_looks(standing, taken, observed).drop("batch")
        looks.write.mode("overwrite").parquet(f"{looks_path}/batch={number}")

    return look
