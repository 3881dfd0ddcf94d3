"""Session pricing in log rounds, keyed state against the batch fold, looks, rates and grids."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from costproof import fixed
from costproof.operators import cascade as C
from costproof.operators import certificates as CE
from costproof.operators import drift as D
from costproof.operators import ranks as R
from costproof.operators import sampling as M
from costproof.operators import sessions as SE
from costproof.streaming import live as LV

RATES = {"input": 5, "output": 25, "cache_write_5m": 6, "cache_write_1h": 10, "cache_read": 1}


def plain_fold(turns, refresh=False):
    out, entry, clock = [], None, float("-inf")
    for t in turns:
        clock = max(clock, t["at_seconds"])
        if not t["prefix"] or t["prefix_tokens"] < 3:
            out.append("uncacheable")
            continue
        gone = entry and clock - entry[1] > entry[2]
        if entry and entry[0] == t["prefix"] and not gone:
            out.append("read")
            entry = (entry[0], clock, entry[2]) if refresh else entry
        else:
            out.append("write" if entry is None else "expired" if entry[0] == t["prefix"] else "changed")
            entry = (t["prefix"], clock, fixed.TTL_SECONDS[t["ttl"]])
    return out


def sessions(seed, n=8, length=40):
    rng, rows = random.Random(seed), []
    for session in range(n):
        at = 0.0
        for i in range(rng.choice([1, 3, length]) if session else length):
            at += rng.choice([0, 20, 90, 290, 310, 4000, -50])
            prefix = "same" if session == 0 else rng.choice(["same", "same", "same", "other", "", "tiny"])
            rows.append(
                dict(session_id=session, turn_index=i, prefix=prefix, prefix_tokens=2 if prefix == "tiny" else len(prefix) * 2,
                     total_tokens=50, output_tokens=4, ttl=rng.choice(["5m", "1h"]), at_seconds=at, label="")
            )
    return rows


@pytest.mark.parametrize("chunk, refresh", [(4, False), (4, True), (256, True)])
def test_sessions_equal_a_plain_loop_with_and_without_refresh(spark, chunk, refresh):
    rows = sessions(9)
    got = SE.cache_events(spark.createDataFrame(rows), refresh_on_read=refresh, minimum=3, chunk=chunk).collect()
    assert len(got) == len(rows)
    for session in {r["session_id"] for r in rows}:
        mine = [r for r in rows if r["session_id"] == session]
        events = [r["event"] for r in sorted(got, key=lambda r: r["turn_index"]) if r["session_id"] == session]
        assert events == plain_fold(mine, refresh)
        same = [r["same_prefix"] for r in sorted(got, key=lambda r: r["turn_index"]) if r["session_id"] == session]
        assert same == [False] + [a["prefix"] == b["prefix"] for a, b in itertools.pairwise(mine)]


def test_a_long_constant_prefix_takes_rounds_by_the_logarithm(spark, monkeypatch):
    n, rounds = 20_000, []
    turns = spark.range(n).select(
        F.lit(1).alias("session_id"), F.col("id").alias("turn_index"), F.lit("constant").alias("prefix"), F.lit(9).alias("prefix_tokens"),
        F.lit("5m").alias("ttl"), (F.col("id") * 110 + F.col("id") % 7).cast("double").alias("at_seconds"),
    )
    real = SE.cut
    monkeypatch.setattr(SE, "cut", lambda df: rounds.append(1) or real(df))
    got = SE.cache_events(turns).groupBy("event").count().collect()
    want = plain_fold([dict(prefix="constant", prefix_tokens=9, ttl="5m", at_seconds=i * 110 + i % 7) for i in range(n)])
    assert {r["event"]: r["count"] for r in got} == {e: want.count(e) for e in set(want)}
    assert len(rounds) <= 2 * 16  # two tables a round, some 6,700 writes


def test_next_marked_and_running_sums_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.random() < 0.2, rng.randrange(5)) for g in (1, 2, 3) for i in range(1 if g == 1 else 90)]
    df = spark.createDataFrame(rows, "g int, i long, marked boolean, x long")
    got = R.next_marked(df, ["g"], ["i"], {"to": F.when(F.col("marked"), F.col("i"))}).collect()
    for r in got:
        assert r["to"] == min((i for g, i, m, _ in rows if g == r["g"] and m and i > r["i"]), default=None)
    for r in R.running_sums(df, ["g"], ["i"], {"s": F.col("x")}).collect():
        assert r["s"] == sum(x for g, i, _, x in rows if g == r["g"] and i < r["i"])
    whole = spark.createDataFrame([(i, x) for n, (_, _, _, x) in enumerate(rows) for i in [n * 3]], "i long, x long")
    for r in R.running_sums(whole, [], ["i"], {"s": F.col("x")}).collect():
        assert r["s"] == sum(x for n, (_, _, _, x) in enumerate(rows) if n * 3 < r["i"])
    placed = R.positions(whole, "i")
    assert sorted(r["position"] for r in placed.collect()) == list(range(len(rows)))
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------------ streams


def batches(spark, tmp_path, name, parts, schema):
    """A stream that delivers each part of the rows as a micro-batch of its own."""
    path = tmp_path / name
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"p{n:03d}"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(str(path))


def start(writer, tmp_path, name):
    query = writer.option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    assert query.exception() is None


TURNS = (
    "session_id long, turn_index long, ts timestamp, prefix string, prefix_tokens long, total_tokens long, "
    "output_tokens long, ttl string"
)


def test_keyed_turn_costs_equal_the_batch_fold_in_any_order(spark, tmp_path):
    begin = dt.datetime(2026, 1, 1)
    rng, rows = random.Random(2), []
    for s in range(4):
        at = 0
        for i in range(14):
            # Session 1 falls silent for five hours: longer than any entry lives.
            at += 5 * 3600 if (s, i) == (1, 7) else rng.choice([40, 200, 310])
            prefix = rng.choice(["pre", "pre", "other", ""]) if s else "pre"
            rows.append((s, i, begin + dt.timedelta(seconds=at), prefix, 2 * len(prefix), 50 + i, 4, rng.choice(["5m", "1h"])))
    end = (99, 0, begin + dt.timedelta(days=2), "z", 9, 60, 4, "5m")
    rows.sort(key=lambda r: r[2])
    parts = [rows[i : i + 8] for i in range(0, len(rows), 8)]
    for part in parts:
        rng.shuffle(part)
    # Turns of one conversation also swap places across two batches, within the watermark.
    parts[0][0], parts[1][0] = parts[1][0], parts[0][0]
    prices = [F.lit(v).cast("long").alias(f"p_{k}") for k, v in RATES.items()]
    live = LV.live_turn_costs(batches(spark, tmp_path, "t", [*parts, [end]], TURNS).select("*", *prices), 3, late="1 hour")
    start(live.writeStream.format("memory").queryName("keyed").outputMode("append"), tmp_path, "t")
    batch = spark.createDataFrame([*rows, end], TURNS).select("*", *prices, F.lit("").alias("label"))
    batch = SE.price_turns(batch.withColumn("at_seconds", F.col("ts").cast("double")), minimum=3)
    key = lambda df: sorted((r["session_id"], r["turn_index"], r["event"], r["cost"]) for r in df.collect())
    assert key(spark.table("keyed")) == key(batch)


def test_late_turns_go_to_their_own_table_and_silence_ends_the_state(spark, tmp_path):
    begin = dt.datetime(2026, 1, 1)
    turn = lambda s, i, minutes: (s, i, begin + dt.timedelta(minutes=minutes), "pre", 9, 60, 4, "5m")
    parts = [
        [turn(1, 0, 0), turn(1, 2, 4)],  # the turn before the second one is missing
        [turn(2, 0, 100)],
        [turn(4, 0, 101)],  # the watermark has passed the second one: it waits no longer
        [turn(1, 1, 95)],  # and the missing one is late
        [turn(5, 0, 60 * 24 * 3)],
        [turn(6, 0, 60 * 24 * 3 + 1)],
        [turn(2, 1, 60 * 24 * 3 + 2), turn(1, 3, 60 * 24 * 3 + 3)],
        [turn(3, 0, 60 * 24 * 9)],
        [turn(7, 0, 60 * 24 * 9 + 1)],
    ]
    prices = [F.lit(v).cast("long").alias(f"p_{k}") for k, v in RATES.items()]
    live = LV.live_turn_costs(batches(spark, tmp_path, "l", parts, TURNS).select("*", *prices), 3, late="10 minutes", keep_days=1)
    out = str(tmp_path / "tables")
    writer = live.writeStream.foreachBatch(LV.turn_tables(out)).outputMode("append")
    start(writer, tmp_path, "l")
    priced = {(r["session_id"], r["turn_index"]): r["event"] for r in spark.read.parquet(f"{out}/priced").collect()}
    late = [(r["session_id"], r["turn_index"]) for r in spark.read.parquet(f"{out}/late").collect()]
    assert late == [(1, 1)]
    # A silence beyond the kept days begins anew, as a fresh write.
    assert priced == {(1, 0): "write", (1, 2): "read", (2, 0): "write", (4, 0): "write", (2, 1): "write"} | {
        (1, 3): "write", **{(s, 0): "write" for s in (3, 5, 6, 7)}
    }
    left = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "c_l"))
    assert {r["key"]["session_id"] for r in left.collect()} == {3, 7}


def test_budget_alerts_come_once_and_a_day_leaves_no_state(spark, tmp_path):
    begin = dt.datetime(2026, 3, 1)
    calls = lambda day, hours, cost: [(begin + dt.timedelta(days=day, hours=h), cost) for h in hours]
    parts = [calls(0, range(1, 6), 10), calls(0, range(6, 12), 10), calls(0, range(12, 14), 30), calls(1, [1], 200), calls(3, [5], 1), calls(9, [1], 1)]
    stream = batches(spark, tmp_path, "b", parts, "ts timestamp, cost long")
    live = LV.budget_alerts(stream, 100.0)
    start(live.writeStream.format("memory").queryName("alerts").outputMode("append"), tmp_path, "b")
    got = sorted((str(r["day"])[:10], r["state"], r["spent"]) for r in spark.table("alerts").collect())
    assert got == [
        ("2026-03-01", "stopped", 100), ("2026-03-01", "warning", 80),
        ("2026-03-02", "stopped", 200), ("2026-03-02", "warning", 200),
    ]
    left = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "day").load(str(tmp_path / "c_b"))
    assert left.count() <= 1  # the last day only


def test_session_windows_and_the_daily_budget_equal_the_batch(spark, tmp_path):
    begin = dt.datetime(2026, 1, 1)
    rows = [(s, begin + dt.timedelta(minutes=m), 5) for s in (1, 2) for m in (0, 10, 35, 90, 95, 200)] + [(9, begin + dt.timedelta(days=3), 1)]
    stream = batches(spark, tmp_path, "s", [rows[:6], rows[6:]], "session_id long, ts timestamp, cost long")
    start(LV.live_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append"), tmp_path, "s")
    got = sorted((r["session_id"], str(r["start"])[11:16], r["turns"]) for r in spark.table("sess").collect())
    assert got == [(s, at, n) for s in (1, 2) for at, n in (("00:00", 3), ("01:30", 2), ("03:20", 1))]
    again = batches(spark, tmp_path, "s2", [rows], "session_id long, ts timestamp, cost long")
    start(LV.live_budget(again, F.lit(70)).writeStream.format("memory").queryName("bud").outputMode("complete"), tmp_path, "s2")
    assert {str(r["day"])[:10]: (r["spent"], r["state"]) for r in spark.table("bud").collect()} == {"2026-01-01": (60, "warning"), "2026-01-04": (1, "ok")}


def test_sliding_drift_on_counts_equals_the_batch_fingerprint(spark, tmp_path):
    begin = dt.datetime(2026, 1, 1)
    rng = random.Random(6)
    rows = [(begin + dt.timedelta(hours=h), rng.choice("aab" if h < 90 else "bbc"), rng.choice([5, 9, 40])) for h in range(200)]
    items = spark.createDataFrame(rows, "ts timestamp, question_type string, tokens long")
    stream = batches(spark, tmp_path, "d", [rows, [(begin + dt.timedelta(days=40), "a", 1)]], items.schema)
    certified, lengths = D.type_mix(items.where("ts < '2026-01-04'")), D.length_quantiles(items.where("ts < '2026-01-04'"))
    out = str(tmp_path / "drift")
    mix = LV.sliding_mix(stream, "4 days", "2 days")
    start(mix.writeStream.foreachBatch(LV.drift_batch(certified, lengths, out)).outputMode("append"), tmp_path, "d")
    got = {str(r["start"]): (r["total_variation"], r["length_moves"], r["drifted"]) for r in spark.read.parquet(out).collect()}
    windows = items.withColumn("start", F.window("ts", "4 days", "2 days")["start"])
    starts = windows.select("start").distinct()
    want = D.divergence(
        starts.crossJoin(certified), D.type_mix(windows, ["start"]), starts.crossJoin(lengths), D.length_quantiles(windows, ["start"]), ["start"]
    )
    assert got == {str(r["start"]): (r["total_variation"], r["length_moves"], r["drifted"]) for r in want.collect()} and len(got) > 3


def test_a_weight_is_a_row_repeated(spark):
    rows = [("g", "a", 3, 4), ("g", "b", 7, 1), ("h", "a", 1, 2), ("h", "a", 9, 5)]
    counted = spark.createDataFrame(rows, "k string, question_type string, tokens long, n long")
    plain = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "k string, question_type string, tokens long")
    for make in (D.type_mix, D.length_quantiles):
        assert sorted(make(counted, ["k"], weight="n").collect()) == sorted(make(plain, ["k"]).collect())


def test_late_replays_and_looks_of_a_stream(spark, tmp_path):
    certificates = spark.createDataFrame(
        [("x", 0.0, -0.1, 0.1, 4, 0.05, "pocock", dt.date(2026, 2, 1)), ("y", 0.5, 0.4, 0.6, 4, 0.05, "obrien-fleming", dt.date(2025, 1, 1))],
        "certificate_id string, delta double, delta_low double, delta_high double, looks_planned int, alpha double, spending string, expires date",
    )
    today = F.lit("2026-01-08").cast("date")
    path = str(tmp_path / "looks")
    look = LV.canary_batch(certificates, path, today)
    pairs = lambda *groups: spark.createDataFrame([g for g in groups for _ in range(20)] + [(c, 0, 1) for c, _, _ in groups], "certificate_id string, b_correct int, c_correct int")
    look(pairs(("x", 1, 1), ("y", 1, 0)), 0)
    look(pairs(("x", 1, 0)), 1)
    look(pairs(("x", 1, 1), ("y", 0, 1)), 2)
    once = sorted(spark.read.parquet(path).select("certificate_id", "batch", "look", "z", "reasons").collect())
    look(pairs(("x", 1, 0)), 1)  # the batch is tried again
    again = sorted(spark.read.parquet(path).select("certificate_id", "batch", "look", "z", "reasons").collect())
    assert once == again
    assert [(r["certificate_id"], r["batch"], r["look"]) for r in once] == [("x", 0, 1), ("x", 1, 2), ("x", 2, 3), ("y", 0, 1), ("y", 2, 2)]
    assert [r["reasons"] for r in once] == [[], ["outcome moved"], [], ["expired", "outcome moved"], ["expired", "outcome moved"]]
    with pytest.raises(Exception, match="no looks left"):
        seen = spark.createDataFrame([("x", i) for i in range(4)], "certificate_id string, batch bigint")
        new = spark.createDataFrame([("x", 9, 0.0, 0.1)], "certificate_id string, batch bigint, delta double, standard_error double").withColumn("taken_on", today)
        CE.take_looks(certificates, seen, new).collect()


# ------------------------------------------------------------------------ rates and grids


@pytest.mark.parametrize("weights", [[1.0] * 30, [0.0] * 20 + [5.0], [0.001, 0.5, 0.5, 3.0, 90.0] * 7, [float(i % 9) for i in range(80)], [0.0]])
@pytest.mark.parametrize("target", [0.05, 0.06, 0.3, 0.97, 1.0])
def test_solved_rates_have_the_mean_that_was_asked_for(spark, weights, target):
    df = spark.createDataFrame([(w,) for w in weights], "u double")
    scale, top_up = M.solve_scale(df, "u", target)
    mean = df.agg(F.avg(M.rate_column(F.col("u"), scale, top_up, 0.05))).first()[0]
    assert mean == pytest.approx(target, abs=1e-12)


@pytest.mark.parametrize("money", ["long", "decimal(20,4)"])
def test_four_tier_settings_equal_simulation(spark, money):
    rng = random.Random(4)
    rows = [(t % 2, t, i, rng.randint(0, 1), rng.randint(1, 9) * 10**i, rng.choice([0.0, 0.2, 0.4, 0.6, 1.0])) for t in range(40) for i in range(4)]
    m = spark.createDataFrame(rows, "g int, task_id int, tier_index int, correct int, cost long, score double").withColumn("cost", F.col("cost").cast(money))
    scarce = [True, False, False, True]
    table = C.settings(C.cells(C.wide_matrix(m, 4, ["g"]), 4, 0.2, ["g"]), 4, scarce, 0.2, ["g"]).collect()
    assert len(table) == 2 * 6**3
    by_task = {(g, t): {} for g, t, *_ in rows}
    for g, t, i, ok, cost, score in rows:
        by_task[g, t][i] = (ok, cost, score)
    for r in rng.sample(table, 60):
        right = spent = hard = 0
        for (g, _), tiers in by_task.items():
            if g != r["g"]:
                continue
            for i in range(4):
                ok, cost, score = tiers[i]
                spent, hard = spent + cost, hard + cost * scarce[i]
                if i == 3 or score >= r["thresholds"][i]:
                    right += ok
                    break
        assert (r["successes"], r["total_cost"], r["scarce_cost"]) == (right, spent, hard)


def test_reaching_walks_backwards_once_over_cycles_and_diamonds(spark, monkeypatch):
    from costproof.operators import graphs as G

    rng = random.Random(1)
    edges = {("p", a, b) for a in range(25) for b in range(25) if rng.random() < 0.06} | {("q", i, i + 1) for i in range(6)} | {("q", 3, 1)}
    steps = [("p", i) for i in range(25)] + [("q", i) for i in range(9)] + [("r", 0)]
    outputs = {"p": 4, "q": 5, "r": 0}
    text = lambda rows: [(p, *map(str, r)) for p, *r in rows]
    sizes = []
    real = G.cut
    monkeypatch.setattr(G, "cut", lambda df: sizes.append((out := real(df)).count()) or out)
    got = G.reaches_output(
        spark.createDataFrame(text(steps), "pipeline string, step_id string"),
        spark.createDataFrame(text(edges), "pipeline string, src string, dst string"),
        spark.createDataFrame(text(outputs.items()), "pipeline string, output_step string"),
    ).collect()
    want = {(p, o) for p, o in outputs.items()}
    while more := {(p, a) for p, a, b in edges if (p, b) in want} - want:
        want |= more
    assert {(r["pipeline"], int(r["step_id"])) for r in got if r["reaches"]} == want
    assert len(got) == len(steps) and sum(sizes) == len(want)  # each step is found once
