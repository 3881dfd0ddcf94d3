from __future__ import annotations

import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import blocks as BL
from costproof.functions import grading as GR
from costproof.functions import stats
from costproof.operators import arms as A
from costproof.operators import bootstrap as B
from costproof.operators import cascade as C
from costproof.operators import certificates as CE
from costproof.operators import consensus as K
from costproof.operators import drift as D
from costproof.operators import evaluation as E
from costproof.operators import findings as FI
from costproof.operators import graphs as G
from costproof.operators import lint as L
from costproof.operators import ranks as RK
from costproof.operators import rewrite as R
from costproof.operators import sampling as M
from costproof.operators import scoring as S
from costproof.operators import sessions as SE
from costproof.operators import ties as T
from costproof.sources import recorded as REC

RATES = {"input": 5, "output": 25, "cache_write_5m": 6, "cache_write_1h": 10, "cache_read": 1}


# ------------------------------------------------------------------------- sessions


def plain_fold(turns):
    out, entry = [], None
    for t in turns:
        if not t["prefix"] or t["prefix_tokens"] < 3:
            out.append("uncacheable")
            continue
        gone = entry and t["at_seconds"] - entry[1] > entry[2]
        if entry and entry[0] == t["prefix"] and not gone:
            out.append("read")
        else:
            out.append("write" if entry is None else "expired" if entry[0] == t["prefix"] else "changed")
            entry = (t["prefix"], t["at_seconds"], fixed.TTL_SECONDS[t["ttl"]])
    return out


@pytest.mark.parametrize("chunk", [3, 256])
def test_session_fold_equals_a_plain_loop_for_any_chunk(spark, chunk):
    rng, rows, want = random.Random(4), [], {}
    for session in range(6):
        at, turns = 0.0, []
        for i in range(23):
            at += rng.choice([20, 90, 290, 310, 4000])
            # session 0 never changes its prefix: the hand-over between chunks matters most there
            prefix = "same" if session == 0 else rng.choice(["same", "same", "other", "", "tiny"])
            turns.append(
                dict(session_id=session, turn_index=i, prefix=prefix, prefix_tokens=2 if prefix == "tiny" else len(prefix) * 2,
                     total_tokens=50, output_tokens=4, ttl=rng.choice(["5m", "1h"]), at_seconds=at, label="")
            )
        want[session] = plain_fold(turns)
        rows += turns
    df = spark.createDataFrame(rows).select("*", *[F.lit(v).alias(f"p_{k}") for k, v in RATES.items()])
    got = SE.price_turns(df, minimum=3, chunk=chunk).orderBy("session_id", "turn_index").collect()
    for session, events in want.items():
        assert [r["event"] for r in got if r["session_id"] == session] == events


def test_grouping_folds_a_lonely_tail(spark):
    got = SE.group_consecutive(spark.range(9).withColumnRenamed("id", "task_id"), "task_id", 4)
    sizes = {r[0]: r[1] for r in got.groupBy("session_id").count().collect()}
    assert sizes == {0: 4, 1: 5}


# -------------------------------------------------------------------------- cascade


@pytest.mark.parametrize("tiers", [1, 2, 3])
def test_settings_equal_brute_force(spark, tiers):
    rng = random.Random(tiers)
    rows = [
        (t, i, rng.randint(0, 1), rng.randint(1, 9) * 10**i, rng.choice([0.0, 0.25, 0.5, 0.500001, 0.75, 1.0]))
        for t in range(60) for i in range(tiers)
    ]
    m = spark.createDataFrame(rows, "task_id int, tier_index int, correct int, cost long, score double")
    scarce = [False] * (tiers - 1) + [True]
    table = C.settings(C.cells(C.wide_matrix(m, tiers), tiers, 0.25), tiers, scarce, 0.25)
    got = {tuple(r["thresholds"][:-1]): (r["successes"], r["total_cost"], r["scarce_cost"]) for r in table.collect()}
    cell = {(t, i): (c, k, s) for t, i, c, k, s in rows}
    for combo in itertools.product(C.grid(0.25), repeat=tiers - 1):
        ok = cost = rare = 0
        for t in range(60):
            for i in range(tiers):
                c, k, s = cell[(t, i)]
                cost += k
                rare += k if scarce[i] else 0
                if i == tiers - 1 or s >= combo[i]:
                    ok += c
                    break
        assert got[combo] == (ok, cost, rare)


def test_incomplete_matrix_is_refused(spark):
    m = spark.createDataFrame([(1, 0, 1, 5, 0.5), (1, 1, 1, 5, 0.5), (2, 0, 1, 5, 0.5)], "task_id int, tier_index int, correct int, cost long, score double")
    with pytest.raises(Exception, match="incomplete matrix"):
        C.wide_matrix(m, 2).collect()
    assert [r["task_id"] for r in C.incomplete_tasks(m, 2).collect()] == [2]


# ------------------------------------------------------------------------ statistics


def test_bootstrap_ignores_layout_and_covers(spark):
    df = spark.range(400).select(F.col("id").alias("t"), (F.col("id") % 5 != 0).cast("int").alias("correct"), (10 + F.col("id") % 7).alias("cost"))
    sums = {"correct": F.col("correct"), "cost": F.col("cost")}
    run = lambda d: B.bootstrap(d, [], B.task_key(F.col("t")), sums, B.cost_per_success, 400).first()
    a, b = run(df), run(df.repartition(7, F.rand(3)))
    assert a == b
    assert a["low"] < a["point"] < a["high"]
    mean = B.bootstrap(df, [], B.task_key(F.col("t")), sums, lambda s: s["correct"] / s["weight"], 400).first()
    se = (0.8 * 0.2 / 400) ** 0.5
    assert mean["high"] - mean["low"] == pytest.approx(2 * 1.96 * se, rel=0.2)


def test_poisson_weights_have_mean_and_variance_one(spark):
    df = spark.range(3000).select(F.col("id").alias("t"), F.lit(1).alias("one"))
    r = B.replicate_sums(df, ["t"], B.task_key(F.col("t")), {"one": F.col("one")}, 20).where("replicate >= 0").agg(F.avg("weight"), F.var_pop("weight")).first()
    assert r[0] == pytest.approx(1.0, abs=0.02) and r[1] == pytest.approx(1.0, abs=0.03)


def test_poisson_weights_of_wide_ids_and_single_replicates():
    ids = np.concatenate([np.arange(2000), np.arange(2000) + 2**31, np.arange(2000) * 2**33, -np.arange(1, 2000)])
    w = B.weights(ids, 40, 7).astype(float)
    assert abs(w.mean(axis=0) - 1).max() < 0.07 and abs(w.var(axis=0) - 1).max() < 0.15
    for other in (2000, 4000):
        assert abs(np.corrcoef(w[:2000].ravel(), w[other : other + 2000].ravel())[0, 1]) < 0.02
    assert (w[0] != w[6000 - 1]).any() and (B.weights(ids[:9], 40, 8) != w[:9]).any()


def test_pairs_over_different_tasks_stop_the_job(spark):
    ddl = "pipeline string, task_id int, correct int, cost long"
    rows = [("a", 1, 1, 5), ("a", 2, 1, 5), ("b", 1, 0, 2), ("b", 2, 0, 2), ("c", 1, 0, 2), ("c", 2, 1, 2)]
    assert A.pair(spark.createDataFrame(rows, ddl), "a").count() == 4
    for lost in (1, 2, 5):
        with pytest.raises(Exception, match="different task sets"):
            A.pair(spark.createDataFrame(rows[:lost] + rows[lost + 1 :], ddl), "a").collect()


def test_prompts_without_blocks_survive_the_blob_store(spark):
    block = "array<struct<text:string,cache:string>>"
    rows = [("a", [("x" * 50, None), ("y", "5m")]), ("b", []), ("c", None), ("d", [("x" * 50, None)])]
    prompts = spark.createDataFrame(rows, f"k string, blocks {block}")
    slim, blobs = REC.dehydrate(prompts, "k", threshold=10)
    back = {r["k"]: [tuple(b) for b in r["blocks"]] for r in REC.rehydrate(slim, blobs, "k").collect()}
    assert back == {"a": [("x" * 50, None), ("y", "5m")], "b": [], "c": [], "d": [("x" * 50, None)]}


def test_clean_requests_score_five_everywhere(spark):
    findings = spark.createDataFrame([("a", "PL08"), ("a", "PL10")], "request_id string, rule string")
    asked = spark.createDataFrame([("a",), ("b",)], "request_id string")
    scores = {r["request_id"]: set(r[1:]) for r in L.clear_scores(findings, requests=asked).collect()}
    assert scores["b"] == {5} and min(scores["a"]) == 3


def test_registries_take_new_kinds_and_refuse_repeats(spark):
    replies = spark.createDataFrame([('{"correct": true, "confidence": 0.9, "why": "' + "x" * 900 + '"}',)], "r string")
    read = replies.select(GR.verify("verdict", F.col("r")).alias("v")).select("v.*").first()
    assert "x" * 900 in [v for v in read if isinstance(v, str)]
    with pytest.raises(ValueError, match="already"):
        GR.register_verifier("verdict", GR.parse_verdict)
    with pytest.raises(ValueError, match="unknown verifier"):
        GR.verify("none", F.col("r"))
    with pytest.raises(ValueError, match="no machine-text detector"):
        D.detector("none")
    D.register_detector("fixed", lambda: F.lit(0.25))
    try:
        items = replies.withColumn("p", D.detector("fixed")())
        assert D.importance_weights(items, "p").first()["weight"] == 1.0
    finally:
        D.DETECTORS.clear()
    with pytest.raises(ValueError, match="already"):
        K.register_label_kind(K.label_kind("majority-vote"))


def test_scorers_see_no_labels(spark):
    samples = spark.createDataFrame([(1, "a", 0, "x", 0.1, 1, "test", "gold")], "task_id int, tier string, sample_index int, output string, cost double, correct int, split string, gold string")
    assert not set(S.router_view(samples).columns) & set(S.FORBIDDEN_COLUMNS)


def test_arms_over_different_tasks_are_refused(spark):
    arms = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 1, 5), ("b", 1, 0, 2)], "pipeline string, task_id int, correct int, cost long")
    with pytest.raises(ValueError, match="different task sets"):
        A.require_same_tasks(arms, "a")
    A.require_same_tasks(arms.where("task_id = 1"), "a")


def test_no_success_means_null_not_infinity(spark):
    arms = spark.createDataFrame([("a", 1, 0, 5)], "pipeline string, task_id int, correct int, cost long")
    assert A.arm_summary(arms).first()["cost_per_success"] is None


def test_ranks_and_quantiles_survive_a_hot_group(spark):
    rows = [("hot", i % 97) for i in range(900)] + [("cold", 5), ("cold", 7)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: r for r in RK.exact_quantiles(df, ["g"], "v", (0.1, 0.5)).collect()}
    assert got["cold"]["p50"] == 6.0
    values = sorted(i % 97 for i in range(900))
    assert got["hot"]["p50"] == (values[449] + values[450]) / 2
    tasks = spark.range(500).select(F.col("id").alias("task_id"), F.lit("x").alias("g"))
    ranked = RK.hash_rank(tasks, ["g"], "task_id", 1).select("rank").collect()
    assert sorted(r[0] for r in ranked) == list(range(1, 501))


# ----------------------------------------------------------------- labels and scoring


def test_rates_have_the_mean_asked_for(spark):
    df = spark.createDataFrame([(float(x),) for x in [0.0] * 10 + [0.1, 0.5, 1.0, 2.0, 9.0] * 6], "weight double")
    scale, top = M.solve_scale(df, "weight", 0.4)
    rate = M.rate_column(F.col("weight"), scale, top, 0.05)
    r = df.agg(F.avg(rate), F.min(rate), F.max(rate)).first()
    assert r[0] == pytest.approx(0.4, abs=1e-9) and r[1] >= 0.05 and r[2] <= 1
    scale, top = M.solve_scale(df, "weight", 0.9)
    assert df.agg(F.avg(M.rate_column(F.col("weight"), scale, top, 0.05))).first()[0] == pytest.approx(0.9)


def test_a_biased_judge_does_not_bias_the_corrected_delta(spark):
    n = 4000
    df = spark.range(n).select(
        F.col("id").alias("task_id"), (F.col("id") % 10 < 8).cast("int").alias("strong_baseline"), (F.col("id") % 10 < 7).cast("int").alias("strong_candidate"),
        F.lit(0).alias("judge_baseline"), F.lit(1).alias("judge_candidate"), F.lit(0.5).alias("rate"),
        (stats.uniform_draw(F.col("id"), 3) < 0.5).cast("int").alias("sampled"),
    )
    r = M.judged_comparison(df).first()
    assert r["judge_only_delta"] == 1.0 and r["low"] < -0.1 < r["high"] and r["verdict"] == "worse"
    broken = df.withColumn("strong_baseline", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="strong label"):
        M.judged_comparison(broken).collect()


def test_smaller_budgets_draw_subsets(spark):
    df = spark.range(500).select(F.col("id").alias("task_id"), F.lit(0.8).alias("rate"), F.lit(1).alias("sampled"), F.lit(1).alias("strong_baseline"), F.lit(1).alias("strong_candidate"))
    ids = [{r["task_id"] for r in M.restrict_to_budget(df, b, 100.0).where("sampled = 1").collect()} for b in (60.0, 20.0)]
    assert ids[1] < ids[0]
    with pytest.raises(ValueError):
        M.restrict_to_budget(df, 101.0, 100.0)


def samples(spark, spec):
    rows = [(t, tier, i, out, 5) for (t, tier), outs in spec.items() for i, out in enumerate(outs)]
    return spark.createDataFrame(rows, "task_id int, tier string, sample_index int, output string, cost long")


def test_agreement_and_consensus(spark):
    s = samples(spark, {(1, "a"): ["4", "4.00", "5"], (1, "b"): ["4", "4", "4"], (2, "a"): ["7", "7", "7"], (2, "b"): ["9", "9", "9"]})
    got = {(r["task_id"], r["tier"]): r for r in S.agreement(s, 3).collect()}
    assert got[(1, "a")]["sizes"] == [2, 1] and got[(1, "a")]["answer_index"] == 0 and got[(1, "b")]["entropy"] == 0.0
    labels = {(r["task_id"], r["tier"]): r for r in K.consensus_labels(s, ["a", "b"], 3).collect()}
    assert not labels[(1, "a")]["excluded"] and labels[(1, "a")]["label"] == 1
    assert labels[(2, "a")]["excluded"] and labels[(2, "a")]["penalized"] and labels[(2, "a")]["label"] == 0
    majority = K.consensus_labels(s, ["a", "b"], 3, "majority-vote").where("excluded").count()
    assert majority == 0
    with pytest.raises(Exception, match="different depths"):
        K.consensus_labels(s.where("not (task_id = 1 and tier = 'a' and sample_index = 2)"), ["a", "b"], 3).collect()
    with pytest.raises(Exception, match="fewer than"):
        S.agreement(s, 4).collect()


def test_entailment_clusters_count_calls(spark):
    answers = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "x"), (1, "a", 2, "y"), (1, "a", 3, None)], "task_id int, tier string, sample_index int, answer string")
    pairs = spark.createDataFrame([(1, "a", 0, 2, True), (1, "a", 2, 0, True)], "task_id int, tier string, premise int, hypothesis int, entails boolean")
    r = S.entailment_clusters(answers, pairs).first()
    assert r["sizes"] == [3, 1] and r["calls"] == 2 and r["unreadable"] == 0


def test_router_view_hides_the_answer_key(spark):
    df = spark.createDataFrame([(1, "a", "q", "o", "g", 1)], "task_id int, tier string, question string, output string, gold string, correct int")
    assert not set(S.router_view(df).columns) & set(S.FORBIDDEN_COLUMNS)


def test_logistic_scorer_orders_and_degrades(spark):
    df = spark.range(200).select((F.col("id") / 200).alias("x"), ((F.col("id") + (F.col("id") % 3) * 20) > 100).cast("int").alias("label"))
    fit = S.fit_logistic(df, ["x"])
    assert fit.weights[0] > 0 and not fit.degenerate
    area = S.auroc(df.withColumn("s", fit.score()), [], "s", "label").first()["auroc"]
    assert area > 0.9
    flat = S.fit_logistic(df.withColumn("label", F.lit(1)), ["x"])
    assert flat.degenerate and flat.positive_rate == 1.0


def test_ties_and_fallback(spark):
    rows = [("a", 1.0, 0.9, 1.2, 0.9, 0.8, True), ("b", 1.1, 1.0, 1.3, 0.9, 0.2, True), ("c", 5.0, 4.0, 6.0, 0.9, 0.0, True)]
    df = spark.createDataFrame(rows, "label string, cost_point double, cost_low double, cost_high double, accuracy double, scarce_share double, adoptable boolean")
    got = {r["label"]: r for r in T.tie_report(df).collect()}
    assert set(got) == {"a", "b"} and got["b"]["is_fallback"] and got["a"]["exploration_weight"] == 0.5
    with pytest.raises(Exception, match="no single winner"):
        T.single_winner(df).collect()
    assert T.single_winner(df.where("label = 'c'")).first()["label"] == "c"


# --------------------------------------------------------------- drift, certificates


def test_alpha_schedule_spends_exactly_alpha(spark):
    c = spark.createDataFrame([("p", 0.05, 4, "pocock"), ("o", 0.05, 4, "obrien-fleming")], "certificate_id string, alpha double, looks_planned int, spending string")
    for key in ("p", "o"):
        levels = [r["level"] for r in CE.alpha_schedule(c).where(F.col("certificate_id") == key).collect()]
        kept = 1.0
        for level in levels:
            kept *= 1 - level
        assert 1 - kept == pytest.approx(0.05)


def test_collapsed_set_is_refused(spark):
    items = spark.range(300).select(F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("template_id"))
    space = spark.range(20).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("template_id"))
    shape = D.tail_shape(items, space).first()
    assert shape["tail_coverage"] == 0.2 and shape["gini"] == pytest.approx(0.0)
    assert D.missing_templates(items, space).count() == 16
    with pytest.raises(ValueError):
        D.detector("any")
    with pytest.raises(Exception, match="not a probability"):
        D.importance_weights(spark.createDataFrame([(1.4,)], "p double"), "p").collect()


def test_split_sizes_are_topped_up(spark):
    tasks = spark.range(103).select(F.col("id").alias("task_id"), F.when(F.col("id") < 3, "rare").otherwise("common").alias("question_type"))
    got = D.split_tasks(tasks, 35, 5)
    assert got.where("split = 'calibration'").count() == 35 and got.count() == 103


# ----------------------------------------------------------------- prompts and graphs


def request(spark, system, user=(("ask", None),), max_tokens=1024):
    row = [(1, [tuple(b) for b in system], [tuple(b) for b in user], None, max_tokens, None, None)]
    df = spark.createDataFrame(row, f"request_id int, system {BL.BLOCK_TYPE}, user {BL.BLOCK_TYPE}, tools string, max_tokens int, observed_output_tokens double, needed_output_tokens int")
    return df.select("*", F.lit(5).alias("p_input"), F.lit(25).alias("p_output"), F.lit(1).alias("p_cache_read"), F.lit(1024).alias("p_minimum"))


def test_lint_rules_fire_where_they_should(spark):
    doc = "The policy says that returns are free within thirty days of the order date. " * 60
    r = request(spark, [("Current date: 2026-01-02 10:30 UTC", None), (doc, "5m"), ("Please be concise. Explain at length.", None)])
    rules = {f["rule"]: f for f in L.lint(r).collect()}
    assert {"PL01", "PL02", "PL03", "PL06", "PL08", "PL10", "PL11", "PL12"} <= set(rules)
    span = rules["PL08"]["spans"][0]
    assert span["text"] == "Please" and (span["section"], span["block"], span["start"], span["end"]) == ("system", 2, 0, 6)
    assert L.clear_scores(L.lint(r)).first()["E"] == 2


def test_words_and_matches_of_a_text_are_found_once(spark):
    text = spark.createDataFrame([("Please, please note a b c d e and thank you.",)], "t string")
    plan = text.select(BL.trigrams(F.col("t")).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
    block = F.struct(F.lit("user").alias("section"), F.lit(3).alias("index"), F.col("t").alias("text"))
    found = text.select(L.spans(block, fixed.COURTESY).alias("s"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    got, whole = found.first()["s"], text.first()["t"]
    assert [s["text"] for s in got] == ["Please", "please note", "thank you"]
    assert all(whole[s["start"]:s["end"]] == s["text"] and s["block"] == 3 for s in got)
    assert text.select(L.spans(block, "zz").alias("s")).first()["s"] == []
    assert "Exchange" not in L.row_findings(request(spark, [("a", None)]))._jdf.queryExecution().executedPlan().toString()


SAMPLES = {
    fixed.COURTESY: "please|please note|thanks|thank you|we appreciate|we really appreciate|kindly|if you don't mind|if you would|feel free to|it's important that you|"
    "do a good job|try your best|remember that|keep in mind that|i hope|hopefully|perhaps|maybe|it's generally a good idea|somewhat|a little|a bit|sort of|kind of|as best you can|whenever possible",
    fixed.VAGUE_VERBS: "help with|help out|look at|handle|deal with|take care of|work on|do something|do what you can|assist with|see to|see about",
    fixed.OUTPUT_CONTRACT_PATTERN: "reply with json|respond in one word|answer as one line|return with one number|output as one object|reply in exactly|reply in the following format|reply with {a}|reply as <b>",
    fixed.LENGTH_CAP: "no more than 3 words|at most 1 token|under 2 sentences|fewer than 9 characters|maximum of 3 lines|limited to 4 items|limit to 4 items|within 5 words|one word|a single line|1 sentence|one number|a single json object",
    fixed.ROLE: "you are a clerk|you are an ant|you are the judge",
    fixed.TASK_LINE: "task: x|your task - x|objective: x|goal: x",
    fixed.SUCCESS: "success criteria|what good looks like|how to get it right|a good answer|you are correct when|done when",
    fixed.EXAMPLE_MARKER: "example 1.|example -|input :|output:|q:|a:",
    fixed.CONFLICT_PAIRS[0][0]: "be concise", fixed.CONFLICT_PAIRS[1][0]: "be brief", fixed.CONFLICT_PAIRS[2][0]: "never ever guess",
    fixed.CONFLICT_PAIRS[3][0]: "only use provided|only rely on the provided", fixed.CONFLICT_PAIRS[4][0]: "do not explain",
    fixed.HARDCODED[0]: "https://abcdef|http://abcdef|www.abcdef", fixed.HARDCODED[1]: "a@b.cd",
    fixed.HARDCODED[3]: "1999-01-02|2024-01-02", fixed.HARDCODED[4]: "$ 5|$5.00",
}


def test_a_plain_search_loses_no_match_of_a_pattern(spark):
    assert SAMPLES.keys() == L.NEEDLES.keys()
    folded = str.maketrans({"s": "\u017f", "k": "\u212a", "i": "\u0131"})
    for pattern, told in SAMPLES.items():
        rows = [(1, [(text, None)], [("caf\u00e9", None)]) for t in told.split("|") for text in (t, t.upper(), t.title(), t.translate(folded), "zq")]
        made = spark.createDataFrame(rows, f"request_id int, system {BL.BLOCK_TYPE}, user {BL.BLOCK_TYPE}")
        made = made.withColumn("tools", F.lit(None).cast("string"))
        text, first = F.col("_system"), F.col("_b")[0]
        got = L.profiled(made).select(
            "_system", text.rlike(L.rx(pattern)).alias("is"), L.holds(F.col("_b"), text, pattern).alias("holds"), L.may_match(first, pattern).alias("may"),
        ).collect()
        assert all(r["is"] == r["holds"] and (r["may"] or not r["is"]) for r in got), pattern
        assert all(r["is"] for r in got[::5]) and not any(r["may"] for r in got if r["_system"] == "zq"), pattern


def test_ranked_findings_are_made_once(spark):
    text = "The first line of it is long enough.\r\n  - The first line of it is long enough.\u2028** x"
    asked = request(spark, [(text, None)])
    assert [(r["pos"], r["line"]) for r in L.instruction_lines(asked).collect()] == [(i, "The first line of it is long enough.") for i in (0, 1)]
    plan = L.instruction_lines(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 3
    ranked = FI.rank(L.lint(asked).drop("spans"), ["request_id"])
    assert "regexp" not in ranked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["rule"] for r in ranked.collect()} >= {"PL06", "PL07"}


def test_duplicate_lines_are_counted_as_pairs(spark):
    line = "always answer with the exact value from the table"
    text = "\n".join([line] * 4 + ["- " + line + "!", "something else entirely that is quite different here"])
    got = L.duplicate_instructions(request(spark, [(text, None)])).first()
    assert got["pairs"] == 10 and not got["all_in_prefix"]
    cleaned = R.remove_duplicate_instructions(request(spark, [(text, None)])).first()
    assert cleaned["system"][0]["text"].count("always answer") == 1 and cleaned["applied"] == ["remove_duplicate_instructions"]


def test_safe_fixes_move_and_cache(spark):
    r = request(spark, [("Generated at 10:30", "5m"), ("You are a helper. Please reply kindly with care.", None)])
    got = R.apply_safe_fixes(r).first()
    texts = [b["text"] for b in got["system"]]
    assert texts[-1] == "Generated at 10:30" and got["max_after"] == 200
    assert "Please" not in " ".join(texts[:-1]) and got["prefix_was_volatile"]
    marked = [b["text"] for b in got["system"] if b["cache"]]
    assert marked == [fixed.OUTPUT_CONTRACT]


def test_graph_rules(spark):
    steps = spark.createDataFrame([("p", "gen", "generate", None, 1, True), ("p", "check", "verify", None, 2, True), ("p", "again", "retry", None, 3, True)], "pipeline string, step_id string, kind string, tool string, position int, called boolean")
    edges = spark.createDataFrame([("p", "gen", "check"), ("p", "gen", "again")], "pipeline string, src string, dst string")
    outputs = spark.createDataFrame([("p", "again")], "pipeline string, output_step string")
    traces = spark.createDataFrame([("p", t, s, None, "same text" if s != "check" else "ok", f"ask {t}") for t in range(10) for s in ("gen", "check", "again")], "pipeline string, task_id int, step_id string, arguments string, output string, request_text string")
    calls = traces.select("pipeline", "step_id", "request_text", F.lit("m").alias("model"), *[F.lit(10).alias(b) for b in fixed.BILLED_BUCKETS], *[F.lit(v).alias(f"p_{k}") for k, v in RATES.items()])
    found = G.graph_findings(steps, edges, outputs, traces, G.step_stats(calls))
    assert {(r["rule"], r["step_id"]) for r in found.collect()} == {("G03", "check"), ("G04", "again")}
    assert G.deletable_step(found).first()["step_id"] in ("check", "again")
    two = steps.unionByName(steps.where("step_id <> 'check'").withColumn("pipeline", F.lit("q")))
    pairs = G.deletion_pairs(two, outputs.unionByName(outputs.withColumn("pipeline", F.lit("q")))).first()
    assert (pairs["baseline"], pairs["removed"], pairs["candidate"]) == ("p", "check", "q")


def test_traces_that_look_small_are_never_broadcast(spark):
    made = F.inline(F.array(*[F.struct(F.lit(s).alias("step_id"), F.repeat(F.lit(s), 300).alias("output"), F.repeat(F.lit("ab"), 300).alias("request_text"), F.lit("x").alias("arguments")) for s in "ab"]))
    traces = spark.range(50).select(F.lit("p").alias("pipeline"), F.col("id").alias("task_id"), made)
    steps = spark.createDataFrame([("p", s, "generate", None, i, i == 1) for i, s in enumerate("ab")], "pipeline string, step_id string, kind string, tool string, position int, called boolean")
    edges = spark.createDataFrame([("p", "b", "a")], "pipeline string, src string, dst string")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (G.carried(traces), G.duplicate_tool_calls(traces, steps), G.identical_to_prior(traces, steps, edges))]
    assert all("SortMergeJoin" in p for p in plans)


def test_whole_numbers_are_groups_only_when_they_differ(spark):
    told = [(1, "5"), (1, "Final answer: 5"), (1, "Final answer: 6"), (1, "7"), (2, "3"), (2, "4"), (2, "3"), (2, "9"), (3, "5"), (3, "5.0"), (3, "yes"), (3, "5")]
    rows = [(t, "a", i % 4, o, 1) for i, (t, o) in enumerate(told)]
    s = spark.createDataFrame(rows, "task_id int, tier string, sample_index int, output string, cost int")
    plain = {r["task_id"]: r["plain"] for r in S.distinct_draws(s, 4, ["task_id", "tier"]).collect()}
    assert plain == {1: True, 2: True, 3: False}
    got = {r["task_id"]: (r["sizes"], r["answer_index"], r["output"]) for r in S.agreement(s, 4).collect()}
    assert got == {1: ([2, 1, 1], 0, "5"), 2: ([2, 1, 1], 0, "3"), 3: ([3, 1], 0, "5")}
    key = s.select(GR.answer_key(F.col("output")).alias("k"), GR._read_key(F.col("output")).alias("f"))
    assert all(r["k"] == r["f"] for r in key.collect())


@pytest.mark.parametrize("k", [2, 3, 5])
def test_scorers_read_whole_numbers_without_texts(spark, k):
    rng = random.Random(k)
    rows = [
        (t, tier, i, rng.choice(("5", "Final answer: 5", "Final answer: 6", "7", "0")) if t < 60 else rng.choice(("5", "5.0", "yes", "", "6")), 10**9 + t + i, rng.choice((0, 1, None)), "test" if t % 3 else "calibration")
        for t in range(70) for tier in "ab" for i in range(5)
    ]
    s = spark.createDataFrame(rows, "task_id int, tier string, sample_index int, output string, cost long, correct int, split string")
    told = S.numbers_agreement(s, k, ["task_id", "tier", "split"])
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "collect_list" not in plan and "SortAggregate" not in plan
    got = {(r["task_id"], r["tier"]): r for r in told.collect()}
    want = {(r["task_id"], r["tier"]): r for r in S.agreement(s, k).collect()}
    assert len(got) == 140 and all(got[key]["told"] for key in got if key[0] < 60) and not all(r["told"] for r in got.values())
    for key, r in got.items():
        if r["told"]:
            assert all(r[name] == want[key][name] for name in ("entropy", "answer_index", "cost", "correct"))
    columns = ["task_id", "tier", "split", "sample_entropy", "correct", F.col("cost").cast("decimal(38,12)").alias("cost")]
    ready = E._prepare(s, "self-consistency-v1", k)
    assert not any(name in ready.columns for name in ("output", "sizes"))
    whole = E._labelled(s, "self-consistency-v1", k)
    assert sorted(map(str, ready.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    with pytest.raises(Exception, match="fewer than"):
        S.numbers_agreement(s.where("not (task_id = 1 and sample_index = 1)"), k, ["task_id", "tier"]).collect()


def test_written_tables_give_their_shuffles_back(spark):
    from costproof.runtime import SHUFFLE_CLEANUP, written

    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    made = spark.range(100).repartition(3).withColumn("d", F.lit("1.5").cast("decimal(38,12)"))
    kept = written(made)
    assert kept.dtypes == made.dtypes and kept.count() == 100 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
    with pytest.raises(Exception):
        written(made.withColumn("x", F.raise_error(F.lit("no")).cast("int")))
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before


@pytest.mark.parametrize("kind", ["majority-vote", "penalized-v1"])
def test_whole_numbers_are_voted_on_as_full_replies_are(spark, kind):
    rng = random.Random(5)
    draws = [(t, tier, k, rng.choice((7, 7, 7, 8, 12))) for t in range(60) for tier in "abc" for k in range(4)]
    made = spark.createDataFrame(draws, "task_id int, tier string, sample_index int, v int")
    plain = made.withColumn("output", F.concat(F.lit("Final answer: "), "v"))
    full = made.withColumn("output", F.concat(F.lit("So it is.\nFinal answer: "), "v", F.lit(".")))
    assert plain.where(GR.whole_number(F.col("output")).isNull()).count() == 0
    assert full.where(GR.whole_number(F.col("output")).isNotNull()).count() == 0
    got, want = ({(r["task_id"], r["tier"]): r for r in K.consensus_labels(x, ["a", "b", "c"], 4, kind).collect()} for x in (plain, full))
    assert len(got) == 180 and got.keys() == want.keys()
    for key, row in want.items():
        for name in row.asDict():
            same = got[key][name]
            assert same == (pytest.approx(row[name]) if isinstance(row[name], float) else row[name])


# -------------------------------------------------------------------------- sources


def test_task_files(spark, tmp_path):
    from costproof.sources import tasks as TK

    path = tmp_path / "t.jsonl"
    path.write_text('{"prompt": "q1", "expected": "a", "lang": "en"}\n\n{"prompt": "q2", "expected": "", "id": "x"}\nnot json\n[1]\n')
    rows = TK.read_json_lines(spark, str(path))
    got = {r["question"]: r for r in TK.to_tasks(rows).collect()}
    assert got["q1"]["task_id"] == "task-00001" and got["q1"]["gold"] == "a" and got["q1"]["extra"]["lang"] == "en"
    assert got["q2"]["task_id"] == "x" and TK.to_tasks(rows).where("error is not null").count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        TK.require_clean(TK.to_tasks(rows)).collect()
    spans = tmp_path / "s.jsonl"
    span = {"spanId": "s1", "attributes": [{"key": "gen_ai.prompt", "value": {"stringValue": "hi"}}, {"key": "gen_ai.operation.name", "value": {"stringValue": "chat"}}]}
    spans.write_text(json.dumps([span, {"attributes": {}}]) + "\n" + json.dumps({"span_id": "s2", "attributes": {"gen_ai.request.prompt": "yo"}}) + "\n")
    got = {r["task_id"]: r for r in TK.read_spans(spark, str(spans)).collect()}
    assert got["s1"]["question"] == "hi" and got["s1"]["question_type"] == "chat" and got["s2"]["gold"] == "" and len(got) == 2


def test_ledger_runs_are_replaced_and_erased(spark, tmp_path):
    from costproof.sources import ledger as LE

    path = str(tmp_path / "ledger")
    rows = lambda run, n: spark.range(n).select(F.lit(run).alias("run_id"), "id", F.lit("secret").alias("prompt_text"))
    LE.write_run(rows("a", 3).unionByName(rows("b", 2)), path)
    LE.write_run(rows("a", 1).withColumn("content_erased", F.lit(False)), path)
    assert {r[0]: r[1] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 1, "b": 2}
    assert LE.erase_content(spark, path, ["b"], str(tmp_path / "staging")) == 2
    left = spark.read.option("mergeSchema", "true").parquet(path)
    assert left.where("run_id = 'b' and prompt_text is null").count() == 2 and left.where("prompt_text = 'secret'").count() == 1


def test_price_lists(spark):
    from costproof.sources import prices as P

    raw = spark.createDataFrame([("m", "x", 3.0, 15.0, None, None, 0.5, None, None)], "model string, provider string, input double, output double, cache_write_5m double, cache_write_1h double, cache_read double, batch_discount double, note string")
    r = P.load_prices(raw).first()
    assert float(r["cache_write_5m"]) == 3.75 and float(r["cache_write_1h"]) == 6.0 and float(r["cache_read"]) == 0.5 and "cache_write_5m" in r["note"]
    payload = json.dumps({"data": [{"id": "a/b", "pricing": {"prompt": "0.000003", "completion": "0.000015"}}, {"id": "free", "pricing": {"prompt": "0", "completion": "0"}}]})
    got = P.parse_listing(spark.createDataFrame([(payload,)], "payload string")).collect()
    assert len(got) == 1 and float(got[0]["input"]) == 3.0 and got[0]["provider"] == "a"


# ------------------------------------------------------------------------ streaming


def stream(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(spark, out, tmp_path, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}")


def test_stream_equals_batch(spark, tmp_path):
    from costproof.streaming import live as LV

    start = dt.datetime(2026, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=30 * i), "m" if i % 2 else "n", i) for i in range(100)]
    calls = spark.createDataFrame(rows, "call_key int, ts timestamp, model string, cost long")
    got = run(spark, LV.live_spend(stream(spark, calls, tmp_path, "a")), tmp_path, "spend", "complete")
    want = calls.groupBy(F.window("ts", "1 day").start.alias("start"), "model").agg(F.sum("cost").alias("cost"))
    key = lambda df: sorted((str(r["start"]), r["model"], r["cost"]) for r in df.collect())
    assert key(got) == key(want)
    doubled = calls.unionByName(calls)
    assert run(spark, LV.deduplicate_calls(stream(spark, doubled, tmp_path, "b")), tmp_path, "dedup").count() == 100


def test_streamed_turns_equal_the_batch_fold(spark, tmp_path):
    from costproof.streaming import live as LV

    start = dt.datetime(2026, 1, 1)
    rows = [(s, i, start + dt.timedelta(seconds=70 * i), "pre" if s else f"p{i // 4}", 30, 50 + i, 4, "5m") for s in range(3) for i in range(12)]
    turns = spark.createDataFrame(rows, "session_id long, turn_index long, ts timestamp, prefix string, prefix_tokens long, total_tokens long, output_tokens long, ttl string")
    turns = turns.select("*", *[F.lit(v).cast("long").alias(f"p_{k}") for k, v in RATES.items()])
    live = run(spark, LV.live_turn_costs(stream(spark, turns, tmp_path, "t"), 3), tmp_path, "turns")
    batch = SE.price_turns(turns.withColumn("at_seconds", F.unix_timestamp("ts").cast("double")).withColumn("label", F.lit("")), minimum=3)
    key = lambda df: sorted((r["session_id"], r["turn_index"], r["event"], r["cost"]) for r in df.collect())
    assert key(live) == key(batch)


def test_meaning_clusters_of_nested_judgements_match_rows(spark):
    rng = random.Random(5)
    answers, rows, nested = [], [], []
    for task in range(60):
        answers += [(task, "a", i, rng.choice(["x", "y", "z", None])) for i in range(3)]
        said = {(i, j): rng.choice([True, False, None]) for i in range(3) for j in range(3) if i != j}
        rows += [(task, "a", i, j, v) for (i, j), v in said.items()]
        nested.append((task, "a", {f"{i}>{j}": v for (i, j), v in said.items()}))
    draws = spark.createDataFrame(answers, "task_id int, tier string, sample_index int, answer string")
    pairs = spark.createDataFrame(rows, "task_id int, tier string, premise int, hypothesis int, entails boolean")
    maps = spark.createDataFrame(nested, "task_id int, tier string, verdicts map<string,boolean>")
    one, two = (sorted(map(str, S.entailment_clusters(draws, j).collect())) for j in (pairs, maps))
    assert one == two and len(one) == 60


def test_weights_of_a_key_are_drawn_once_for_all_groups(monkeypatch):
    import pyarrow as pa

    drawn = []
    monkeypatch.setattr(B, "weights", lambda keys, *rest, own=B.weights: drawn.extend(keys.tolist()) or own(keys, *rest))
    ids = np.repeat(np.arange(150), 2)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["p", "q"] * 150), pa.array(ids), pa.array((ids % 7 + np.tile([0, 3], 150)).astype(float))], ["g", "k", "v"]
    )
    schema = pa.schema([("g", pa.string()), ("replicate", pa.int32()), ("weight", pa.float64()), ("v", pa.float64())])
    got = {b.column(0)[0].as_py(): b for b in B._summed(1, 1, 30, 9, schema)(iter([batch]))}
    assert sorted(drawn) == list(range(150)) and set(got) == {"p", "q"}
    w = B.weights(np.arange(150), 30, 9).astype(float)
    for group, more in (("p", 0), ("q", 3)):
        want = (np.arange(150) % 7 + more) @ w
        assert got[group].column("v").to_pylist()[1:] == want.tolist() and got[group].column("weight").to_pylist()[1:] == w.sum(axis=0).tolist()
        assert got[group].column("v")[0].as_py() == (np.arange(150) % 7 + more).sum()
