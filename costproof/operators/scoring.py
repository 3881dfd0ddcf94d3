"""Scorers: features, sampling-based agreement, logistic fits, and how good the scores are.

A scorer sees questions and replies, never gold, correctness, type or sections: ``router_view`` keeps
only the allowed columns. Labels enter at fitting time and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof.functions import grading, stats
from costproof.operators.ranks import running_before

# --------------------------------------------------------------------------- isolation

VIEW_COLUMNS = (
    "task_id", "tier", "tier_index", "question", "output", "output_tokens", "context_id",
    "sample_index", "samples", "cost",
)
FORBIDDEN_COLUMNS = ("gold", "correct", "answer_type", "question_type", "sections", "template_id")


def router_view(df: DataFrame) -> DataFrame:
    """Only what a router may see."""
    return df.select(*[c for c in VIEW_COLUMNS if c in df.columns])


# ---------------------------------------------------------------------------- features

FEATURES: dict[str, Callable[[], Column]] = {}


def register_feature(name: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Register a named column builder over a router view."""

    def add(fn: Callable[[], Column]) -> Callable[[], Column]:
        if name in FEATURES:
            raise ValueError(f"feature {name!r} is already registered")
        FEATURES[name] = fn
        return fn

    return add


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


@register_feature("output_parses")
def _output_parses() -> Column:
    return _flag(grading.extract_answer(F.col("output")).isNotNull())


@register_feature("answer_type_matches")
def _bare_value() -> Column:
    answer = grading.strip(grading.extract_answer(F.col("output")))
    shape = (
        answer.rlike(r"^-?\$?\d[\d,]*\.?\d*%?$")
        | answer.rlike(r"(?i)^(?:yes|no)$")
        | answer.rlike(r"(?i)^[a-z]+_\d+$")
    )
    words = F.size(F.filter(F.split(answer, r"(?U)\s+"), lambda w: w != ""))
    return _flag(shape | (words <= 3))


@register_feature("output_length")
def _output_length() -> Column:
    return F.length("output").cast("double")


@register_feature("question_length")
def _question_length() -> Column:
    return F.length("question").cast("double")


@register_feature("question_numerals")
def _question_numerals() -> Column:
    return F.regexp_count("question", F.lit(r"(?U)\d+")).cast("double")


@register_feature("output_tokens")
def _output_tokens() -> Column:
    return F.col("output_tokens").cast("double")


@register_feature("has_evidence_field")
def _has_evidence() -> Column:
    quoted = F.get_json_object(grading.json_text(F.col("output")), "$.evidence")
    return _flag(grading.strip(quoted) != "")


def with_features(view: DataFrame, names: list[str]) -> DataFrame:
    """The named features as columns; an unknown name is an error."""
    missing = [n for n in names if n not in FEATURES]
    if missing:
        raise ValueError(f"unknown features {missing}; registered: {sorted(FEATURES)}")
    return view.select("*", *[FEATURES[n]().alias(n) for n in names])


def with_grounding(view: DataFrame, sections: DataFrame) -> DataFrame:
    """Whether the cited section exists and holds the quoted evidence.

    ``sections``: ``context_id, section, body``. A left join on (context, section); the quote is
    compared after collapsing white space.
    """
    body = grading.json_text(F.col("output"))
    cited = view.withColumn(
        "_section", grading.strip(F.get_json_object(body, "$.section"))
    ).withColumn("_quote", grading.strip(F.get_json_object(body, "$.evidence")))

    def squash(text: Column) -> Column:
        return F.lower(grading.strip(F.regexp_replace(text, r"(?U)\s+", " ")))

    known = sections.select(
        "context_id", F.col("section").alias("_section"), F.col("body").alias("_body")
    )
    joined = cited.join(known, ["context_id", "_section"], "left")
    has_body = F.coalesce(F.col("_body") != "", F.lit(False))
    found = has_body & (F.col("_quote") != "") & squash(F.col("_body")).contains(
        squash(F.col("_quote"))
    )
    return (
        joined.withColumn("cites_a_real_section", _flag(has_body & (F.col("_section") != "")))
        .withColumn("evidence_quote_found", _flag(found))
        .drop("_section", "_quote", "_body")
    )


# ------------------------------------------------------------------- grouping of samples


def first_fit(keys: Column, same: Callable[[Column, Column], Column] = grading.same_answer) -> Column:
    """Group an array of answer keys: each joins the first group whose representative it equals.

    Result: array of ``struct(rep, first, size)`` in order of first appearance (``first`` 0-based).
    The relation is not transitive, so this is a fold in draw order and not a ``groupBy``. Arrays
    hold the k draws of one task, so they are short by construction.
    """
    return fit(F.transform(keys, lambda k, i: F.struct(k.alias("rep"), i.alias("first"), F.lit(1).alias("size"))), same)


def fit(items: Column, same: Callable[[Column, Column], Column] = grading.same_answer) -> Column:
    """The same over ``struct(rep, first, size)``, an item standing for ``size`` draws with one key."""
    nothing = F.filter(items, lambda _: F.lit(False))

    def place(groups: Column, item: Column) -> Column:
        position = F.array_position(
            F.transform(groups, lambda g: same(g["rep"], item["rep"])), True
        )
        grown = F.transform(
            groups,
            lambda g, j: F.struct(
                g["rep"].alias("rep"),
                g["first"].alias("first"),
                F.when(j + 1 == position, g["size"] + item["size"]).otherwise(g["size"]).alias("size"),
            ),
        )
        return F.when(position == 0, F.concat(groups, F.array(item))).otherwise(grown)

    return F.aggregate(items, nothing, place)


def apart(items: Column) -> Column:
    """Items for ``fit`` from merged draws; a reply without an answer equals nothing, not even its copies."""
    one = lambda d, n: F.struct(d["rep"].alias("rep"), d["first"].alias("first"), n.alias("size"))
    return F.flatten(F.transform(items, lambda d: F.when(
        d["rep"]["answer"].isNull(), F.array_repeat(one(d, F.lit(1)), d["size"])
    ).otherwise(F.array(one(d, d["size"])))))


def by_size(groups: Column) -> Column:
    """Groups largest first, earlier first on ties."""
    keyed = F.transform(
        groups, lambda g: F.struct((-g["size"]).alias("o"), g["first"].alias("first"), g.alias("g"))
    )
    ordered = F.array_sort(
        F.transform(keyed, lambda e: F.struct(e["o"].alias("o"), e["first"].alias("first"))),
    )
    return F.transform(
        ordered,
        lambda e: F.element_at(
            F.filter(groups, lambda g: g["first"] == e["first"]), 1
        ),
    )


def group_sizes(groups: Column) -> Column:
    """Sizes, largest first."""
    return F.sort_array(F.transform(groups, lambda g: g["size"]), asc=False)


def majority_index(groups: Column) -> Column:
    """0-based index of the returned sample: first member of the largest, earliest group."""
    best = F.array_max(
        F.transform(groups, lambda g: F.struct(g["size"].alias("s"), (-g["first"]).alias("f")))
    )
    return -best["f"]


def sample_arrays(samples: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The first k draws per task and tier in draw order, as arrays.

    The filter on ``sample_index`` comes first, so a group never holds more than k rows; fewer than k
    stops the job, because a sampling scorer cannot run at a depth that was not recorded.
    """
    keys = keys or ["task_id", "tier"]
    drawn = samples.where(F.col("sample_index") < k).withColumn(
        "_key", grading.answer_key(F.col("output"))
    )
    fields = ["sample_index", "_key", "output", "cost"] + (
        ["correct"] if "correct" in samples.columns else []
    )
    grouped = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("draws"))
    guarded = F.when(F.size("draws") == k, F.col("draws")).otherwise(
        F.raise_error(F.concat(F.lit(f"fewer than {k} samples for task "), F.col("task_id").cast("string")))
    )
    return grouped.withColumn("draws", guarded)


def distinct_draws(samples: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The first k draws by keys as ``items``: equal outputs counted once, read once, in draw order.

    Everything about a task meets in one exchange on the keys: equal outputs are merged there before any
    is parsed. Items are ``struct(rep, first, size, output[, correct])``; a reply without an answer equals
    nothing and stays apart from its copies; ``plain`` says that all are whole numbers. Fewer than k draws stop the job, because a sampling scorer
    cannot run at a depth that was not recorded.
    """
    graded = "correct" in samples.columns
    drawn = samples.where(F.col("sample_index") < k).repartition(*keys)
    merged = drawn.groupBy(*keys, "output").agg(
        F.min("sample_index").cast("int").alias("first"), F.count("*").cast("int").alias("size"),
        F.sum("cost").alias("cost"), *([F.min_by("correct", "sample_index").alias("correct")] if graded else []),
    )
    read = merged.withColumn("rep", grading.answer_key(F.col("output")))
    item = F.struct("first", "size", "rep", "output", *(["correct"] if graded else []))
    grouped = read.groupBy(*keys).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.sum("size").alias("_n"),
        F.bool_and(grading.whole_number(F.col("output")).isNotNull()).alias("plain"),
        F.sum("cost").cast("decimal(38,12)").alias("cost"),
    )
    complete = F.when(F.col("_n") == k, F.col("items")).otherwise(
        F.raise_error(F.concat(F.lit(f"fewer than {k} samples for task "), F.col("task_id").cast("string")))
    )
    return grouped.withColumn("items", complete).drop("_n")


def agreement(samples: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Per task and tier: group sizes, entropy of agreement, returned sample, cost of k draws.

    Only keys that differ are compared with each other, so the fold is over a few items of a task.
    """
    keys = keys or ["task_id", "tier"]
    arrays = distinct_draws(samples, k, keys)
    draws = apart(F.col("items"))
    single = (F.size("items") == 1) & F.col("items")[0]["rep"]["answer"].isNotNull()
    # Different whole numbers are different answers, so such items are the groups.
    differ = F.col("plain") & (F.size(F.array_distinct(F.col("items.rep.number"))) == F.size("items"))
    out = arrays.withColumn("groups", F.when(single | differ, draws).otherwise(fit(draws)))
    answer = majority_index(F.col("groups"))
    out = out.withColumn("answer_index", answer)
    chosen = F.element_at(F.filter("items", lambda d: d["first"] == F.col("answer_index")), 1)
    columns = [
        group_sizes(F.col("groups")).alias("sizes"),
        stats.discrete_entropy(F.transform("groups", lambda g: g["size"])).alias("entropy"),
        "answer_index",
        chosen["output"].alias("output"),
        "cost",
    ]
    if "correct" in samples.columns:
        columns.append(chosen["correct"].alias("correct"))
    return out.select(*keys, *columns)


def numbers_agreement(samples: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """``agreement`` where all draws state plain whole numbers, which ``told`` says; else its columns mean nothing.

    Draws become one row of numbers before anything moves, and groups are counted by comparing these, with no array
    and no text. The returned sample's text is not kept. Fewer than k draws stop the job here too.
    """
    graded = "correct" in samples.columns
    at = [F.col("sample_index") == i for i in range(k)]
    rows = samples.where(F.col("sample_index") < k).withColumn("_v", grading.whole_number(F.col("output")))
    wide = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("cost").alias("cost"),
        *[F.max(F.when(a, F.col("_v"))).alias(f"_v{i}") for i, a in enumerate(at)],
        *([F.max(F.when(a, F.col("correct"))).alias(f"_c{i}") for i, a in enumerate(at)] if graded else []),
    )
    refusal = F.raise_error(F.concat(F.lit(f"fewer than {k} samples for task "), F.col("task_id").cast("string")))
    values = [F.col(f"_v{i}") for i in range(k)]
    told = F.lit(True)
    for v in values:
        told = told & v.isNotNull()
    sizes = []
    for v in values:
        same = F.lit(0)
        for other in values:
            same = same + F.when(v == other, 1).otherwise(0)
        sizes.append(same)
    sized = wide.where(F.when(F.col("_n") == k, True).otherwise(refusal.cast("boolean"))).select(
        "*", told.alias("told"), *[size.alias(f"_s{i}") for i, size in enumerate(sizes)]
    )
    # An earlier draw comes before later ones of its group, and of groups as large.
    place = F.greatest(*[F.col(f"_s{i}") * k + (k - 1 - i) for i in range(k)])
    answer = F.lit(k - 1) - place % k
    # ``stats.discrete_entropy`` over the groups in order of their first draws, which lead them.
    nats, total = F.lit(0.0), F.lit(float(k))
    for i, v in enumerate(values):
        leads = F.lit(True)
        for earlier in values[:i]:
            leads = leads & (v != earlier)
        share = F.col(f"_s{i}") / total
        nats = nats - F.when(leads, share * F.log(share)).otherwise(0.0)
    entropy = F.when(F.col("_s0") == k, F.lit(0.0)).otherwise(nats / F.log(total))
    columns = [entropy.alias("entropy"), "answer_index", F.col("cost").cast("decimal(38,12)").alias("cost")]
    if graded:
        chosen = F.col("_c0")
        for i in range(1, k):
            chosen = F.when(F.col("answer_index") == i, F.col(f"_c{i}")).otherwise(chosen)
        columns.append(chosen.alias("correct"))
    return sized.withColumn("answer_index", answer).select(*keys, *columns, "told")


def effective_samples(sizes: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Intraclass correlation of agreement and what k correlated draws are worth.

    The indicator (member of the largest group) is binary, so the two sums of squares follow from
    the sum and the sum of squares of the largest size: one aggregation of whole numbers.
    """
    largest = F.array_max("sizes")
    s = sizes.groupBy(*keys).agg(
        F.count("*").alias("tasks"), F.sum(largest).alias("_l"), F.sum(largest * largest).alias("_l2")
    )
    t, kk = F.col("tasks"), F.lit(float(k))
    sum_m, sum_m2 = F.col("_l") / kk, F.col("_l2") / (kk * kk)
    between = kk * (sum_m2 - sum_m * sum_m / t) / (t - 1)
    within = kk * (sum_m - sum_m2) / (t * (kk - 1))
    bottom = between + (kk - 1) * within
    rho = F.when(bottom == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (between - within) / bottom))
    )
    return s.withColumn("rho", rho).select(
        *keys, "tasks", "rho", (kk / (1 + (kk - 1) * F.col("rho"))).alias("effective_k")
    )


# ------------------------------------------------------------------ meaning clusters


def entailment_clusters(
    answers: DataFrame, judgements: DataFrame, keys: list[str] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Cluster the k answers of a task by recorded two-way entailment.

    ``answers``: keys, ``sample_index, answer`` (null = unreadable); ``judgements``: keys,
    ``premise, hypothesis, entails`` by sample index (null = unreadable reply), or keys and ``verdicts``, a map from
    ``premise>hypothesis``, where a task's judgements are one row already. First fit; identical
    strings are free; a null answer is its own cluster; the calls made and unreadable pairs are
    counted. Arrays are k and k x k long. Both sides are grouped by the same keys, so their join moves
    nothing more. With ``carry``, ``draws`` holds those columns of ``answers`` too, in draw order.
    """
    keys, carry = keys or ["task_id", "tier"], carry or []
    draws = answers.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("sample_index", "answer", *carry))).alias("draws")
    )
    if "verdicts" in judgements.columns:
        pairs = judgements.select(*keys, "verdicts")
    else:
        pairs = judgements.groupBy(*keys).agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        F.concat_ws(">", "premise", "hypothesis").alias("pair"),
                        F.col("entails").alias("entails"),
                    )
                )
            ).alias("verdicts")
        )
    joined = draws.join(pairs, keys, "left").withColumn(
        "verdicts", F.coalesce("verdicts", F.create_map().cast("map<string,boolean>"))
    )

    def ask(a: Column, b: Column) -> Column:
        pair = F.concat_ws(">", a["sample_index"], b["sample_index"])
        return F.try_element_at(F.col("verdicts"), pair)

    def look(rep: Column, item: Column) -> Column:
        """struct(match, calls, unreadable) of comparing one answer with one representative."""
        said = F.struct(ask(rep, item).alias("forward"), ask(item, rep).alias("backward"))
        return grading.let(said, lambda both: judged(rep, item, both["forward"], both["backward"]))

    def judged(rep: Column, item: Column, forward: Column, backward: Column) -> Column:
        blank = rep["answer"].isNull() | item["answer"].isNull()
        equal = F.coalesce(rep["answer"] == item["answer"], F.lit(False))
        both = F.coalesce(forward & backward, F.lit(False))
        calls = (
            F.when(blank | equal | forward.isNull(), 0)
            .when(~forward | backward.isNull(), 1)
            .otherwise(2)
        )
        unread = ~blank & ~equal & (
            forward.isNull() | (F.coalesce(forward, F.lit(False)) & backward.isNull())
        )
        return F.struct(
            (~blank & (equal | both)).alias("match"),
            calls.alias("calls"),
            unread.cast("int").alias("unreadable"),
        )

    start = F.struct(
        F.filter(
            F.transform("draws", lambda d: F.struct(d.alias("rep"), F.lit(1).alias("size"))),
            lambda _: F.lit(False),
        ).alias("groups"),
        F.lit(0).alias("calls"),
        F.lit(0).alias("unreadable"),
    )

    def place(state: Column, item: Column) -> Column:
        """The state with one more answer; looks and the place found are computed once, however often they are read."""

        def placed(at: Column) -> Column:
            position = at["position"]
            seen = F.when(position == 0, at["looked"]).otherwise(
                F.slice(at["looked"], F.lit(1), F.greatest(position, F.lit(1)).cast("int"))
            )
            new = F.array(F.struct(item.alias("rep"), F.lit(1).alias("size")))
            grown = F.transform(
                state["groups"],
                lambda g, j: F.struct(
                    g["rep"].alias("rep"),
                    F.when(j + 1 == position, g["size"] + 1).otherwise(g["size"]).alias("size"),
                ),
            )
            total = lambda name: F.aggregate(seen, F.lit(0), lambda a, x: a + x[name])
            return F.struct(
                F.when(position == 0, F.concat(state["groups"], new)).otherwise(grown).alias("groups"),
                (state["calls"] + total("calls")).alias("calls"),
                (state["unreadable"] + total("unreadable")).alias("unreadable"),
            )

        def found(looked: Column) -> Column:
            position = F.array_position(F.transform(looked, lambda x: x["match"]), True)
            return grading.let(F.struct(looked.alias("looked"), position.alias("position")), placed)

        return grading.let(F.transform(state["groups"], lambda g: look(g["rep"], item)), found)

    folded = joined.withColumn("_f", F.aggregate("draws", start, place))
    sizes = F.transform("_f.groups", lambda g: g["size"])
    best = F.array_max(
        F.transform(
            "_f.groups",
            lambda g: F.struct(g["size"].alias("s"), (-g["rep"]["sample_index"]).alias("f")),
        )
    )
    return folded.select(
        *keys,
        F.sort_array(sizes, asc=False).alias("sizes"),
        stats.discrete_entropy(sizes).alias("entropy"),
        (-best["f"]).alias("answer_index"),
        *(["draws"] if carry else []),
        F.col("_f.calls").alias("calls"),
        F.col("_f.unreadable").alias("unreadable"),
    )


# ----------------------------------------------------------------------- logistic fits

MIN_CALIBRATION_TASKS = 30


@dataclass(frozen=True)
class LogisticScorer:
    """A fitted one-tier scorer: a handful of numbers, applied as a plain column."""

    tier: str
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    fitted_on: int
    positive_rate: float
    degenerate: bool = False
    warnings: tuple[str, ...] = field(default_factory=tuple)

    def score(self) -> Column:
        """P(correct) in [0, 1]; the base rate when nothing could be learned."""
        if self.degenerate:
            return F.lit(self.positive_rate)
        z = F.lit(self.intercept)
        for name, mean, scale, w in zip(
            self.features, self.means, self.scales, self.weights, strict=True
        ):
            z = z + F.lit(w) * (F.col(name) - F.lit(mean)) / F.lit(scale)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_logistic(
    rows: DataFrame,
    features: list[str],
    label: str = "label",
    weight: str | None = None,
    C: float = 1.0,
    tier: str = "",
) -> LogisticScorer:
    """L2 logistic regression on standardised features, on the calibration rows given.

    One aggregation gives the means, population deviations and class counts. The objective
    ``C * sum(w * loss) + |beta|^2 / 2`` is Spark's with ``regParam = 1 / (C * sum(w))``. With one
    class, or no spread in any feature, the scorer is the base rate and says so.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    head = rows.agg(
        F.count("*").alias("n"),
        F.avg(label).alias("rate"),
        F.sum(w).alias("w"),
        *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)],
    ).first()
    if not head["n"]:
        raise ValueError("a scorer needs at least one calibration example")
    means = tuple(float(head[f"m_{i}"]) for i in range(len(features)))
    spread = tuple(float(head[f"s_{i}"]) for i in range(len(features)))
    scales = tuple(s if s > 0 else 1.0 for s in spread)
    notes = []
    if head["n"] < MIN_CALIBRATION_TASKS:
        notes.append(f"only {head['n']} calibration tasks")
    if head["rate"] in (0.0, 1.0) or not any(s > 0 for s in spread):
        notes.append(
            "one outcome only" if head["rate"] in (0.0, 1.0) else "no spread in any feature"
        )
        return LogisticScorer(
            tier, tuple(features), means, scales, (0.0,) * len(features), 0.0, head["n"],
            float(head["rate"]), True, tuple(notes),
        )
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scaled = rows.select(
        F.col(label).cast("double").alias("label"),
        w.cast("double").alias("_w"),
        *[
            ((F.col(f) - F.lit(m)) / F.lit(s)).alias(f"_x{i}")
            for i, (f, m, s) in enumerate(zip(features, means, scales, strict=True))
        ],
    )
    vectors = VectorAssembler(
        inputCols=[f"_x{i}" for i in range(len(features))], outputCol="features"
    ).transform(scaled)
    model = LogisticRegression(
        regParam=1.0 / (C * float(head["w"])),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-10,
        weightCol="_w",
    ).fit(vectors)
    return LogisticScorer(
        tier, tuple(features), means, scales, tuple(float(c) for c in model.coefficients),
        float(model.intercept), head["n"], float(head["rate"]), False, tuple(notes),
    )


# ------------------------------------------------------------------------- scorer kinds


@dataclass(frozen=True)
class ScorerKind:
    """A registered scorer: the features it needs, as a table, and the calls one task costs.

    ``told``, where there is one, prepares by other keys the tasks whose replies are quickly read, and says which are.
    """

    name: str
    prepare: Callable[..., DataFrame]
    features: tuple[str, ...]
    calls_per_task: Callable[[int], int]
    told: Callable[[DataFrame, int, list[str]], DataFrame] | None = None


SCORERS: dict[str, ScorerKind] = {}


def register_scorer(kind: ScorerKind) -> None:
    if kind.name in SCORERS:
        raise ValueError(f"scorer {kind.name!r} is already registered")
    SCORERS[kind.name] = kind


def scorer_kind(name: str) -> ScorerKind:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; registered: {sorted(SCORERS)}")
    return SCORERS[name]


def _prepare_logistic(samples: DataFrame, k: int, features: list[str] | None = None) -> DataFrame:
    return with_features(samples.where(F.col("sample_index") == 0), features or ["output_parses", "output_length"])


def _prepare_self_consistency(samples: DataFrame, k: int) -> DataFrame:
    if k < 2:
        raise ValueError("agreement needs at least two samples per task")
    return agreement(samples, k).withColumnRenamed("entropy", "sample_entropy")


def _tell_self_consistency(samples: DataFrame, k: int, keys: list[str]) -> DataFrame:
    if k < 2:
        raise ValueError("agreement needs at least two samples per task")
    return numbers_agreement(samples, k, keys).withColumnRenamed("entropy", "sample_entropy")


def _prepare_semantic(samples: DataFrame, k: int, judgements: DataFrame, judge_cost: Column) -> DataFrame:
    """Meaning clusters, with the draws and the judging calls charged to the task."""
    if k < 2:
        raise ValueError("agreement needs at least two samples per task")
    carry = ["output", "cost", *(["correct"] if "correct" in samples.columns else [])]
    answers = samples.where(F.col("sample_index") < k).select(
        "task_id", "tier", "sample_index", grading.extract_answer(F.col("output")).alias("answer"), *carry
    )
    clusters = entailment_clusters(answers, judgements, carry=carry)
    complete = F.when(F.size("draws") == k, F.col("draws")).otherwise(
        F.raise_error(F.concat(F.lit(f"fewer than {k} samples for task "), F.col("task_id").cast("string")))
    )
    clusters = clusters.withColumn("draws", complete)
    chosen = F.element_at(F.filter("draws", lambda d: d["sample_index"] == F.col("answer_index")), 1)
    spent = F.aggregate(
        "draws", F.lit(0).cast("decimal(38,12)"), lambda a, d: (a + d["cost"]).cast("decimal(38,12)")
    )
    return clusters.select(
        "task_id", "tier", "sizes", F.col("entropy").alias("sample_entropy"), "answer_index",
        "calls", "unreadable", (spent + F.col("calls") * judge_cost).alias("cost"),
        *[chosen[name].alias(name) for name in carry if name != "cost"],
    )


register_scorer(
    ScorerKind("logistic-v1", _prepare_logistic, ("output_parses", "output_length"), lambda k: 1)
)
register_scorer(
    ScorerKind(
        "self-consistency-v1", _prepare_self_consistency, ("sample_entropy",), lambda k: k, _tell_self_consistency
    )
)
register_scorer(
    ScorerKind("semantic-entropy-v1", _prepare_semantic, ("sample_entropy",), lambda k: k * k)
)


def score_tiers(
    prepared: DataFrame, features: list[str], calibration: Column, label: str = "correct",
    weight: str | None = None, tiers: list[str] | None = None,
) -> tuple[DataFrame, list[LogisticScorer]]:
    """Fit one scorer per tier on calibration rows and add ``score`` to every row.

    Fits are a few small jobs (one per tier); scoring is one expression over the table.
    """
    names = tiers or [r["tier"] for r in prepared.select("tier").distinct().orderBy("tier").collect()]
    score, fitted = F.lit(None).cast("double"), []
    for tier in names:
        scorer = fit_logistic(
            prepared.where(calibration & (F.col("tier") == tier)), features, label, weight, tier=tier
        )
        fitted.append(scorer)
        score = F.when(F.col("tier") == tier, scorer.score()).otherwise(score)
    return prepared.withColumn("score", score), fitted


def auroc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by group, null for one class; ties count half.

    Equal scores are counted before the shuffle and ranks come from bucketed running sums, so one
    tier may hold any number of rows and of distinct scores.
    """
    counts = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("_neg"),
    )
    ranked = running_before(
        counts, keys, F.floor(F.col(score) * 1024), [F.col(score)], {"_below": F.col("_neg")}
    )
    sums = ranked.groupBy(*keys).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.sum(
            F.col("_pos").cast("decimal(19,0)")
            * (2 * F.col("_below") + F.col("_neg")).cast("decimal(19,0)")
        ).alias("_u2"),
    )
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    area = F.when((p > 0) & (n > 0), F.col("_u2").cast("double") / (2 * p * n))
    return sums.select(*keys, "positives", "negatives", area.alias("auroc"))
