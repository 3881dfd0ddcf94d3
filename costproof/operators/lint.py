"""Prompt rules over a table of requests.

``requests``: ``request_id, system, user`` (arrays of ``struct<text, cache>``), ``tools`` (text, null
when there are none), ``max_tokens``, ``observed_output_tokens`` and ``needed_output_tokens`` (nullable)
and the price columns ``p_input, p_output, p_cache_read, p_minimum``. Money is ``tokens x rate x scale``
per 1,000 calls.

Every rule but one is a column over one row, so they share one scan and need no shuffle. Duplicate
instructions are a set-similarity join inside each request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costproof import fixed
from costproof.functions import blocks as B
from costproof.functions import tokens as T
from costproof.functions.grading import let
from costproof.runtime import written

# Where a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# A break other than a line feed, or one of a few other control characters.
OTHER_BREAKS = r"[\u000b-\u001e\u0085\u2028\u2029]"
SPAN = "struct<section:string,block:int,start:int,end:int,text:string>"


# Lower-case texts that every match of a pattern holds: one of each group. A plain search for them is much cheaper than
# the pattern, the more so as they begin with rare letters; the pattern is asked where they are found, and alone decides.
NEEDLES: dict[str, tuple[tuple[str, ...], ...]] = {
    fixed.COURTESY: ((
        "please", "hank", "ppreciate", "kindly", "f you", "feel free", "portant that", "job", "y your", "ber that",
        "keep in mind", "hope", "perhaps", "ybe", "generally a", "what", "little", "bit", "sort of", "kind of", "best",
        "whenever",
    ),),
    fixed.VAGUE_VERBS: ((
        "p with", "p out", "k at", "handle", "deal with", "ke care", "work on", "mething", "what you can", "assist with",
        "see to", "see about",
    ),),
    fixed.OUTPUT_CONTRACT_PATTERN: (
        ("json", "one word", "one line", "one number", "one object", "exactly", "the following ", "{", "<"),
        ("reply", "respond", "answer", "return", "output"),
    ),
    fixed.LENGTH_CAP: (
        ("one", "1", "more than", "most", "under", "fewer than", "ximum of", "mit", "within", "gle"),
        ("word", "token", "sentence", "character", "line", "item", "number", "json object"),
    ),
    fixed.ROLE: (("you are a", "you are the"),),
    fixed.TASK_LINE: (("task", "objective", "goal"),),
    fixed.SUCCESS: ((
        "success criteria", "what good looks", "how to get it right", "a good answer", "you are correct", "done when",
    ),),
    fixed.EXAMPLE_MARKER: (("example", ":"),),
    fixed.CONFLICT_PAIRS[0][0]: (("be concise",),),
    fixed.CONFLICT_PAIRS[1][0]: (("be brief",),),
    fixed.CONFLICT_PAIRS[2][0]: (("guess",), ("never",)),
    fixed.CONFLICT_PAIRS[3][0]: (("only use", "only rely on"), ("provided",)),
    fixed.CONFLICT_PAIRS[4][0]: (("do not explain",),),
    fixed.HARDCODED[0]: (("http", "www."),),
    fixed.HARDCODED[1]: (("@",),),
    fixed.HARDCODED[3]: (("19", "20"), ("-",)),
    fixed.HARDCODED[4]: (("$",),),
}
# The characters beyond ASCII that a pattern without case takes for a letter of ASCII; texts with any are always asked.
FOLDED = "\u0130\u0131\u017f\u212a"


def rx(pattern: str) -> str:
    """A pattern with Unicode-aware classes."""
    return "(?U)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(0))


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def may_match(block: Column, pattern: str) -> Column:
    """Whether a profiled block can hold a match of a pattern: false only where it holds none."""
    found = F.lit(True)
    for needles in NEEDLES.get(pattern, ()):
        found = found & _any(block["lower"], needles)
    return block["odd"] | found


def holds(blocks: Column, text: Column, pattern: str) -> Column:
    """Whether the blocks' joined text holds a match of a pattern; needles have no line break, so they lie in one block each."""
    found = F.lit(True)
    for needles in NEEDLES.get(pattern, ()):
        found = found & F.exists(blocks, (lambda group: lambda b: b["odd"] | _any(b["lower"], group))(needles))
    return F.when(text.isNotNull(), found & text.rlike(rx(pattern)))


def spans(block: Column, pattern: str) -> Column:
    """Where a pattern matches in a block: array of spans, from the pieces between the matches.

    A text is searched once for its matches; only one that has any is searched again for the pieces.
    """
    nothing = F.array().cast(f"array<{SPAN}>")

    def one(begin: Column, word: Column) -> Column:
        return F.struct(
            block["section"].alias("section"),
            block["index"].cast("int").alias("block"),
            begin.alias("start"),
            (begin + F.length(word)).alias("end"),
            word.alias("text"),
        )

    def placed(found: Column) -> Column:
        pieces = F.split(block["text"], rx(pattern), -1)
        # Each match goes with the length of the piece before it; the last piece has no match.
        steps = F.zip_with(
            F.slice(F.transform(pieces, lambda p: F.length(p)), F.lit(1), F.size(found)), found,
            lambda gap, word: F.struct(gap.alias("gap"), word.alias("word")),
        )
        start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

        def place(acc: Column, step: Column) -> Column:
            begin = acc["at"] + step["gap"]
            return F.struct(
                (begin + F.length(step["word"])).alias("at"),
                F.concat(acc["spans"], F.array(one(begin, step["word"]))).alias("spans"),
            )

        return F.aggregate(steps, start, place)["spans"]

    return let(
        matches(block["text"], pattern), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(nothing)
    )


def all_spans(blocks: Column, *patterns: str) -> Column:
    """Spans of several patterns over several profiled blocks, block by block."""
    nothing = F.array().cast(f"array<{SPAN}>")
    asked = lambda b, p: F.when(may_match(b, p), spans(b, p)).otherwise(nothing)
    return F.flatten(F.transform(blocks, lambda b: F.concat(*[asked(b, p) for p in patterns])))


def whole_span(block: Column) -> Column:
    """The span of a whole block; a caller that displays it shortens it."""
    return F.struct(
        block["section"].alias("section"),
        block["index"].cast("int").alias("block"),
        F.lit(0).alias("start"),
        F.length(block["text"]).alias("end"),
        block["text"].alias("text"),
    )


def counted(blocks: Column, whole: Column) -> Column:
    """Tokens of profiled blocks joined, without counting their texts again."""
    return T.joined_tokens(F.transform(blocks, lambda b: b["text"]), F.transform(blocks, lambda b: b["tokens"]), whole)


def profiled(requests: DataFrame) -> DataFrame:
    """Blocks with tokens and volatility, the prefix, and the counts every rule reads."""

    def sectioned(name: str) -> Column:
        return F.transform(
            F.coalesce(F.col(name), F.array().cast(B.BLOCK_TYPE)),
            lambda b, i: F.struct(
                F.lit(name).alias("section"),
                i.alias("index"),
                b["text"].alias("text"),
                b["cache"].alias("cache"),
                T.approx_tokens(b["text"]).alias("tokens"),
                F.coalesce(F.lower(b["text"]), F.lit("")).alias("lower"),
                F.coalesce(_any(b["text"], tuple(FOLDED)), F.lit(False)).alias("odd"),
            ),
        )

    staged = requests.withColumn("_b", F.concat(sectioned("system"), sectioned("user")))
    staged = staged.withColumn(
        "_b", F.transform("_b", lambda b: b.withField("volatile", B.is_volatile(b["text"], b["tokens"])))
    )
    wire = F.concat(F.col("system"), F.col("user"))
    staged = staged.withColumn("_prefix", B.static_prefix(wire)).withColumn(
        "_system", B.joined(F.col("system"))
    )
    staged = staged.withColumn("_full", B.joined(wire))
    longest = F.array_max(F.transform("_b", lambda b: F.length(b["text"])))
    largest = F.element_at(F.filter("_b", lambda b: F.length(b["text"]) == longest), 1)
    has_tools = F.coalesce(F.col("tools") != "", F.lit(False))
    overhead = F.coalesce(F.col("tool_overhead"), F.lit(0)) if "tool_overhead" in requests.columns else F.lit(0)
    return staged.select(
        "*",
        counted(F.slice("_b", F.lit(1), B.last_breakpoint(wire)), F.col("_prefix")).alias("_prefix_tokens"),
        largest["tokens"].alias("_largest_tokens"),
        (
            counted(F.filter("_b", lambda b: b["section"] == "system"), F.col("_system"))
            + F.when(has_tools, T.approx_tokens(F.col("tools")) + overhead).otherwise(0)
        ).alias("_overhead"),
    )


def _finding(
    rule: str, group: str, fires: Column, amount: Column | float, confidence: Column | str,
    evidence: Column, transform: str | None, where: Column | None = None,
) -> Column:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    dollars = F.lit(float(amount)) if isinstance(amount, (int, float)) else amount.cast("double")
    return F.when(
        fires,
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(group).alias("group"),
            dollars.alias("per_1k"),
            sure.alias("confidence"),
            evidence.alias("evidence"),
            F.lit(transform).cast("string").alias("transform"),
            (F.array().cast(f"array<{SPAN}>") if where is None else where).alias("spans"),
        ),
    )


def _staged(table: DataFrame) -> DataFrame:
    """What several fields of a finding read, computed once per row."""
    blocks, prefix = F.col("_b"), F.col("_prefix")
    stable_at = F.array_position(
        F.transform(blocks, lambda b: b["tokens"] > fixed.STATIC_BLOCK_TOKENS), True
    )
    first = table.select(
        "*",
        F.filter(
            blocks, lambda b: b["volatile"] & ((prefix == "") | prefix.contains(b["text"]))
        ).alias("_front"),
        stable_at.alias("_stable_at"),
        F.filter(blocks, lambda b: b["section"] == "system").alias("_sys"),
        F.filter(
            blocks,
            lambda b: (b["tokens"] <= fixed.DOCUMENT_TOKENS)
            & (b["tokens"] >= fixed.INSTRUCTION_MIN_TOKENS),
        ).alias("_templates"),
        holds(blocks, F.col("_full"), fixed.OUTPUT_CONTRACT_PATTERN).alias("_contract"),
        holds(blocks, F.col("_full"), fixed.LENGTH_CAP).alias("_cap"),
        all_spans(blocks, fixed.COURTESY).alias("_filler"),
        F.filter(
            blocks,
            lambda b: (b["tokens"] > fixed.FEWSHOT_EXAMPLE_TOKENS)
            & may_match(b, fixed.EXAMPLE_MARKER)
            & (F.size(matches(b["text"], fixed.EXAMPLE_MARKER)) >= 2),
        ).alias("_examples"),
        F.array_compact(
            F.array(
                F.when(~holds(blocks, F.col("_system"), fixed.ROLE), F.lit("role")),
                F.when(~holds(blocks, F.col("_system"), fixed.TASK_LINE), F.lit("task statement")),
                F.when(~holds(blocks, F.col("_system"), fixed.SUCCESS), F.lit("success criteria")),
            )
        ).alias("_missing"),
        F.array_compact(
            F.array(
                *[
                    F.when(holds(blocks, F.col("_full"), a) & F.col("_full").rlike(rx(b)), F.lit(label))
                    for a, b, label in fixed.CONFLICT_PAIRS
                ]
            )
        ).alias("_conflicts"),
        F.filter(
            blocks,
            lambda b: (b["tokens"] >= fixed.WALL_OF_TEXT_TOKENS)
            & ~(b["text"].contains("|") | b["text"].rlike(rx(fixed.STRUCTURE))),
        ).alias("_walls"),
    )
    instructed = F.filter("_sys", lambda b: b["tokens"] <= fixed.DOCUMENT_TOKENS)
    instructions = F.array_join(F.transform(instructed, lambda b: b["text"]), "\n\n")
    second = first.select(
        "*",
        F.filter(
            blocks,
            lambda b, i: (i + 1 < F.col("_stable_at"))
            & (b["volatile"] | (b["tokens"] < fixed.DYNAMIC_BLOCK_TOKENS)),
        ).alias("_before"),
        all_spans(F.col("_front"), fixed.VOLATILE_PHRASE, *fixed.STAMP_PATTERNS).alias("_front_spans"),
        all_spans(F.col("_sys"), fixed.VAGUE_VERBS).alias("_vague"),
        all_spans(F.col("_templates"), *fixed.HARDCODED).alias("_specifics"),
        F.aggregate(
            "_filler", F.lit(0).cast("bigint"), lambda a, s: a + T.approx_tokens(s["text"])
        ).alias("_filler_tokens"),
        F.aggregate(
            "_examples", F.lit(0).cast("bigint"), lambda a, b: a + b["tokens"]
        ).alias("_example_tokens"),
        instructions.alias("_instructions"),
    )
    third = second.select("*", counted(instructed, F.col("_instructions")).alias("_instruction_tokens"))
    clauses = F.regexp_extract_all("_instructions", F.lit(rx(fixed.IMPERATIVE_CLAUSE)), F.lit(1))
    return third.select(
        "*",
        F.when(
            F.col("_instruction_tokens") > fixed.COMPOSE_TOKENS,
            F.array_distinct(F.transform(clauses, lambda m: F.lower(F.trim(m)))),
        ).otherwise(F.array().cast("array<string>")).alias("_jobs"),
    )


def _row_rules(scale: float) -> tuple[list[Column], Column]:
    """One finding per rule, and the per-block rule as an array, over a ``_staged`` table."""
    k = F.lit(1000.0 * scale)
    p_in, p_out, p_read = (F.col(c).cast("double") for c in ("p_input", "p_output", "p_cache_read"))
    blocks, pt = F.col("_b"), F.col("_prefix_tokens")
    has_prefix = F.col("_prefix") != ""
    largest = F.col("_largest_tokens")

    def cacheable(tokens: Column) -> Column:
        return tokens * (p_in - p_read) * k

    rate = F.when(has_prefix, p_read).otherwise(p_in)
    in_front, stable_at, before = F.col("_front"), F.col("_stable_at"), F.col("_before")
    contract, cap = F.col("_contract"), F.col("_cap")
    measured = F.col("observed_output_tokens").isNotNull() & F.col("needed_output_tokens").isNotNull()
    excess = F.when(
        measured,
        F.bround(F.greatest(F.lit(0.0), F.col("observed_output_tokens") - F.col("needed_output_tokens"))),
    ).otherwise(F.bround(F.col("max_tokens") * F.lit(fixed.UNCAPPED_OUTPUT_SHARE)))
    filler, filler_tokens = F.col("_filler"), F.col("_filler_tokens")
    examples, example_tokens = F.col("_examples"), F.col("_example_tokens")
    missing, vague, conflicts = F.col("_missing"), F.col("_vague"), F.col("_conflicts")
    walls, jobs, specifics = F.col("_walls"), F.col("_jobs"), F.col("_specifics")
    front_spans = F.col("_front_spans")
    names = F.transform(filler, lambda s: s["text"])
    single = [
        _finding(
            "PL01", "Cache", F.size(in_front) > 0,
            cacheable(F.when(pt > 0, pt).otherwise(largest)), "projected",
            F.concat_ws("; ", F.transform(front_spans, lambda s: s["text"])),
            "move_volatile_after_breakpoint", front_spans,
        ),
        _finding(
            "PL02", "Cache", (stable_at > 1) & (F.size(before) > 0), cacheable(largest), "projected",
            F.format_string("%d variable blocks before the static one", F.size(before)),
            "reorder_static_first", F.transform(before, lambda b: whole_span(b)),
        ),
        _finding(
            "PL03", "Cache", has_prefix & (pt < F.col("p_minimum")), cacheable(pt), "heuristic",
            F.format_string("prefix of %d tokens", pt), "grow_or_drop_prefix",
        ),
        _finding(
            "PL05", "Cache", (F.col("_overhead") > fixed.LARGE_OVERHEAD_TOKENS) & ~has_prefix,
            cacheable(F.col("_overhead")), "projected",
            F.format_string("%d tokens of fixed overhead", F.col("_overhead")),
            "add_breakpoint_after_static",
        ),
        _finding(
            "PL06", "C", ~(contract & cap), excess * p_out * k,
            F.when(measured, "measured").otherwise("projected"),
            F.concat_ws("; ", F.when(~contract, F.lit("no format")), F.when(~cap, F.lit("no cap"))),
            "add_output_contract",
        ),
        _finding(
            "PL08", "L", F.size(filler) > 0, filler_tokens * rate * k, "projected",
            F.concat_ws(", ", names), "strip_courtesy", filler,
        ),
        _finding(
            "PL09", "L", F.size(examples) > 0,
            F.bround(example_tokens * F.lit(fixed.FEWSHOT_REMOVABLE)) * p_in * k, "heuristic",
            F.format_string("%d example blocks", F.size(examples)), "trim_examples",
            F.transform(examples, lambda b: whole_span(b)),
        ),
        _finding(
            "PL10", "E", (F.size(missing) > 0) | (F.size(vague) > 0), 0.0, "heuristic",
            F.concat_ws(", ", missing), "add_role_task_criteria", vague,
        ),
        _finding(
            "PL11", "E", F.size(conflicts) > 0, 0.0, "heuristic", F.concat_ws("; ", conflicts),
            "resolve_conflicts",
        ),
        _finding(
            "PL12", "A", F.size(walls) > 0, 0.0, "heuristic",
            F.format_string("%d unstructured blocks", F.size(walls)), "add_structure",
            F.transform(walls, lambda b: whole_span(b)),
        ),
        _finding(
            "PL13", "R", F.size(specifics) > 0, 0.0, "heuristic",
            F.concat_ws(", ", F.transform(specifics, lambda s: s["text"])),
            "parameterize", specifics,
        ),
        _finding(
            "PL14", "A",
            (F.col("_instruction_tokens") > fixed.COMPOSE_TOKENS) & (F.size(jobs) >= fixed.COMPOSE_JOBS),
            0.0, "heuristic",
            F.concat_ws(", ", F.sort_array(jobs)), None,
        ),
    ]
    on_volatile = F.transform(
        F.filter(blocks, lambda b: b["cache"].isNotNull() & b["volatile"]),
        lambda b: _finding(
            "PL04", "Cache", F.lit(True), cacheable(b["tokens"]), "projected",
            F.format_string("%s block %d varies per call", b["section"], b["index"]),
            "move_breakpoint_to_static_end", F.array(whole_span(b)),
        ),
    )
    return single, on_volatile


# ------------------------------------------------------------- duplicate instructions


def lines_of(text: Column) -> Column:
    """The lines of a text; where line feeds alone break it, which most texts, a plain split does."""
    return F.when(text.rlike(OTHER_BREAKS), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))


def bare_line(raw: Column) -> Column:
    """A line without its marks and the white space around them; most lines have neither."""
    ends = F.concat(F.left(raw, F.lit(1)), F.right(raw, F.lit(1)))
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[-*]+", ""), r"(?U)^\s+|\s+$", "")
    return F.when(ends.rlike(r"(?U)^[^\s*-]\S"), raw).otherwise(bare)


def instruction_lines(requests: DataFrame) -> DataFrame:
    """Lines of 20 to 300 characters in wire order, with their 3-gram sets.

    Lines are read before they become rows: a filter on rows would be planned beside each step and repeat it.
    """
    wire = F.concat(F.col("system"), F.col("user"))
    raws = F.flatten(F.transform(wire, lambda b: lines_of(b["text"])))

    def told(line: Column, pos: Column) -> Column:
        words = F.when(F.length(line).between(20, 300), B.words(line))
        return F.struct(pos.alias("pos"), line.alias("line"), words.alias("words"))

    lines = F.transform(raws, lambda raw, i: let(bare_line(raw), lambda line: told(line, i)))
    kept = F.filter(lines, lambda e: F.size(e["words"]) >= 3)
    rows = requests.select("request_id", F.inline(kept))
    return rows.select("request_id", "pos", "line", F.sort_array(B.grams_of(F.col("words"))).alias("grams"))


def similar_sets(
    sets: DataFrame, keys: list[str], threshold: float = fixed.DUPLICATE_THRESHOLD
) -> DataFrame:
    """Pairs of distinct sets of one group with Jaccard at or over the threshold, exactly.

    ``sets``: keys, ``set_id, grams`` (sorted, distinct). Two sets that similar must share an element
    among their first ``n - ceil(t n) + 1`` elements in a common order, so only those are joined;
    candidates are then verified on the whole sets. Elements are ordered by hash, which spreads common
    ones.
    """
    ordered = sets.withColumn(
        "_g", F.sort_array(F.transform("grams", lambda g: F.xxhash64(g)))
    ).withColumn("_n", F.size("grams"))
    reach = (F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n") - 1e-9) + 1).cast("int")
    rows = ordered.withColumn("_t", F.explode(F.slice("_g", F.lit(1), reach)))
    left = rows.select(*keys, "_t", F.col("set_id").alias("a"), F.col("_n").alias("na"))
    right = rows.select(*keys, "_t", F.col("set_id").alias("b"), F.col("_n").alias("nb"))
    sized = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (
        F.col("nb") >= F.col("na") * threshold - 1e-9
    )
    candidates = (
        left.join(right, [*keys, "_t"]).where((F.col("a") < F.col("b")) & sized).select(*keys, "a", "b").distinct()
    )
    one = sets.select(*keys, F.col("set_id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(*keys, F.col("set_id").alias("b"), F.col("grams").alias("gb"))
    scored = candidates.join(one, [*keys, "a"]).join(two, [*keys, "b"])
    return scored.withColumn("score", B.jaccard(F.col("ga"), F.col("gb"))).where(
        F.col("score") >= threshold
    ).drop("ga", "gb")


def duplicate_instructions(requests: DataFrame) -> DataFrame:
    """Per request: pairs of near-equal lines, the tokens of the later ones, whether all of those sit
    in the prefix.

    Lines with equal 3-gram sets are one class, and pairs are counted from positions inside and
    across classes, so a line repeated many times never becomes all of its pairs.
    """
    # Read by five branches below and costly to build: written once.
    lines = written(
        instruction_lines(requests).select(
            "*",
            F.xxhash64(F.concat_ws("\u0001", "grams")).alias("set_id"),
            T.approx_tokens(F.col("line")).alias("tokens"),
        )
    )
    prefix = requests.select(
        "request_id", B.static_prefix(F.concat(F.col("system"), F.col("user"))).alias("_prefix")
    )
    counted = lines.join(prefix, "request_id").select(
        "request_id",
        "pos",
        "set_id",
        "tokens",
        ((F.col("_prefix") != "") & F.col("_prefix").contains(F.col("line"))).alias("inside"),
    )
    inside = Window.partitionBy("request_id", "set_id").orderBy("pos")
    same = counted.withColumn("earlier", (F.row_number().over(inside) - 1).cast("bigint"))
    own = same.select("request_id", "earlier", "tokens", "inside")
    sets = lines.groupBy("request_id", "set_id").agg(F.first("grams").alias("grams"))
    pairs = similar_sets(sets, ["request_id"])
    members = pairs.select(
        "request_id", "a", "b", F.explode(F.array("a", "b")).alias("set_id")
    ).join(counted, ["request_id", "set_id"])
    before = (
        Window.partitionBy("request_id", "a", "b")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    in_a = (F.col("set_id") == F.col("a")).cast("bigint")
    crossed = members.select(
        "request_id", "tokens", "inside", "set_id", "a",
        F.coalesce(F.sum(in_a).over(before), F.lit(0)).alias("_a"),
        F.coalesce(F.sum(1 - in_a).over(before), F.lit(0)).alias("_b"),
    )
    other = crossed.select(
        "request_id",
        F.when(F.col("set_id") == F.col("a"), F.col("_b")).otherwise(F.col("_a")).alias("earlier"),
        "tokens",
        "inside",
    )
    later = own.unionByName(other).where(F.col("earlier") > 0)
    return later.groupBy("request_id").agg(
        F.sum("earlier").alias("pairs"),
        F.sum(F.col("earlier") * F.col("tokens")).alias("duplicate_tokens"),
        F.bool_and("inside").alias("all_in_prefix"),
    )


def lint(requests: DataFrame, scale: float = 1.0) -> DataFrame:
    """Every rule over every request: one row per finding, unordered (``findings.rank`` orders)."""
    return row_findings(requests, scale).unionByName(duplicate_findings(requests, scale))


def row_findings(requests: DataFrame, scale: float = 1.0) -> DataFrame:
    """Every rule but the duplicate lines, which alone compare lines: one scan, no shuffle."""
    single, per_block = _row_rules(scale)
    table = _staged(profiled(requests))
    found = F.concat(F.array_compact(F.array(*single)), per_block)
    return table.select("request_id", F.explode(found).alias("_f")).select("request_id", "_f.*")


def duplicate_findings(requests: DataFrame, scale: float = 1.0) -> DataFrame:
    """Duplicate instructions as findings."""
    prices = requests.select("request_id", "p_input", "p_cache_read")
    dup = duplicate_instructions(requests).join(prices, "request_id")
    rate = F.when(F.col("all_in_prefix"), F.col("p_cache_read")).otherwise(F.col("p_input"))
    one = _finding(
        "PL07", "L", F.lit(True),
        F.col("duplicate_tokens") * rate.cast("double") * F.lit(1000.0 * scale), "projected",
        F.format_string("%d pairs of near-equal lines", "pairs"), "remove_duplicate_instructions",
    )
    return dup.select("request_id", one.alias("_f")).select("request_id", "_f.*")


def clear_scores(
    findings: DataFrame, keys: list[str] | None = None, requests: DataFrame | None = None
) -> DataFrame:
    """A 1 to 5 score per letter and group: 5 clean, the first rule costs two points, each further
    one, never under 1. With ``requests`` every one of them has a row, and those without findings
    score 5 everywhere."""
    keys = keys or ["request_id"]
    if requests is not None:
        every = requests.select(*keys, F.lit(None).cast("string").alias("rule")).distinct()
        findings = findings.select(*keys, "rule").unionByName(every)
    columns = []
    for letter in fixed.CLEAR_LETTERS:
        rules = [r for r, x in fixed.RULE_LETTER.items() if x == letter]
        fired = F.count(F.when(F.col("rule").isin(*rules), 1))
        columns.append(
            F.when(fired == 0, 5).otherwise(F.greatest(F.lit(1), 4 - fired)).cast("int").alias(letter)
        )
    return findings.groupBy(*keys).agg(*columns)
