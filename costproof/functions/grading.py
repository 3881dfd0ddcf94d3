"""Reading and grading answers as columns.

Everything here stays in the JVM, accent folding included.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from costproof import fixed

# Every character that counts as white space at the ends of a text.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding to ASCII, generated from the Unicode database.

    Characters with a one-letter fold as two aligned strings, and the few with a longer one as a map.
    """
    source, target, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            longer[char] = folded
    return "".join(source), "".join(target), longer


def _fold_text(text: Column) -> Column:
    source, target, longer = _folding()
    entries = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    several = "[" + "".join(longer) + "]"

    def expand(t: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(t, ""), lambda c: F.coalesce(F.try_element_at(entries, c), c)
            ),
            "",
        )

    single = F.translate(text, source, target)
    spelled = let(single, lambda t: F.when(t.rlike(several), expand(t)).otherwise(t))
    return F.regexp_replace(spelled, r"[^\x00-\x7f]", "")


def ascii_fold(text: Column) -> Column:
    """NFKD to ASCII; pure ASCII text passes through."""
    return let(
        text, lambda t: F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(_fold_text(t))
    )


def normalize_ascii(text: Column) -> Column:
    """``normalize_text`` for text already known to be ASCII."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"[^\w\s.%-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Case-fold, strip accents and punctuation, collapse white space."""
    return normalize_ascii(ascii_fold(text))


def json_text(output: Column) -> Column:
    """The JSON object inside a reply as text, or null when there is none."""

    def object_in(text: Column) -> Column:
        start = F.locate("{", text)
        end = F.length(text) - F.locate("}", F.reverse(text)) + 1
        body = F.when(
            (start > 0) & text.contains("}") & (end > start),
            F.substring(text, start, end - start + 1),
        )
        return let(body, lambda j: F.when(F.json_object_keys(j).isNotNull(), j))

    def inside(text: Column) -> Column:
        fenced = F.regexp_extract(text, fixed.CODE_FENCE, 1)
        chosen = F.when(
            text.contains("```"), let(fenced, lambda f: F.when(f != "", strip(f)).otherwise(text))
        ).otherwise(text)
        return F.when(text.contains("{"), let(chosen, object_in))

    return let(strip(output), inside)


def _json_has(body: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(body), key), F.lit(False))


_PLAIN_REPLY = r"\AFinal answer: [0-9]+\z"


def extract_answer(output: Column) -> Column:
    """The answer of a reply: JSON ``answer``, else the last ``Final answer:`` line, else a short
    one-line reply as it stands. JSON without ``answer`` is no answer. A reply that is nothing but such a line with a
    whole number is told by one pattern."""

    def read(p: Column) -> Column:
        whole, body, line = p["whole"], p["body"], p["line"]
        return (
            F.when(whole.isNull() | (whole == ""), F.lit(None).cast("string"))
            .when(
                body.isNotNull(),
                F.when(_json_has(body, "answer"), strip(F.get_json_object(body, "$.answer"))),
            )
            .when(line.isNotNull(), strip(F.regexp_replace(strip(line), r"\.+$", "")))
            .when((F.length(whole) <= 80) & ~whole.contains("\n"), whole)
        )

    lines = F.regexp_extract_all(output, F.lit(fixed.FINAL_ANSWER), F.lit(1))
    parts = F.struct(
        strip(output).alias("whole"),
        json_text(output).alias("body"),
        F.try_element_at(lines, F.lit(-1)).alias("line"),
    )
    return F.when(output.rlike(_PLAIN_REPLY), F.substr(output, F.lit(len("Final answer: ") + 1))).otherwise(let(parts, read))


def parse_number(text: Column) -> Column:
    """First number in a text, without currency signs, grouping commas and percent signs."""
    found = F.regexp_extract(text, fixed.NUMBER, 0)
    bare = F.regexp_replace(found, r"[$,%]|^\s+|\s+$", "")
    return F.regexp_replace(bare, r"\s+", "").try_cast("decimal(28,8)")


def _yes_no(normalized: Column) -> Column:
    refusals = F.array(*[F.lit(w) for w in fixed.NO_WORDS])

    def read(p: Column) -> Column:
        bare, first = p["bare"], p["first"]
        return (
            F.when(bare == "", F.lit(None).cast("string"))
            .when(bare.isin(*fixed.YES_WORDS), F.lit("yes"))
            .when(bare.isin(*fixed.NO_WORDS), F.lit("no"))
            .when(first.isin(*fixed.YES_WORDS), F.lit("yes"))
            .when(first.isin(*fixed.NO_WORDS), F.lit("no"))
            .when(F.exists(refusals, lambda w: F.startswith(bare, w)), F.lit("no"))
        )

    def split(bare: Column) -> Column:
        first = F.regexp_replace(F.substring_index(bare, " ", 1), r"^\.+|\.+$", "")
        return let(F.struct(bare.alias("bare"), first.alias("first")), read)

    return let(F.regexp_replace(normalized, r"^[ .]+|[ .]+$", ""), split)


def parse_yes_no(text: Column) -> Column:
    """``yes``, ``no`` or null, after ``normalize_text``."""
    return _yes_no(normalize_text(text))


def quote_pattern(text: Column) -> Column:
    """A text with every pattern character escaped."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def _word_bounded(needle: Column, hay: Column) -> Column:
    return (needle != "") & F.regexp(
        hay, F.concat(F.lit(r"\b"), quote_pattern(needle), F.lit(r"\b"))
    )


def grade(
    output: Column, gold: Column, answer_type: Column, aliases: Column | None = None
) -> Column:
    """``struct(correct, parsed, reason)`` of one reply; an unreadable reply is wrong.

    A gold value that is not of its own type, or an unknown answer type, stops the job: the data
    set is wrong then, not the answer.
    """
    answer = extract_answer(output)
    accepted = F.array(normalize_text(gold))
    if aliases is not None:
        accepted = F.concat(
            accepted,
            F.transform(
                F.coalesce(aliases, F.array().cast("array<string>")), lambda a: normalize_text(a)
            ),
        )
    parts = lambda a: F.struct(
        a.alias("answer"),
        normalize_text(a).alias("folded"),
        parse_number(gold).alias("expected"),
        parse_yes_no(gold).alias("wanted"),
        accepted.alias("accepted"),
        gold.alias("gold"),
        answer_type.alias("type"),
    )
    return let(let(answer, parts), _judge)


def _result(correct: Column, parsed: Column, reason: str) -> Column:
    return F.struct(
        F.coalesce(correct, F.lit(False)).cast("int").alias("correct"),
        parsed.cast("string").alias("parsed"),
        F.lit(reason).alias("reason"),
    )


def _judge(p: Column) -> Column:
    """Grade one reply from its parts."""
    none, folded = F.lit(None).cast("string"), p["folded"]
    tolerance = F.lit(str(fixed.NUMBER_TOLERANCE)).cast("decimal(3,2)")

    def stop(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), F.coalesce(p["gold"], F.lit("null"))))

    number = let(
        parse_number(p["answer"]),
        lambda v: F.when(v.isNull(), _result(F.lit(False), none, "no number"))
        .when(p["expected"].isNull(), stop("gold is not a number: "))
        .otherwise(_result(F.abs(v - p["expected"]) <= tolerance, v, "number within tolerance")),
    )
    yes_no = let(
        _yes_no(folded),
        lambda said: F.when(said.isNull(), _result(F.lit(False), none, "neither yes nor no"))
        .when(p["wanted"].isNull(), stop("gold is not a yes/no answer: "))
        .otherwise(_result(said == p["wanted"], said, "yes/no compared")),
    )
    hit = F.array_contains(p["accepted"], folded) | (
        (F.length(folded) <= 60) & F.exists(p["accepted"], lambda a: _word_bounded(a, folded))
    )
    text = F.when(
        folded == "", _result(F.lit(False), none, "empty after normalization")
    ).otherwise(_result(hit, folded, "text compared with gold and aliases"))
    return (
        F.when(p["answer"].isNull(), _result(F.lit(False), none, "no answer could be parsed"))
        .when(p["type"].isin("number", "money"), number)
        .when(p["type"] == "yes_no", yes_no)
        .when(p["type"].isin("enum", "string"), text)
        .otherwise(F.raise_error(F.concat(F.lit("unknown answer type "), p["type"])))
    )


def answer_key(output: Column) -> Column:
    """What two replies are compared by: ``struct(answer, bare number, yes/no, text)``.

    Computed once per reply so that comparing k samples costs k parses and not k squared. A plain whole
    number is its own answer and text.
    """
    number = whole_number(output)
    stated = F.struct(
        number.cast("string").alias("answer"), number.cast("decimal(28,8)").alias("number"),
        F.lit(None).cast("string").alias("yes_no"), number.cast("string").alias("text"),
    )
    return F.when(number.isNotNull(), stated).otherwise(_read_key(output))


def _read_key(output: Column) -> Column:
    """``answer_key`` of any reply, by the whole grammar."""
    answer = extract_answer(output)

    def read(p: Column) -> Column:
        bare_number = F.when(
            p["answer"].rlike(r"(?U)^\s*-?\$?\s*\d[\d,]*\.?\d*\s*%?\s*$"), parse_number(p["answer"])
        )
        return F.struct(
            p["answer"].alias("answer"),
            bare_number.alias("number"),
            _yes_no(p["folded"]).alias("yes_no"),
            p["folded"].alias("text"),
        )

    return let(
        answer,
        lambda a: let(F.struct(a.alias("answer"), normalize_text(a).alias("folded")), read),
    )


def whole_number(output: Column) -> Column:
    """The answer of a one-line reply that states a plain whole number, else null.

    Such answers are equal when their numbers are: two of them are never within the tolerance, and
    neither reads as a word. One pattern tells them, so most replies need no full reading.
    """
    return F.regexp_extract(output, r"^(?:Final answer: )?(0|[1-9][0-9]{0,14})$", 1).try_cast("bigint")


def same_answer(left: Column, right: Column) -> Column:
    """Whether two ``answer_key`` structs give the same answer; unreadable equals nothing."""
    numbers = left["number"].isNotNull() & right["number"].isNotNull()
    words = left["yes_no"].isNotNull() & right["yes_no"].isNotNull()
    tolerance = F.lit(str(fixed.NUMBER_TOLERANCE)).cast("decimal(3,2)")
    return F.coalesce(
        F.when(left["answer"].isNull() | right["answer"].isNull(), F.lit(False))
        .when(numbers, F.abs(left["number"] - right["number"]) <= tolerance)
        .when(words, left["yes_no"] == right["yes_no"])
        .otherwise((left["text"] != "") & (left["text"] == right["text"])),
        F.lit(False),
    )


def answers_equivalent(left: Column, right: Column) -> Column:
    """Whether two replies give the same answer. Not transitive: numbers match within a tolerance."""
    return same_answer(answer_key(left), answer_key(right))


def leaks_own_answer(question: Column, gold: Column, answer_type: Column) -> Column:
    """A numeric task whose question already spells its own non-zero gold answer.

    The gold value must not sit inside a longer number.
    """
    pattern = F.concat(F.lit(r"(?<![\d.])"), quote_pattern(gold), F.lit(r"(?!\d)"))
    return F.coalesce(
        answer_type.isin("number", "money")
        & ~gold.isin("0", "0.00")
        & F.regexp(question, pattern),
        F.lit(False),
    )


# ------------------------------------------------------------------------------ verdicts


def _word_bool(word: Column, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    lowered = F.lower(strip(word))
    return F.when(lowered.isin(*yes), F.lit(1)).when(lowered.isin(*no), F.lit(0))


def parse_verdict(reply: Column) -> Column:
    """``struct(correct, confidence, reason, parsed)`` of a judge's reply.

    An unreadable reply is wrong with maximal uncertainty, never skipped.
    """
    unsure = F.lit(fixed.UNPARSEABLE_CONFIDENCE)

    def verdict(correct: Column, sure: Column, reason: Column, parsed: bool) -> Column:
        return F.struct(
            correct.alias("correct"),
            sure.alias("confidence"),
            reason.alias("reason"),
            F.lit(parsed).alias("parsed"),
        )

    def parts(p: Column) -> Column:
        body = p["body"]
        stated = F.when(
            _json_has(body, "correct"),
            _word_bool(F.get_json_object(body, "$.correct"), fixed.VERDICT_TRUE, fixed.VERDICT_FALSE),
        )
        return F.struct(
            stated.alias("stated"),
            F.get_json_object(body, "$.confidence").try_cast("double").alias("sure"),
            strip(F.coalesce(F.get_json_object(body, "$.why"), F.lit(""))).alias("why"),
            _word_bool(p["line"], fixed.VERDICT_TRUE, fixed.VERDICT_FALSE).alias("line"),
        )

    def read(v: Column) -> Column:
        usable = F.when((v["sure"] >= 0) & (v["sure"] <= 1), v["sure"]).otherwise(unsure)
        return (
            F.when(v["stated"].isNotNull(), verdict(v["stated"], usable, v["why"], True))
            .when(v["line"].isNotNull(), verdict(v["line"], unsure, F.lit("a Verdict: line"), True))
            .otherwise(verdict(F.lit(0), unsure, F.lit("unreadable reply"), False))
        )

    seen = F.struct(
        json_text(reply).alias("body"),
        F.regexp_extract(reply, fixed.VERDICT_LINE, 1).alias("line"),
    )
    return let(let(seen, parts), read)


def parse_entailment(reply: Column) -> Column:
    """True, false, or null when the reply cannot be read; never false by default."""
    line = _word_bool(
        F.regexp_extract(reply, fixed.ENTAILS_LINE, 1), fixed.ENTAILS_TRUE, fixed.ENTAILS_FALSE
    )
    stated = let(
        json_text(reply),
        lambda body: F.when(
            _json_has(body, "entails"),
            _word_bool(
                F.get_json_object(body, "$.entails"), fixed.ENTAILS_TRUE, fixed.ENTAILS_FALSE
            ),
        ),
    )
    return F.coalesce(stated, line).cast("boolean")


def binary_entropy(p: Column) -> Column:
    """Entropy of a Bernoulli(p) in bits; 0 at certainty. A value outside [0, 1] stops the job."""
    return (
        F.when((p < 0) | (p > 1), F.raise_error(F.lit("a probability must be in [0, 1]")))
        .when((p == 0) | (p == 1), F.lit(0.0))
        .otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    )


# ------------------------------------------------------------------------- verifier kinds

VERIFIERS: dict[str, Callable[[Column], Column]] = {}


def register_verifier(kind: str, parse: Callable[[Column], Column]) -> None:
    """Add a verifier: how its replies become columns."""
    if kind in VERIFIERS:
        raise ValueError(f"verifier {kind!r} is already registered")
    VERIFIERS[kind] = parse


def verify(kind: str, reply: Column) -> Column:
    """A reply as a registered verifier reads it."""
    if kind not in VERIFIERS:
        raise ValueError(f"unknown verifier {kind!r}; registered: {sorted(VERIFIERS)}")
    return VERIFIERS[kind](reply)


register_verifier("verdict", parse_verdict)
register_verifier("entailment", parse_entailment)
