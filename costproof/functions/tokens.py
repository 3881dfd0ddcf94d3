"""Token counting as Spark columns.

The counter is the documented approximation: text is cut into pieces by one pattern and each piece
costs a number of tokens that depends on its kind. It is always an estimate; per-model ratios fitted
on recorded usage (``operators.ratios``) carry it into a model's own units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costproof import fixed


# The same pieces without the one space before them, words first. White space is a piece where there is more of
# it than one space before a piece; a contraction after such a space is punctuation and a word.
_BARE = (
    r"{word}+|\d{{1,3}}|'(?<!(?<!\s)[ ]')(?:[sdmt]|ll|ve|re)|[^\s\w]+|\s{{2,}}|[^\S ]|[ ]\z"
)
_BARE_ASCII = _BARE.format(word="[a-zA-Z_]")
_BARE_UNICODE = "(?U)" + _BARE.format(word=r"[a-zA-Z_[^\s\d\W]]")


def token_pieces(text: Column) -> Column:
    """The pieces the counter charges for, in order, less the space before them; on ASCII text both patterns cut alike."""
    plain = F.regexp_extract_all(text, F.lit(_BARE_ASCII), F.lit(0))
    return F.when(text.rlike(r"^\p{ASCII}*$"), plain).otherwise(
        F.regexp_extract_all(text, F.lit(_BARE_UNICODE), F.lit(0))
    )


def _piece_tokens(piece: Column) -> Column:
    """Tokens of one piece. ASCII letters and digits are told by where the piece sorts, cased letters by their cases;
    only what is left (white space, punctuation, caseless letters) is matched."""
    first, size = F.substring(piece, 1, 1), F.length(piece)
    starts = lambda low, past: (piece >= low) & (piece < past)
    # No length is half-way between two counts of 4.2, so rounding needs no exact decimals.
    word = F.greatest(F.lit(1.0), F.floor(size / F.lit(fixed.ALPHA_CHARS_PER_TOKEN) + 0.5).cast("double"))
    gap = F.greatest(F.lit(1.0), F.bround(size / F.lit(fixed.SPACES_PER_TOKEN)))
    return (
        F.when(starts("a", "{") | starts("A", "["), word)
        .when(starts("0", ":"), F.lit(1.0))
        .when(starts("!", "'") | starts("(", "0") | starts(":", "A"), size.cast("double"))
        .when(starts("\t", "\x0e") | starts(" ", "!"), gap)
        .when(F.upper(first) != F.lower(first), word)
        .when(first.rlike(r"(?U)^\s"), gap)
        .when(first.rlike(r"(?U)^\d"), F.lit(1.0))
        .when(first.rlike(r"^[\p{L}']"), word)
        .otherwise(size.cast("double"))
    )


def approx_tokens(text: Column) -> Column:
    """Approximate token count of a text; 0 for an empty or null text."""
    total = F.aggregate(
        token_pieces(text), F.lit(0.0), lambda acc, piece: acc + _piece_tokens(piece)
    )
    return F.coalesce(total, F.lit(0.0)).cast("bigint")


def joined_tokens(texts: Column, tokens: Column, whole: Column) -> Column:
    """Token count of ``whole``, the texts joined by blank lines, from the counts of the texts.

    Between texts that neither begin nor end in white space, a blank line is one piece and no other piece changes;
    only beside other texts is the whole counted again.
    """
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    apart = F.forall(texts, lambda t: F.coalesce(ends(t).rlike(r"(?U)^\S\S\z"), F.lit(False)))
    total = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return (
        F.when(F.size(texts) <= 0, F.lit(0).cast("bigint"))
        .when(apart, total + F.size(texts) - 1)
        .otherwise(approx_tokens(whole))
    )


def model_tokens(base_tokens: Column, ratio: Column) -> Column:
    """Base tokens in a model's own units, rounded half to even."""
    return F.bround(base_tokens * F.coalesce(ratio, F.lit(1.0))).cast("bigint")
