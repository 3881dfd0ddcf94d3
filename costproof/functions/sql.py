"""The scalar functions a SQL user needs, as temporary SQL functions: they inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from costproof import fixed


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def register(spark: SparkSession) -> None:
    """Create ``cp_tokens(text)``, ``cp_entropy(p)``, ``cp_wilson_low(k, n)`` and ``cp_wilson_high(k, n)``."""
    z2, z = f"{fixed.Z_95**2!r}D", f"{fixed.Z_95!r}D"
    p = "(k / CAST(n AS DOUBLE))"
    centre = f"(({p} + {z2} / (2 * n)) / (1 + {z2} / n))"
    half = f"({z} / (1 + {z2} / n) * sqrt({p} * (1 - {p}) / n + {z2} / (4D * n * n)))"
    piece = (
        "CASE WHEN trim(p) RLIKE r'^\\p{Z}*$|^\\s*$' THEN greatest(1, bround(length(p) / 4)) "
        "WHEN ltrim(p) RLIKE r'^\\p{Nd}+$' THEN 1 "
        "WHEN ltrim(p) RLIKE r'^[\\p{L}\\x27]' THEN greatest(1, bround(length(ltrim(p)) / 4.2D)) "
        "ELSE length(ltrim(p)) END"
    )
    bodies = {
        "cp_tokens(t STRING) RETURNS BIGINT": (
            f"CAST(aggregate(regexp_extract_all(t, {_quoted(fixed.PRETOKEN)}, 0), 0D, (a, p) -> a + {piece}) AS BIGINT)"
        ),
        "cp_entropy(p DOUBLE) RETURNS DOUBLE": (
            "CASE WHEN p = 0 OR p = 1 THEN 0D WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) END"
        ),
        "cp_wilson_low(k BIGINT, n BIGINT) RETURNS DOUBLE": f"CASE WHEN n > 0 THEN greatest(0D, {centre} - {half}) END",
        "cp_wilson_high(k BIGINT, n BIGINT) RETURNS DOUBLE": f"CASE WHEN n > 0 THEN least(1D, {centre} + {half}) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
