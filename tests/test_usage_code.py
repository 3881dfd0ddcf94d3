"""The generated code of usage normalization is small enough for the JVM to compile."""

from __future__ import annotations

import re

from costproof.functions import usage

# HotSpot leaves longer methods to its interpreter.
COMPILED = 8000


def test_usage_code_is_compiled_by_the_jvm(spark, capsys):
    raw = spark.range(5).selectExpr("if(id < 3, 'openai', concat('deepseek', id)) AS mapping", "'{\"prompt_tokens\": ' || id || '}' AS raw")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        usage.normalize_usage(raw).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < COMPILED
