from __future__ import annotations

from pyspark.sql import functions as F

from costproof.functions import sql, stats, tokens
from costproof.operators import projections as P


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    spark.createDataFrame([("it's 12345 days\n\n later, élève — ok",)], "t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT t, cp_tokens(t) AS n, cp_wilson_low(8, 10) AS low, cp_entropy(0.5D) AS h FROM texts")
    row = got.select("*", tokens.approx_tokens(F.col("t")).alias("m"), stats.wilson(F.lit(8), F.lit(10))["low"].alias("w")).first()
    assert row.n == row.m and abs(row.low - row.w) < 1e-12 and row.h == 1.0


def test_projections(spark):
    calls = spark.createDataFrame([("a", i, 2.0, 10 if i < 9 else 100) for i in range(10)], "step string, task_id int, cost double, output_tokens long")
    r = P.pilot_projection(calls, spark.createDataFrame([("a", 1000)], "step string, total_tasks long"), ["step"]).first()
    assert r.p95_output == 100 and abs(r.projected_cost - 2000 * 100 / 19) < 1e-9
    plan = spark.createDataFrame([(1000, 80, 100, 10, 50, 5, 25, 6, 1)], "total_tokens long, base_prefix long, base_total long, generation_calls long, max_tokens long, p_input long, p_output long, p_cache_write_5m long, p_cache_read long")
    b = P.plan_band(plan).first()
    assert b.prefix_tokens == 800 and b.floor_cost == 800 * 6 + 800 * 10 + 200 * 5 * 10 and b.ceiling_cost == b.floor_cost + 50 * 25 * 10
