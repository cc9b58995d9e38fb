"""The report's rounding scale, by a comparison where a number has few digits before the point."""

import math

from pairsignals.functions.columns import round6, round6_scale


def test_scale_needs_no_logarithm_for_most_numbers_and_rounds_the_same(spark):
    near = []
    for k in range(-8, 13):
        x = 10.0 ** k
        for _ in range(4):
            near += [x, -x]
            x = math.nextafter(x, 0.0)
        near += [math.nextafter(10.0 ** k, math.inf), 1.2345678912345 * 10.0 ** k, -9.999999999951 * 10.0 ** k]
    near += [0.0, -0.0, math.nan, math.inf, -math.inf, None, 9999.9999999, 0.0000005, 1234.5678905]
    df = spark.createDataFrame([(x,) for x in near], "x double")
    whole = ("pow(10.0D, least(6.0D, 9.0D - CAST(floor(log10(abs(x))) AS DOUBLE)))")
    rows = df.withColumn("s", round6_scale("x")).selectExpr("x", "s", f"{whole} AS s0").select(
        "x", "s", "s0", round6("x", "s").alias("new"), round6("x", "s0").alias("old")).collect()
    assert len(rows) == len(near)
    for r in rows:
        assert r.new == r.old or (math.isnan(r.new) and math.isnan(r.old)), r
    plan = df.select(round6_scale("x").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (abs(x" in plan and "< 10000.0) THEN 1000000.0 ELSE pow" in plan
