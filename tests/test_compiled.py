"""Generated code that the JVM compiles: it leaves methods of over 8,000 bytes to its interpreter."""

import re

import __spark_entry__ as e
import compare

SMALL = "/root/testdata/sf0.01"


def test_no_stage_of_the_scores_is_too_long_to_compile(spark):
    df = e.queries()["c16_run_calculation"](spark, SMALL)
    assert not compare.differences(df, compare.connection(SMALL), e.oracle_sql()["c16_run_calculation"])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = e.queries()["c16_run_calculation"](spark, SMALL)._jdf.queryExecution()
        text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(plan.executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000
