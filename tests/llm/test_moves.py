"""What the pipeline's near-dedup stage moves: texts stay where they are, however many rows go."""

import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, simhash


@pytest.fixture
def nothing_is_small(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def test_texts_that_stay_meet_no_keys(spark, nothing_is_small):
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(words[k % 90] for k in range(i * 7, i * 7 + 60))) for i in range(20)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in range(5)] + [(3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.one_of_each(docs)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().head().toString()  # all texts were shuffled to meet the keys
    kept = sorted(r.doc_id for r in out.collect())
    assert len(kept) == len(set(kept)) and not {100, 101, 102, 103, 104} & set(kept) and 3 in kept


def test_sets_are_made_of_wanted_texts_without_moving_any(spark, nothing_is_small):
    docs = spark.range(400).select(F.concat(F.lit("r"), "id").alias("row"), F.concat(F.lit("one two three four five six "), "id").alias("text"))
    wanted = common.written(docs.where("row IN ('r3', 'r77', 'r399')").select("row"), "wanted")
    out = simhash.shingle_sets(docs, wanted)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.row for r in out.select("row").collect()}
    assert {"r3", "r77", "r399"} <= got and len(got) < 40
