"""What Python workers hold, as an executor has several and keeps them from stage to stage."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, packing, simhash
from sievewright.llm.queries import tokenizer_path


def test_shingles_of_some_nodes_are_met_by_one_worker_a_task(spark):
    held = common.written(spark.createDataFrame([(f"n{i}", [i, i + 1, 1000 + i]) for i in range(300)], "node string, shingles array<long>"), "held")
    twice = common.written(held.select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 1"), "twice")
    among = common.written(held.where("node IN ('n3', 'n77')").select(F.xxhash64("node").alias("id")), "among")
    got = simhash._met(held, twice, among)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    want = {(r.id, r.h) for r in simhash._met(held, twice).join(twice, "h").join(among, "id").collect()}
    assert len(want) == 4 and want == {(r.id, r.h) for r in got.join(twice, "h").join(among, "id").collect()}
    assert got.count() < 100  # others are out before they move


def test_words_go_when_their_task_ends(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two word"), "id").alias("text"))
    assert packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")).count() == 400

    def held(it):
        from sievewright.llm import packing

        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._KNOWN)])], names=["n"])

    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}


@pytest.mark.parametrize("taken", [1, 3])
def test_trimmed_gives_what_the_function_gives_and_ends_it(taken):
    ended = []

    def run(it):
        try:
            yield from it
        finally:
            ended.append(True)

    it = common.trimmed(run)(iter(range(3)))
    assert [next(it) for _ in range(taken)] == list(range(taken))
    it.close()
    assert ended == [True]
