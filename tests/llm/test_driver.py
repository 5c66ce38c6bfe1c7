"""What the driver holds while the pipeline's near-dedup stage runs: plans, their texts, bitmaps."""

from pyspark.sql import functions as F

from sievewright.llm import common, simhash


def _near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):
        own = words[i * 20 : i * 20 + 70]
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join([*own, "more"])), (10 * i + 2, " ".join(own).upper())]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_no_plan_of_near_dedup_is_large_and_no_bitmap_is_made_twice(spark, monkeypatch):
    joins, keys = {}, []

    def written(df, name, write=common.written):
        joins[name] = max(joins.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    def bitmap(df, *each, make=simhash.bitmap):
        keys.append((sorted(r[0] for r in df.collect()), each))
        return make(df, *each)

    monkeypatch.setattr(common, "written", written)
    monkeypatch.setattr(simhash, "bitmap", bitmap)
    kept = sorted(r.doc_id for r in simhash.one_of_each(_near_copies(spark)).collect())
    assert kept == [10 * i for i in range(12)]
    made = [k for k in keys if k[0]]
    assert not [k for k in made if made.count(k) > 1]
    assert "sharing" in joins and max(joins.values()) <= 6, joins


def test_texts_of_plans_are_short(spark):
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.maxPlanStringLength"
    old = {n: spark.conf.get(n) for n in names}
    try:
        common.bounded_batches(spark)
        df = spark.range(10)
        for i in range(30):
            df = df.join(spark.range(10).select("id", F.lit("x" * 50).alias(f"c{i}")), "id")
        assert len(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) <= 6000  # 64 K before
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
