"""Streaming queries: each runs its stream over files derived from the tables and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import gates as G
from ..operators import normalize as N
from ..sources.shared import stored
from ..sources.store import KeyedStore
from ..streaming import streams as T
from .bindings import NOW, frame, shared_folder, with_roles
from .q_events import _BILL, _FOLD, _LED
from .q_gates import _FOLD as _SHEET
from .q_gates import dealt
from .q_normalize import _NUM, RAW
from .registry import query

#: What orders a subscriber's billing events.
ORDER = ["arrival"]


def _in_drops(df: DataFrame, folder: str, order: str, run: Callable[[DataFrame], object], parts: int = 3) -> object:
    """Writes df in as many drops, by ranges of a column, and runs the stream after each: batches come in order, state is
    carried from one to the next, and every drop has as many files as Spark likes. Returns what the last run returns."""
    spark, out = df.sparkSession, None
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = df.agg(F.percentile_approx(order, shares, 1000).alias("cuts")).first()["cuts"] or []
    place = sum((F.coalesce(F.col(order) > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for i in range(parts):
        df.where(place == i).write.mode("append").parquet(f"{folder}/in")
        out = run(T.file_stream(spark, f"{folder}/in", df.schema))
    return out


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKS)


@query("t1_stream_ingest", RAW + f"""SELECT TRIM(permit_number) AS permit_number, CASE WHEN CAST(SUBSTR(record_id, 2) AS BIGINT) % 5 = 0 THEN 'complete' ELSE LOWER(TRIM(status)) END AS status,
    GREATEST(CASE WHEN {_NUM('revised_cost')} > 0 THEN {_NUM('revised_cost')} END, CASE WHEN {_NUM('estimated_cost')} > 0 THEN {_NUM('estimated_cost')} END) AS valuation FROM raw WHERE TRIM(permit_number) <> ''""")
def _(spark, d):
    folder = shared_folder(spark, "stream")
    raw = frame(spark, d, "raw")
    late = F.when(F.substring("record_id", 2, 20).cast("long") % 5 == 0, " Complete ").otherwise(F.col("status"))
    for rows in (raw, raw.withColumn("status", late)):  # the second pass takes up the first one's store
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = T.file_stream(spark, f"{folder}/in", raw.schema)
        T.stream_ingest(stream, f"{folder}/store", f"{folder}/checkpoint", "permit_number", "content_hash", ["status", "valuation"], ["status"], "record_id", NOW, lambda x: N.normalize_records(x)[0]).awaitTermination()
    return KeyedStore(spark, f"{folder}/store", "permit_number").read().select("permit_number", "status", "valuation")


@query("t2_stream_changes", with_roles("queue") + "SELECT handle AS key, CASE WHEN b IS NULL THEN 'added' ELSE 'changed' END AS status, action AS h, COUNT(*) AS n FROM (SELECT *, LAG(action) OVER (PARTITION BY handle ORDER BY ts, event_id) AS b FROM queue) WHERE b IS NULL OR b <> action GROUP BY 1, 2, 3")
def _(spark, d):
    _rocks(spark)
    folder = shared_folder(spark, "stream")
    rows = frame(spark, d, "queue").selectExpr("handle AS key", "action AS h", "ts", "event_id")
    out = _in_drops(rows, folder, "ts", lambda x: T.collected(T.stream_changes(x), folder))
    return out.groupBy("key", "status", "h").agg(F.count(F.lit(1)).alias("n"))


@query("t3_stream_billing", _BILL + "SELECT customer_id, state, CAST(updated_at AS STRING) AS updated_at FROM states")
def _(spark, d):
    folder = shared_folder(spark, "stream")
    _in_drops(frame(spark, d, "billing"), folder, "arrival", lambda x: T.stream_billing_state(x, f"{folder}/store", f"{folder}/checkpoint", ORDER, None).awaitTermination())
    return KeyedStore(spark, f"{folder}/store", "customer_id").read().select("customer_id", "state", F.col("updated_at").cast("string").alias("updated_at"))


@query("t4_stream_ledger", _LED + "SELECT handle, message_count, opted_out FROM ledger")
def _(spark, d):
    folder = shared_folder(spark, "stream")
    out = _in_drops(frame(spark, d, "messages"), folder, "ts", lambda x: T.collected(T.stream_ledger(x), folder, "update"))
    last = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("batch")))
    return out.withColumn("_n", last).where("_n = 1").select("handle", "message_count", "opted_out")


@query("t5_stream_weights", _FOLD + "SELECT customer_id, event_id, fit, demand, timing, value, evidence FROM fold WHERE n > 0")
def _(spark, d):
    _rocks(spark)
    folder = shared_folder(spark, "stream")
    rows = frame(spark, d, "verdicts").select("customer_id", "event_id", "ts", "verdict")
    return _in_drops(rows, folder, "ts", lambda x: T.collected(T.stream_weights(x), folder))


def _funnel(spark, folder: str, one: DataFrame, history: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Runs the two streams of the funnel after each other: records are judged, then meet the profiles that stand for others."""

    def run(stream: DataFrame) -> DataFrame:
        met = T.collected(T.stream_to_be_met(stream, NOW), f"{folder}/judged")
        again = T.file_stream(spark, f"{folder}/judged/out", met.schema)
        return T.collected(T.stream_funnel(again, one, NOW, accepted=history).select("profile_id", "permit_number", "rejected_by"), folder)

    return run


def _one(spark, d) -> tuple[DataFrame, DataFrame]:
    """Profiles that stand for all that are alike, written once as every batch reads them; and their members."""
    one, members = G.alike(frame(spark, d, "profiles"))
    return stored(one, "profiles"), members


@query("t6_stream_funnel", _SHEET + "SELECT profile_id, permit_number, rejected_by FROM sheet")
def _(spark, d):
    _rocks(spark)
    folder = shared_folder(spark, "stream")
    one, members = _one(spark, d)
    records = frame(spark, d, "valued").select(*G.READ)
    return G.for_members(_in_drops(records, folder, "arrival", _funnel(spark, folder, one)), members)


@query("t6_funnel_after_batch", _SHEET + "SELECT profile_id, permit_number, rejected_by FROM sheet")
def _(spark, d):
    _rocks(spark)
    folder = shared_folder(spark, "stream")
    records, profiles = frame(spark, d, "valued").select(*G.READ), frame(spark, d, "profiles")
    one, members = _one(spark, d)
    middle = records.agg(F.percentile_approx("arrival", 0.5, 1000).alias("m")).first()["m"] or 0
    first, history = G.sheet_and_history(dealt(spark, d).where(F.col("arrival") <= middle), profiles, NOW, deal=False)
    records.where(F.col("arrival") > middle).write.parquet(f"{folder}/in")
    then = _funnel(spark, folder, one, stored(history, "accepted"))(T.file_stream(spark, f"{folder}/in", records.schema))
    return first.select("profile_id", "permit_number", "rejected_by").unionByName(G.for_members(then, members).select("profile_id", "permit_number", "rejected_by"))
