"""Streaming twins: ingest, per-key changes, billing, ledger, weights and funnel as Structured Streaming.

Sources are file streams of Parquet; every function takes the stream or its path and returns a streaming DataFrame or a
started query. Stores are keyed stores of Parquet files (no table format is assumed): a micro-batch replaces the buckets it
touches as a version named by its batch id, so a repeated batch overwrites its own version only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from ..operators import changes, feedback, gates, ledger, vocab
from ..sources.extract import merge_snapshot
from ..sources.store import KeyedStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they come; a micro-batch takes all that are there, or files_per_batch of them."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_ingest(stream: DataFrame, store: str, checkpoint: str, key: str, hash_column: str, values: list[str], preferences: list[str], arrival: str, observed_at: datetime | str, prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64):
    """Each micro-batch: prepared (normalised) and canonical rows, merged into the buckets of the keyed store that they
    touch, counts as an event. A micro-batch costs what it touches, not what is stored."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = prepare(rows) if prepare else rows
        one = changes.canonical_collapse(rows.where(F.trim(F.col(key).cast("string")) != ""), key, [F.col(p) for p in preferences], [F.col(arrival)])

        def merge(before: DataFrame | None, new: DataFrame) -> DataFrame:
            if before is None:
                before = new.select(key, hash_column, *values).limit(0).withColumn("first_seen_at", F.lit(None).cast("timestamp")).withColumn("last_seen_at", F.lit(None).cast("timestamp"))
            return merge_snapshot(before, new, key, hash_column, observed_at, values)

        actions = KeyedStore(spark, store, key, buckets).apply(one.select(key, hash_column, *values), batch_id, merge, hash_column)
        counts = spark.createDataFrame([(batch_id, a, n) for a, n in actions.items()], "batch long, merge_action string, n long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{store}/events/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Changes(StatefulProcessor):
    """Per key the last content hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("h", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        frame = frame.sort_values([c for c in ("ts", "event_id") if c in frame.columns], kind="stable")
        known = self.last.get()[0] if self.last.exists() else None
        out = []
        for h, ts in zip(frame["h"], frame["ts"], strict=True):
            if h != known:
                out.append((key[0], "added" if known is None else "changed", h, ts))
                known = h
        self.last.update((known,))
        yield pd.DataFrame(out, columns=["key", "status", "h", "ts"])

    def close(self) -> None:
        pass


def stream_changes(stream: DataFrame) -> DataFrame:
    """added or changed per arriving (key, h, ts); a hash seen last gives nothing. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(_Changes(), "key string, status string, h string, ts timestamp", "Append", "None")


def stream_billing(stream: DataFrame, delay: str | None = "7 days") -> DataFrame:
    """Each provider event once. With a delay, state is bounded and an id that returns later acts again; without, it is
    exact and its state grows with the number of ids."""
    if delay is None:
        return stream.dropDuplicates(["provider_event"])
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["provider_event"])


def stream_billing_state(stream: DataFrame, store: str, checkpoint: str, order: list[str], delay: str | None = "7 days", buckets: int = 64):
    """Each provider event once, folded into the subscribers' states: every micro-batch replaces the buckets of its
    subscribers in the keyed store (customer_id, state, updated_at, and at: what orders the last write)."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        new = ledger.billing_state(rows, order).join(rows.groupBy("customer_id").agg(F.max(F.struct(*order)).alias("at")), "customer_id")

        def merge(before: DataFrame | None, new: DataFrame) -> DataFrame:
            both = new if before is None else before.unionByName(new)
            return both.groupBy("customer_id").agg(F.max_by("state", "at").alias("state"), F.max("updated_at").alias("updated_at"), F.max("at").alias("at"))

        KeyedStore(rows.sparkSession, store, "customer_id", buckets).apply(new, batch_id, merge)

    return stream_billing(stream, delay).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ledger(stream: DataFrame) -> DataFrame:
    """The contact ledger continuously, in update or complete mode."""
    return ledger.contact_ledger(stream)


class _Weights(StatefulProcessor):
    """Per subscriber the five weights; verdicts of a micro-batch are applied in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weights = handle.getValueState("weights", StructType([StructField(n, DoubleType()) for n in feedback.NAMES]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w = list(self.weights.get()) if self.weights.exists() else [1.0] * len(feedback.NAMES)
        frame, out = pd.concat(list(rows)).sort_values(["ts", "event_id"]), []
        for event, verdict in zip(frame["event_id"], frame["verdict"], strict=True):
            w = feedback.moved(w, verdict)
            out.append((key[0], event, *w))
        self.weights.update(tuple(w))
        yield pd.DataFrame(out, columns=["customer_id", "event_id", *feedback.NAMES])

    def close(self) -> None:
        pass


def stream_weights(stream: DataFrame) -> DataFrame:
    """Weights after each verdict (customer_id, event_id, ts, verdict). Needs the RocksDB state store."""
    schema = "customer_id long, event_id long, " + ", ".join(f"{n} double" for n in feedback.NAMES)
    return stream.groupBy("customer_id").transformWithStateInPandas(_Weights(), schema, "Append", "None")


#: Groups over which profiles and sites are dealt by hash: a group of their own for each would cost a call each.
SHARES = 1024
#: Stands for no bucket (no date): next to no other.
NO_BUCKET = -(2**63)
#: What the state keeps of an accepted filing: profile and site as 24 bytes, and the bucket.
_TAKEN = np.dtype([("key", "V24"), ("bucket", "<i8")])
#: Filings in one entry of the state.
_ENTRY = 32_768


def _share() -> Column:
    return F.pmod(F.xxhash64("profile_id", "site"), F.lit(SHARES))


def _site_keys(frame: pd.DataFrame) -> list[bytes]:
    """Profile and site (16 bytes) of each row as one value."""
    keys = np.empty(len(frame), dtype=[("profile", "<i8"), ("site", "V16")])
    keys["profile"] = frame["profile_id"].to_numpy()
    keys["site"] = np.frombuffer(b"".join(frame["site"]), "V16")
    return keys.view("V24").tolist()


def _entries(keys: list[bytes], buckets: list[int]) -> list[tuple]:
    rows = np.empty(len(keys), dtype=_TAKEN)
    rows["key"], rows["bucket"] = np.frombuffer(b"".join(keys), "V24"), buckets
    return [(rows[i : i + _ENTRY].tobytes(),) for i in range(0, len(rows), _ENTRY)]


class _Accepted(StatefulProcessor):
    """Per profile and site the buckets of days in which a filing was accepted; rows of a micro-batch in order of arrival.
    A group holds the profiles and sites of a share; what a micro-batch accepts is appended at once, packed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", StructType([StructField("rows", BinaryType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        if len(initialState):
            self.taken.appendList(_entries(_site_keys(initialState), initialState["bucket"].tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        keys, rejected, new = _site_keys(frame), [], ([], [])
        taken: dict[bytes, set] = {k: set() for k in keys}
        for (packed,) in self.taken.get():
            before = np.frombuffer(bytes(packed), _TAKEN)
            for k, b in zip(before["key"].tolist(), before["bucket"].tolist(), strict=True):
                if k in taken:
                    taken[k].add(b)
        for k, b in zip(keys, frame["bucket"].tolist(), strict=True):
            own = taken[k]
            near = b in own or b - 1 in own or b + 1 in own
            if not near:
                own.add(b)
                new[0].append(k)
                new[1].append(b)
            rejected.append("dedupe" if near else None)
        if new[0]:
            self.taken.appendList(_entries(*new))
        yield frame[["profile_id", "site", "permit_number", "bucket"]].assign(rejected_by=rejected)

    def close(self) -> None:
        pass


def stream_to_be_met(stream: DataFrame, now: datetime | str) -> DataFrame:
    """What the funnel needs of each arriving record, judged by itself: a stream of its own before stream_funnel(), so that
    each record is judged once."""
    return gates.to_be_met(stream, now)


def stream_funnel(stream: DataFrame, profiles: DataFrame, now: datetime | str, window_days: int = vocab.NEAR_DUPLICATE_DAYS, accepted: DataFrame | None = None) -> DataFrame:
    """profile_id, permit_number and rejected_by for each arriving record in the territory of each profile: five gates at
    once, then, with state by profile and site, the dedupe gate; site (32 hex digits) and bucket of those that reach it.
    stream: records, or what stream_to_be_met() has made of them.

    accepted (profile_id, site, bucket) is what earlier passes accepted, in batches or streams: the state begins with it.
    What this stream accepts is in its output: accepted_in(). Give it the profiles of gates.alike() that stand for others,
    and its output to gates.for_members(), and state and output have a row for all that are alike. Needs the RocksDB state
    store.
    """
    c = F.col
    rejected, good = gates.five_gate_pairs(stream if "failed" in stream.columns else gates.to_be_met(stream, now), profiles)
    bucket = lambda x: F.coalesce(x.cast("long"), F.lit(NO_BUCKET)).alias("bucket")
    good = good.select(c("profile_id").cast("long").alias("profile_id"), "site", "permit_number", "arrival", bucket(changes.day_bucket(c("filed_date"), window_days)))
    start = None if accepted is None else accepted.select(c("profile_id").cast("long").alias("profile_id"), F.unhex(F.substring("site", 1, 32)).alias("site"), bucket(c("bucket"))).withColumn("share", _share()).groupBy("share")
    judged = good.withColumn("share", _share()).groupBy("share").transformWithStateInPandas(_Accepted(), "profile_id long, site binary, permit_number string, bucket long, rejected_by string", "Append", "None", initialState=start)
    judged = judged.select("profile_id", F.lower(F.hex("site")).alias("site"), "permit_number", F.nullif("bucket", F.lit(NO_BUCKET)).alias("bucket"), "rejected_by")
    none = rejected.select("profile_id", F.lit(None).cast("string").alias("site"), "permit_number", F.lit(None).cast("long").alias("bucket"), "rejected_by")
    return none.unionByName(judged)


def accepted_in(judged: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(profile_id, site, bucket) of all that a funnel stream has accepted, and the history before it."""
    new = judged.where("rejected_by IS NULL").select("profile_id", "site", "bucket")
    return (new if accepted is None else new.unionByName(accepted.select("profile_id", "site", "bucket"))).distinct()


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns all it wrote as a table (update mode: the last row of each batch)."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")
