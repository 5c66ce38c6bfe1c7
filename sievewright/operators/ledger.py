"""Contact ledger, outbound queue and billing as folds over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The payment provider's eight statuses, as four.
BILLING = {
    "active": "active", "trialing": "active", "past_due": "past_due", "unpaid": "past_due", "canceled": "canceled", "incomplete": "pending", "incomplete_expired": "canceled", "paused": "past_due",
}


def contact_ledger(messages: DataFrame) -> DataFrame:
    """Per handle: first and last seen, messages, opt-out (which sticks) and its first time. Rows of kind opt_out came
    without a message and count none."""
    inbound = F.col("kind") != "opt_out"
    out = F.col("opt_out")
    return messages.groupBy("handle").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(inbound).alias("message_count"), F.bool_or(out).alias("opted_out"), F.min(F.when(out, F.col("ts"))).alias("opted_out_at")
    )


def reachable(ledger: DataFrame) -> DataFrame:
    """Handles that wrote and never opted out."""
    return ledger.where("message_count > 0 AND NOT opted_out")


def admit_queue(events: DataFrame, order: list[str]) -> DataFrame:
    """Marks queue events admitted, duplicate or release: one may be pending per handle and purpose until it is released.

    events hold handle, purpose and action (enqueue, or a release: sent, abandoned).
    """
    release = F.col("action").isin("sent", "abandoned")
    by = Window.partitionBy("handle", "purpose").orderBy(*order)
    epoch = F.coalesce(F.sum(release.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = events.withColumn("_epoch", epoch)
    first = F.row_number().over(Window.partitionBy("handle", "purpose", "_epoch", "_enqueue").orderBy(*order))
    marked = marked.withColumn("_enqueue", ~release).withColumn("_n", first)
    return marked.withColumn("admission", F.when(release, "release").when(F.col("_n") == 1, "admitted").otherwise("duplicate")).drop("_epoch", "_enqueue", "_n")


def pending_rows(admitted: DataFrame, order: list[str]) -> DataFrame:
    """Admitted rows that no later release of their handle and purpose has taken off."""
    last = F.max(F.when(F.col("admission") == "release", F.struct(*order))).over(Window.partitionBy("handle", "purpose"))
    return admitted.withColumn("_last", last).where((F.col("admission") == "admitted") & (F.col("_last").isNull() | (F.struct(*order) > F.col("_last")))).drop("_last")


def pending_for(pending: DataFrame, handle, order: list[str]) -> DataFrame:
    return pending.where(F.col("handle") == handle).orderBy(*order)


def count_pending(pending: DataFrame) -> DataFrame:
    return pending.groupBy("purpose").agg(F.count(F.lit(1)).alias("n_pending"))


def releasable(pending: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pending rows of reachable handles that have written since the row was queued."""
    return pending.join(reachable(ledger).select("handle", "last_seen"), "handle").where(F.col("last_seen") > F.col("ts")).drop("last_seen")


def billing_events_once(events: DataFrame, event_id: str, order: list[str]) -> DataFrame:
    """Each event id acts once: its first arrival."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(event_id).orderBy(*order))).where("_n = 1").drop("_n")


def billing_state(events: DataFrame, order: list[str]) -> DataFrame:
    """Per customer the state after the last write; unknown provider statuses are pending."""
    states = F.create_map(*(F.lit(x) for kv in BILLING.items() for x in kv))
    rows = events.withColumn("_state", F.coalesce(F.element_at(states, F.col("provider_status")), F.lit("pending")))
    return rows.groupBy("customer_id").agg(F.max_by("_state", F.struct(*order)).alias("state"), F.max("ts").alias("updated_at"))


def active_customers(state: DataFrame) -> DataFrame:
    """The state alone decides; no clock is read."""
    return state.where("state = 'active'").select("customer_id")


def primary_customer(customers: DataFrame) -> DataFrame:
    """The oldest active customer, or else the oldest."""
    return customers.orderBy(F.desc(F.col("state") == "active"), "created_at", "customer_id").limit(1)
