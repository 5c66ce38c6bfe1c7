"""Duplicates and change detection: canonical rows, duplicate profile, snapshot deltas, staging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import instant, normal

DELTAS = ("added", "changed", "not_observed")


def canonical_collapse(df: DataFrame, key: str | list[str], preferences: list[Column], arrival: list[Column]) -> DataFrame:
    """One row per key: the greatest by preferences, the earliest arrival on a full tie; _collapsed counts the others."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(keys).orderBy(*(p.desc_nulls_last() for p in preferences), *(a.asc() for a in arrival))
    size = Window.partitionBy(keys)
    return df.withColumn("_n", F.row_number().over(order)).withColumn("_collapsed", F.count(F.lit(1)).over(size) - 1).where("_n = 1").drop("_n")


def duplicate_groups(df: DataFrame, key: str | list[str], compared: list[str]) -> DataFrame:
    """Per size of group: how many groups and surplus rows, and in how many of them each compared column differs.

    A column differs if its smallest and largest values do, so one pass with two values a column is enough; nulls don't
    count as a value.
    """
    keys = [key] if isinstance(key, str) else key
    per = df.groupBy(keys).agg(F.count(F.lit(1)).alias("group_size"), *(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"_d_{c}") for c in compared))
    return per.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("group_size") - 1).alias("surplus_rows"), *(F.count_if(F.col(f"_d_{c}")).alias(f"differ_{c}") for c in compared))


def _first_of_key(df: DataFrame, key: str, arrival: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(arrival)
    return df.where(F.trim(F.col(key).cast("string")) != "").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def changed_fields(fields: list[str], old: str = "p", new: str = "c") -> Column:
    """Sorted names of the fields that differ; absent and present differ."""
    return F.sort_array(F.array_compact(F.array(*(F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields))))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, hash_column: str, fields: list[str], arrival: str, observed_at: datetime | str, report_not_observed: bool = True) -> DataFrame:
    """key, status (added, changed, not_observed), changed_fields, content_hash, observed_at; equal hashes give no row.

    The first arrival stands for a repeated key and blank keys are dropped, on either side.
    """
    p, c = _first_of_key(previous, key, arrival).alias("p"), _first_of_key(current, key, arrival).alias("c")
    both = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer")
    old, new = F.col(f"p.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    status = F.when(~old, "added").when(~new, "not_observed").when(~F.col(f"p.{hash_column}").eqNullSafe(F.col(f"c.{hash_column}")), "changed")
    none = F.array().cast("array<string>")
    out = both.select(
        F.coalesce(f"c.{key}", f"p.{key}").alias(key), status.alias("status"), F.when(status == "changed", changed_fields(fields)).otherwise(none).alias("changed_fields"),
        F.coalesce(f"c.{hash_column}", f"p.{hash_column}").alias("content_hash"), instant(observed_at).alias("observed_at"),
    ).where(F.col("status").isNotNull())
    return out if report_not_observed else out.where("status <> 'not_observed'")


def summarize_deltas(deltas: DataFrame) -> DataFrame:
    """Rows per status, zeros included."""
    every = deltas.sparkSession.createDataFrame([(d,) for d in DELTAS], "status string")
    counts = deltas.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def deltas_with_status(deltas: DataFrame, *statuses: str) -> DataFrame:
    return deltas.where(F.col("status").isin(*statuses))


def actionable_keys(deltas: DataFrame, key: str) -> DataFrame:
    """Keys that were added or changed."""
    return deltas_with_status(deltas, "added", "changed").select(key)


def mark_not_observed(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The store with status not_observed for these keys; nothing is deleted."""
    gone = keys.select(F.col(key).alias("_key")).distinct().withColumn("_gone", F.lit(True))
    return store.join(gone, F.col(key) == F.col("_key"), "left").withColumn("snapshot_status", F.when(F.col("_gone"), "not_observed").otherwise(F.col("snapshot_status"))).drop("_key", "_gone")


def ingest_counts(raw: DataFrame, key: str, collapsed: DataFrame, deltas: DataFrame) -> DataFrame:
    """fetched, unnormalisable (no key), collapsed, added, changed, unchanged and written rows of one ingest."""
    a = raw.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").alias("unnormalisable"))
    b = collapsed.agg(F.coalesce(F.sum("_collapsed"), F.lit(0)).cast("long").alias("collapsed"), F.count(F.lit(1)).alias("_kept"))
    c = deltas.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "changed").alias("changed"))
    return a.crossJoin(b).crossJoin(c).select("fetched", "unnormalisable", "collapsed", "added", "changed", (F.col("_kept") - F.col("added") - F.col("changed")).alias("unchanged"), (F.col("added") + F.col("changed")).alias("written"))


#: Columns that site_texts() gives and site_of() reads.
SITE_TEXTS = ("_n_address", "_n_unit", "_n_scope")


def site_texts(address: Column, unit: Column, description: Column, parts: tuple[Column, ...] = ()) -> dict[str, Column]:
    """What a site is told by: address, unit and the letters and digits of the scope, in their normal forms."""
    whole = normal(address)
    pieces = F.concat_ws(" ", *(F.nullif(normal(x), F.lit("")) for x in parts)) if parts else F.lit("")
    return dict(zip(SITE_TEXTS, (F.coalesce(F.nullif(whole, F.lit("")), pieces), normal(unit), F.trim(F.regexp_replace(normal(description), "[^a-z0-9]+", " "))), strict=True))


def site_of(record_key: Column, texts: dict[str, Column] | None = None) -> Column:
    """Hash of a site's texts; a row that lacks the address or the scope is a site of its own."""
    a, u, d = (texts[k] if texts else F.col(k) for k in SITE_TEXTS)
    return F.sha2(F.when((a == "") | (d == ""), F.concat_ws("|", F.lit("record"), F.trim(record_key.cast("string")))).otherwise(F.concat_ws("|", F.lit("site"), a, u, d)), 256)


def site_key(address: Column, unit: Column, description: Column, record_key: Column, parts: tuple[Column, ...] = ()) -> Column:
    """Hash of site and scope; a row that lacks the address or the description is a site of its own.

    A missing address is put together from its parts. Of a description only letters and digits count.
    """
    return site_of(record_key, site_texts(address, unit, description, parts))


def day_bucket(filed: Column, window_days: int) -> Column:
    """The number of the window of days a filing lies in; null without a date."""
    return F.floor(F.unix_micros(filed) / F.lit(86_400_000_000 * window_days)).cast("long")


def folded_sites(rows: DataFrame, by: list[str], accepted: DataFrame | None = None) -> DataFrame:
    """by, n and kept (array of (a, b)): which of the first arrivals a in the buckets b of each site are accepted.

    rows: by, _bucket and a (what orders arrivals). Only the earliest row of a bucket can be accepted, so a site gathers one
    row for each of its buckets; these are folded in order of arrival. accepted (by, bucket) holds what earlier passes
    accepted: such buckets are taken from the start. n counts the accepted of this pass; sites that only history has give
    no row.
    """
    firsts = rows.groupBy(*by, "_bucket").agg(F.min("a").alias("a"), F.lit(False).alias("old"))
    if accepted is not None:
        known = accepted.select(*by, F.col("bucket").cast("long").alias("_bucket"), F.lit(None).cast(rows.schema["a"].dataType).alias("a"), F.lit(True).alias("old"))
        firsts = firsts.unionByName(known.distinct())
    sites = firsts.groupBy(by).agg(F.sort_array(F.collect_list(F.when(~F.col("old"), F.struct("a", F.col("_bucket").alias("b"))))).alias("firsts"), F.collect_list(F.when(F.col("old"), F.struct(F.col("_bucket").alias("b")))).alias("taken"))
    near = lambda x, t: t["b"].eqNullSafe(x["b"]) | F.coalesce(F.abs(t["b"] - x["b"]) <= 1, F.lit(False))
    free = lambda kept, x: ~F.exists(kept, lambda t: near(x, t)) & ~F.exists("taken", lambda t: near(x, t))
    step = lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept)
    start = F.slice("firsts", 1, 0)
    # a site with one bucket and no history needs no fold
    kept = F.when((F.size("firsts") == 1) & (F.size("taken") == 0), F.col("firsts")).otherwise(F.aggregate("firsts", start, step))
    return sites.where(F.size("firsts") > 0).select(*by, kept.alias("kept")).withColumn("n", F.size("kept").cast("long"))


def near_duplicate_collapse(df: DataFrame, partition: list[str], site: str, filed: Column, key: str, arrival: str, window_days: int = 45, accepted: DataFrame | None = None) -> DataFrame:
    """Adds near_duplicate: an earlier accepted row of the same site lies in the same or an adjacent bucket of days.

    First only the earliest row of each bucket is kept, so what a site gathers is bounded by its buckets; these are
    folded in order of arrival. Rows without a date share a bucket that touches no other. Keys must be unique.
    accepted (partition, site, bucket), as accepted_buckets() gives it, is what earlier passes accepted.
    """
    rows = df.select(*partition, site, day_bucket(filed, window_days).alias("_bucket"), F.struct(F.col(arrival).alias("t"), F.col(key).alias("k")).alias("a"))
    found = folded_sites(rows, [*partition, site], accepted)
    taken = found.select(*partition, F.explode("kept.a.k").alias("_accepted")).withColumn("_ok", F.lit(True))
    joined = df.alias("_d").join(taken.alias("_a"), [F.col(f"_d.{p}").eqNullSafe(F.col(f"_a.{p}")) for p in partition] + [F.col(f"_d.{key}") == F.col("_accepted")], "left")
    return joined.select("_d.*", F.col("_ok").isNull().alias("near_duplicate"))


def accepted_buckets(judged: DataFrame, partition: list[str], site: str, filed: Column, window_days: int = 45, accepted: DataFrame | None = None) -> DataFrame:
    """The history for the next pass: (partition, site, bucket) of every accepted row of judged (which has near_duplicate),
    and of the history before it."""
    new = judged.where(~F.col("near_duplicate")).select(*partition, site, day_bucket(filed, window_days).alias("bucket"))
    return (new if accepted is None else new.unionByName(accepted.select(*partition, site, "bucket"))).distinct()


def due_batch(staging: DataFrame, ts: str, released: str, key: str, now: datetime | str, limit: int) -> DataFrame:
    """The oldest rows that are due and not released yet, at most limit of them."""
    return staging.where((F.col(ts) <= instant(now)) & ~F.col(released)).orderBy(ts, key).limit(limit)


def staging_progress(staging: DataFrame, ts: str, released: str) -> DataFrame:
    """total, released, pending and when the next one is due."""
    return staging.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(released)).alias("released"), F.count_if(~F.col(released)).alias("pending"), F.min(F.when(~F.col(released), F.col(ts))).alias("next_due"))


def staging_plan(collapsed: DataFrame, ts: Column) -> DataFrame:
    """n_dated, n_undatable, earliest and latest of a replay; undatable rows are dropped from it."""
    return collapsed.withColumn("_ts", ts).agg(F.count("_ts").alias("n_dated"), F.count_if(F.col("_ts").isNull()).alias("n_undatable"), F.min("_ts").alias("earliest"), F.max("_ts").alias("latest"))
