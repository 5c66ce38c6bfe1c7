"""Candidates, opportunities and prospects: routing, merges with column policies, samples, pools, ranks and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import text
from . import vocab


#: Parts of a profile's rows that are ranked side by side.
PARTS = 32


def _merged(store: DataFrame, batch: DataFrame, keys: list[str], take: list[str], keep: list[str]) -> DataFrame:
    """Full-outer merge: take columns come from the batch where it has the row, keep columns stay where the store has it."""
    s, b = store.alias("s"), batch.alias("b")
    both = s.join(b, [F.col(f"s.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    seen, known = F.col(f"b.{keys[0]}").isNotNull(), F.col(f"s.{keys[0]}").isNotNull()
    cols = [F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in keys]
    cols += [F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in take]
    cols += [F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in keep]
    return both.select(*cols, F.when(~known, "inserted").when(~seen, "kept").otherwise("refreshed").alias("merge_action"))


def upsert_candidates(store: DataFrame, batch: DataFrame) -> DataFrame:
    """On (permit_number, customer_id): the reason is refreshed, the stage stays."""
    return _merged(store, batch, ["permit_number", "customer_id"], ["reason"], ["stage"])


def merge_opportunities(store: DataFrame, batch: DataFrame) -> DataFrame:
    """On candidate_id: a new score replaces the old one; delivery and feedback stay."""
    return _merged(store, batch, ["candidate_id"], ["score", "status"], ["delivered_at", "feedback"])


def route_scored(scored: DataFrame) -> DataFrame:
    """delivered, or archived with a reason: judged not relevant, the fatal flags, or a score below the bar."""
    flags = F.array_join("fatal_flags", ", ")
    off = F.coalesce(F.col("relevance_route") == "archive", F.lit(False)) if "relevance_route" in scored.columns else F.lit(False)
    good = (F.size("fatal_flags") == 0) & (F.col("score") >= vocab.DELIVERY_BAR) & ~off
    reason = F.when(off, "judged not relevant").when(F.size("fatal_flags") > 0, F.concat(F.lit("disqualified: "), flags)).when(~good, F.concat(F.lit("score "), F.col("score"), F.lit(f" below {vocab.DELIVERY_BAR}")))
    return scored.withColumn("route", F.when(good, "delivered").otherwise("archived")).withColumn("route_reason", reason)


def batch_survivors(sheet: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Survivors of the gates, the first limit per profile marked process and the rest held.

    No task ranks a profile: each part of a profile's survivors keeps its first limit, the first limit of these give the
    last row that is processed, and rows are compared with it. order must tell a profile's survivors apart.
    """
    rows = sheet.where("rejected_by IS NULL")
    place = F.struct(*order)
    part = Window.partitionBy("profile_id", "_part").orderBy("_place")
    few = rows.select("profile_id", place.alias("_place"), F.pmod(F.xxhash64(*order), F.lit(PARTS)).alias("_part")).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= limit)
    first = few.withColumn("_n", F.row_number().over(Window.partitionBy("profile_id").orderBy("_place"))).where(F.col("_n") <= limit)
    last = first.groupBy(F.col("profile_id").alias("_p")).agg(F.max("_place").alias("_last"))
    marked = rows.join(last, F.col("profile_id").eqNullSafe(F.col("_p")), "left")
    return marked.withColumn("batch", F.when(place <= F.col("_last"), "process").otherwise("held")).drop("_p", "_last")


def best_sample(scored: DataFrame, newest: int, order: list[str]) -> DataFrame:
    """Per profile the highest score without fatal flag among its newest survivors; the first of that order among equals."""
    n = F.row_number().over(Window.partitionBy("profile_id").orderBy(*order))
    recent = scored.withColumn("_n", n).where(F.col("_n") <= newest).where(F.size("fatal_flags") == 0)
    best = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("score"), "_n"))
    return recent.withColumn("_b", best).where("_b = 1").drop("_n", "_b")


def pick_best(rows: DataFrame, score: str, newest: str, key: str) -> DataFrame:
    """The single best row: highest score, then newest, then smallest key."""
    return rows.orderBy(F.desc(score), F.desc(newest), key).limit(1)


def inbox(opportunities: DataFrame, customer, k: int) -> DataFrame:
    """The newest k delivered or pending opportunities of one subscriber, and how many more there are."""
    own = opportunities.where((F.col("customer_id") == customer) & F.col("status").isin("delivered", "pending")).withColumn("shown_at", F.coalesce("delivered_at", "created_at"))
    hidden = own.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("n_hidden"))
    return own.orderBy(F.desc("shown_at"), "opportunity_id").limit(k).crossJoin(hidden)


def opportunity_list(opportunities: DataFrame, limit: int, status: str | None = None, customer=None) -> DataFrame:
    """The newest opportunities, filtered; top-k before any join."""
    rows = opportunities
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if customer is not None:
        rows = rows.where(F.col("customer_id") == customer)
    return rows.orderBy(F.desc("created_at"), "opportunity_id").limit(limit)


def opportunity_feed(opportunities: DataFrame, candidates: DataFrame, records: DataFrame, findings: DataFrame, limit: int, status: str | None = None, customer=None) -> DataFrame:
    """opportunity_list with record and findings attached."""
    top = opportunity_list(opportunities, limit, status, customer).join(candidates.select("candidate_id", "permit_number"), "candidate_id").join(records, "permit_number")
    own = findings.join(top.select("candidate_id"), "candidate_id", "left_semi").groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("key", "evidence"))).alias("findings"))
    return top.join(own, "candidate_id", "left")


def prospect_pool(contacts: DataFrame, roles: list[str], cities: list[str] | None = None, min_permits: int = 1, arrival: str = "arrival") -> DataFrame:
    """Per numeric license with a firm: distinct permits, sorted roles, the first city, state and zip, the latest permit's name."""
    rows = contacts.where(F.col("license").rlike(r"^\d+$") & F.col("firm_name").isNotNull() & F.col("role").isin(*roles))
    if cities is not None:
        rows = rows.where(F.lower("city").isin(*cities))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c)
    out = rows.groupBy("license").agg(
        F.count_distinct("permit_number").alias("n_permits"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), first("city"), first("state"), first("zipcode"),
        F.max_by("firm_name", F.struct("permit_number", arrival)).alias("firm_name"), F.max("permit_number").alias("latest_permit"),
    )
    return out.where(F.col("n_permits") >= min_permits)


def qualify_prospects(prospects: DataFrame) -> DataFrame:
    """License of 3 to 10 digits and a San Francisco city or zip, with a sentence for either."""
    licensed = F.coalesce(F.col("license").rlike(r"^\d{3,10}$"), F.lit(False))
    local = F.coalesce(F.lower(F.trim("city")).isin(*vocab.SF_CITIES), F.lit(False)) | F.coalesce(F.col("zipcode").rlike(r"^941\d{2}$"), F.lit(False))
    reasons = F.array(F.when(licensed, "holds a contractor license").otherwise("license is not a contractor's"), F.when(local, "works in San Francisco").otherwise("not placed in San Francisco"))
    return prospects.withColumn("qualified", licensed & local).withColumn("qualify_reasons", reasons)


def rank_prospects(prospects: DataFrame, activity: DataFrame) -> DataFrame:
    """Adds permit_count, prospect_rank (40, 15 or 0 by segment, 3 per permit up to ten, 20 if never contacted) and
    rank_reasons: what gave points, with the points; the segment always, the others where they count."""
    rows = prospects.join(activity.select("license", F.col("n").alias("permit_count")), "license", "left").withColumn("permit_count", F.coalesce("permit_count", F.lit(0)))
    segment = F.when(F.col("segment") == "commercial", 40).when(F.col("segment") == "unknown", 15).otherwise(0)
    permits, new = 3 * F.least("permit_count", F.lit(10)), F.when(F.col("contacted_at").isNull(), 20).otherwise(0)
    said = lambda what, points: F.concat(what, F.lit(": +"), points.cast("string"))
    reasons = F.array_compact(F.array(
        said(F.concat(F.lit("segment "), F.when(F.col("segment").isin("commercial", "unknown"), F.col("segment")).otherwise("residential")), segment),
        F.when(permits > 0, said(F.concat(F.lit("permits "), F.col("permit_count").cast("string")), permits)), F.when(new > 0, said(F.lit("not contacted yet"), new)),
    ))
    return rows.withColumn("prospect_rank", (segment + permits + new).cast("double")).withColumn("rank_reasons", reasons)


def next_prospects(ranked: DataFrame, k: int) -> DataFrame:
    """The best k that were never contacted: one to contact, the rest runners-up."""
    top = ranked.where("qualified AND contacted_at IS NULL").orderBy(F.desc("prospect_rank"), F.desc("permit_count"), "firm_name", "license").limit(k)
    n = F.row_number().over(Window.orderBy(F.desc("prospect_rank"), F.desc("permit_count"), "firm_name", "license"))
    return top.withColumn("place", n).withColumn("pick", F.when(F.col("place") == 1, "next").otherwise("runner-up"))


def reconcile_prospects(store: DataFrame, batch: DataFrame, fields: list[str], arrival: str) -> DataFrame:
    """Merges on (license, lower firm): the last duplicate wins and only fields it supplies are patched."""
    def identity(df: DataFrame) -> DataFrame:
        return df.withColumn("_l", F.coalesce("license", F.lit(""))).withColumn("_f", F.lower("firm_name"))

    last = F.row_number().over(Window.partitionBy("_l", "_f").orderBy(F.desc(arrival)))
    b = identity(batch).withColumn("_n", last).where("_n = 1").alias("b")
    s = identity(store).alias("s")
    both = s.join(b, (F.col("s._l") == F.col("b._l")) & (F.col("s._f") == F.col("b._f")), "full_outer")
    known, seen = F.col("s._f").isNotNull(), F.col("b._f").isNotNull()
    moved = F.lit(False)
    for f in fields:
        moved = moved | (F.col(f"b.{f}").isNotNull() & ~F.col(f"b.{f}").eqNullSafe(F.col(f"s.{f}")))
    return both.select(
        F.coalesce("s.license", "b.license").alias("license"), F.coalesce("s.firm_name", "b.firm_name").alias("firm_name"), *(F.coalesce(f"b.{f}", f"s.{f}").alias(f) for f in fields),
        F.when(~known, "inserted").when(~seen, "kept").when(moved, "updated").otherwise("unchanged").alias("merge_action"),
    )


def qualified_queue(prospects: DataFrame, limit: int) -> DataFrame:
    """Qualified prospects, never contacted first, then the longest ago, then the oldest."""
    return prospects.where("qualified").orderBy(F.asc_nulls_first("contacted_at"), "created_at", "license").limit(limit)


def apply_segments(prospects: DataFrame, classified: DataFrame) -> DataFrame:
    """Writes segments that a classification settled (commercial or residential), labelled inferred; others stay."""
    c = classified.where(F.col("segment").isin("commercial", "residential")).select("license", F.col("segment").alias("_segment")).dropDuplicates(["license"])
    out = prospects.join(c, "license", "left")
    return out.withColumn("segment_evidence", F.when(F.col("_segment").isNotNull(), "inferred").otherwise(F.col("segment_evidence"))).withColumn("segment", F.coalesce("_segment", "segment")).drop("_segment")


def firm_variants(contacts: DataFrame) -> DataFrame:
    """Per license how many ways its firm's name is written, raw and normalised."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text("firm_name")), "[^a-z0-9 ]+", " "), " +", " "))
    return contacts.where("license IS NOT NULL").groupBy("license").agg(F.count_distinct("firm_name").alias("n_raw"), F.count_distinct(bare).alias("n_normalised"))
