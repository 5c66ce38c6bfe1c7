"""Joins and findings: rosters, contractors, attribution, license and relevance lookups, evidence-labelled findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocab



def strength(evidence: Column) -> Column:
    """unknown 0, inferred 1, corroborated 2, verified 3."""
    out = F.when(evidence == "unknown", 0)
    for name, value in vocab.EVIDENCE.items():
        out = out.when(evidence == name, value)
    return out


def roster(records: DataFrame, contacts: DataFrame, arrival: str, key: str = "permit_number") -> DataFrame:
    """Per record its contacts in order of arrival, and how many; none is a fact, not a gap."""
    fields = [c for c in contacts.columns if c not in (key, arrival)]
    held = contacts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(arrival), *fields))).alias("contacts"))
    out = records.select(key).join(held, key, "left")
    return out.withColumn("n_contacts", F.when(F.col("contacts").isNull(), 0).otherwise(F.size("contacts")))


def general_contractor(contacts: DataFrame, arrival: str, key: str = "permit_number") -> DataFrame:
    """Per record the first contractor with a firm, or else the first subcontractor."""
    rank = F.when(F.col("role") == "contractor", 0).when(F.col("role") == "subcontractor", 1)
    named = contacts.withColumn("_rank", rank).where("_rank IS NOT NULL AND firm_name IS NOT NULL")
    best = named.groupBy(key).agg(F.min_by(F.struct("firm_name", "license", "person", "role"), F.struct("_rank", arrival)).alias("gc"))
    return best.select(key, F.col("gc.firm_name").alias("gc_firm"), F.col("gc.license").alias("gc_license"), F.col("gc.person").alias("gc_person"), F.col("gc.role").alias("gc_role"))


def trade_firm_named(contacts: DataFrame, pattern: str, key: str = "permit_number") -> DataFrame:
    """Per record whether any firm's name matches the trade's pattern."""
    return contacts.groupBy(key).agg(F.coalesce(F.bool_or(F.col("firm_name").rlike(pattern)), F.lit(False)).alias("trade_firm_named"))


def attribute(opportunities: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Opportunities with their candidate's record; a broken chain drops out."""
    return opportunities.join(candidates.select("candidate_id", "permit_number"), "candidate_id").join(records, "permit_number")


def not_handled(pairs: DataFrame, handled: DataFrame) -> DataFrame:
    """Pairs of record and subscriber that were neither delivered nor archived yet."""
    return pairs.join(handled.select("permit_number", "customer_id"), ["permit_number", "customer_id"], "left_anti")


def names_agree(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of the other, without punctuation and corporate suffixes; blanks never agree."""
    def bare(c: Column) -> Column:
        out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " ")
        out = F.regexp_replace(out, rf"\b(?:{'|'.join(vocab.NAME_SUFFIXES)})\b", " ")
        return F.trim(F.regexp_replace(out, " +", " "))

    x, y = bare(a), bare(b)
    return (x != "") & (y != "") & (F.startswith(x, y) | F.startswith(y, x))


def verify_licenses(contractors: DataFrame, lookups: DataFrame) -> DataFrame:
    """Contractors with what a license lookup said: status, whether the names agree; without lookup unknown, with a reason."""
    l = lookups.select(F.col("license").alias("_l"), F.col("status").alias("_status"), F.col("business_name").alias("_name"))  # noqa: E741
    out = contractors.join(l, F.col("gc_license") == F.col("_l"), "left")
    found = F.col("_l").isNotNull()
    return out.withColumns({
        "license_status": F.when(found, F.col("_status")),
        "license_evidence": F.when(found, "verified").otherwise("unknown"),
        "identity_corroborated": F.when(found, names_agree(F.col("gc_firm"), F.col("_name"))),
        "license_note": F.when(found, None).when(F.col("gc_license").isNull(), "no license number on the permit").otherwise("license not looked up"),
    }).drop("_l", "_status", "_name")


def judge_relevance(pairs: DataFrame, judgements: DataFrame) -> DataFrame:
    """Pairs with a judgement's two findings; relevance_route says archive for those judged not relevant."""
    j = judgements.select("permit_number", "customer_id", "relevant", "signals")
    out = pairs.join(j, ["permit_number", "customer_id"], "left")
    return out.withColumn("relevance_evidence", F.when(F.col("relevant").isNull(), "unknown").otherwise("inferred")).withColumn("relevance_route", F.when(~F.col("relevant"), "archive").otherwise("score"))


def reply_attribution(replies: DataFrame, deliveries: DataFrame) -> DataFrame:
    """As-of join: each reply with the opportunity last delivered to that subscriber at or before it, or none.

    Both sides meet in one stream per subscriber, ordered by time, so no reply is paired with all deliveries.
    """
    r = replies.select("customer_id", F.col("reply_ts").alias("_ts"), F.lit(1).alias("_kind"), "reply_id", F.lit(None).cast("long").alias("opportunity_id"), F.lit(None).cast("timestamp").alias("delivered_at"))
    d = deliveries.select("customer_id", F.col("delivered_at").alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("reply_id"), F.col("opportunity_id").cast("long").alias("opportunity_id"), "delivered_at")
    so_far = Window.partitionBy("customer_id").orderBy("_ts", "_kind", "opportunity_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("opportunity_id", "delivered_at")), ignorenulls=True).over(so_far)
    both = r.unionByName(d).withColumn("_last", last).where("_kind = 1")
    return both.select("customer_id", "reply_id", F.col("_ts").alias("reply_ts"), F.col("_last.opportunity_id").alias("opportunity_id"), F.col("_last.delivered_at").alias("delivered_at"))


def match_handles(handles: DataFrame, customers: DataFrame) -> DataFrame:
    """Each handle with the one subscriber whose phone ends in the same ten digits; none if several do."""
    tail = lambda c: F.right(F.regexp_replace(F.col(c), "[^0-9]", ""), F.lit(10))
    known = customers.select("customer_id", tail("phone").alias("_tail")).where("length(_tail) = 10").groupBy("_tail").agg(F.count(F.lit(1)).alias("_n"), F.min("customer_id").alias("customer_id")).where("_n = 1")
    return handles.withColumn("_tail", tail("handle")).join(known.drop("_n"), "_tail", "left").drop("_tail")


def join_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a, how many b has, orphans of b, and min, median, mean and max of b's rows per matched key.

    Keys are counted by their number of rows first. Sizes that differ add up to the rows of b, so n rows have at most
    sqrt(2 n) of them, and the median is found over these.
    """
    keys, others = a.select(key).distinct(), b.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = keys.withColumn("_a", F.lit(True)).join(others, key, "full_outer").groupBy(F.col("_a").isNotNull().alias("_known"), "_n").agg(F.count(F.lit(1)).alias("_k"))
    hit = F.col("_known") & F.col("_n").isNotNull()
    n = F.when(hit, F.col("_n"))
    k = F.when(hit, F.col("_k")).otherwise(0)
    one = both.agg(
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_k"))), F.lit(0)).alias("n_keys"), F.sum(k).alias("matched_keys"), F.min(n).alias("min_rows"), F.percentile(n, F.lit(0.5), k).alias("median_rows"), (F.sum(n * k) / F.sum(k)).alias("mean_rows"),
        F.max(n).alias("max_rows"), F.coalesce(F.sum(F.when(~F.col("_known"), F.col("_n") * F.col("_k"))), F.lit(0)).alias("orphan_rows"),
    )
    return one.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_keys", "matched_keys", "orphan_rows")})


def build_findings(rows: DataFrame) -> DataFrame:
    """Long-format findings of candidates: candidate_id, key, label, value_str, value_num, value_bool, evidence, note, seq.

    rows hold the record, gc_* columns, license_* columns, relevance columns, n_contacts and trade_firm_named. One row
    per candidate becomes up to 17; a business license appears only where there is one.
    """
    c = F.col
    none = F.lit(None)

    def finding(key: str, label: str, s=none, n=none, b=none, evidence=None, note=none, when=None):
        value = F.coalesce(s.cast("string"), n.cast("string"), b.cast("string"))
        level = F.when(value.isNull(), "unknown").otherwise(F.lit(evidence) if isinstance(evidence, str) else evidence)
        row = F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), s.cast("string").alias("value_str"), n.cast("double").alias("value_num"), b.cast("boolean").alias("value_bool"), level.alias("evidence"), note.cast("string").alias("note"))
        return row if when is None else F.when(when, row)

    use = F.coalesce(c("existing_use"), c("proposed_use"))
    every = [
        finding("project.address", "Address", c("address"), evidence="verified"), finding("project.neighborhood", "Neighborhood", c("neighborhood"), evidence="verified"),
        finding("project.use", "Building use", use, evidence="verified"), finding("project.valuation", "Valuation", n=c("valuation"), evidence="verified", note=c("valuation_source")),
        finding("project.status", "Status", c("status"), evidence="verified"), finding("project.issued_date", "Issued", c("issued_date").cast("string"), evidence="verified"),
        finding("project.stories", "Stories", n=F.greatest("stories_existing", "stories_proposed"), evidence="verified"), finding("contacts.rows", "Contact rows", n=c("n_contacts"), evidence="verified"),
        finding("gc.firm_name", "General contractor", c("gc_firm"), evidence="verified"), finding("gc.contact_name", "Contact", c("gc_person"), evidence="verified"),
        finding("gc.license_number", "License", c("gc_license"), evidence="verified"), finding("gc.sf_business_license", "Business license", c("gc_business_license"), evidence="verified", when=c("gc_business_license").isNotNull()),
        finding("gc.license_status", "License status", c("license_status"), evidence="verified", note=c("license_note")), finding("gc.identity_corroborated", "Names agree", b=c("identity_corroborated"), evidence=F.when(c("identity_corroborated"), "corroborated").otherwise("inferred")),
        finding("permit.electrical_sub_named", "Trade firm named", b=c("trade_firm_named"), evidence="verified"), finding("trade.relevant", "Relevant to the trade", b=c("relevant"), evidence="inferred"),
        finding("trade.scope_signals", "Scope signals", c("signals"), evidence="inferred"),
    ]
    return rows.select("candidate_id", F.posexplode(F.array(*every)).alias("seq", "f")).where("f IS NOT NULL").select("candidate_id", "seq", "f.*")


def merge_findings(observations: DataFrame, seq: str = "seq") -> DataFrame:
    """One finding per candidate and key: the strongest evidence, the first one among equals."""
    order = Window.partitionBy("candidate_id", "key").orderBy(F.desc(strength(F.col("evidence"))), F.col(seq))
    return observations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def finding_actions(observations: DataFrame, seq: str = "seq") -> DataFrame:
    """What each observation did when it came: inserted, upgraded (strictly stronger) or kept."""
    earlier = Window.partitionBy("candidate_id", "key").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(strength(F.col("evidence"))).over(earlier)
    return observations.withColumn("action", F.when(best.isNull(), "inserted").when(strength(F.col("evidence")) > best, "upgraded").otherwise("kept"))


def evidence_counts(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per candidate, zeros included: findings per level, in total, established, unknown, and the sum of strengths."""
    has = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"), F.col("value_bool").cast("string")).isNotNull()
    per = findings.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_findings"), *(F.count_if(F.col("evidence") == e).alias(f"n_{e}") for e in vocab.EVIDENCE),
        F.count_if(has & (F.col("evidence") != "unknown")).alias("n_established"), F.sum(strength(F.col("evidence"))).alias("strength_sum"),
    )
    return candidates.select("candidate_id").join(per, "candidate_id", "left").na.fill(0)


def strongest_finding(findings: DataFrame, prefix: str) -> DataFrame:
    """Per candidate the strongest finding with a value under the prefix; the first key among equals."""
    value = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"), F.col("value_bool").cast("string"))
    rows = findings.withColumn("_v", value).where(F.startswith("key", F.lit(prefix)) & F.col("_v").isNotNull())
    best = rows.groupBy("candidate_id").agg(F.min_by(F.struct("key", F.col("_v").alias("value"), strength(F.col("evidence")).alias("strength")), F.struct((-strength(F.col("evidence"))).alias("a"), F.col("key").alias("b"))).alias("x"))
    return best.select("candidate_id", "x.*")
