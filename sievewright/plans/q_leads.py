"""Queries over joins, findings, candidates, opportunities and prospects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as J
from ..operators import leads as L
from ..operators import vocab
from .bindings import NOW, frame, with_roles
from .q_scoring import _PAIRS, scored
from .registry import query

CON, OPP = with_roles("contacts"), with_roles("opportunities")
RC = with_roles("records", "contacts")


@query("j1_roster", RC + "SELECT r.permit_number, CAST(COUNT(c.arrival) AS INT) AS n_contacts, COALESCE(STRING_AGG(c.role, ',' ORDER BY c.arrival), '') AS roles FROM records r LEFT JOIN contacts c ON c.permit_number = r.permit_number GROUP BY 1")
def _(spark, d):
    out = J.roster(frame(spark, d, "records"), frame(spark, d, "contacts").select("permit_number", "arrival", "role"), "arrival")
    return out.select("permit_number", "n_contacts", F.coalesce(F.array_join(F.transform("contacts", lambda c: c["role"]), ","), F.lit("")).alias("roles"))


_GC = """, gc AS (SELECT permit_number, firm_name AS gc_firm, license AS gc_license, role AS gc_role, person AS gc_person FROM
    (SELECT *, ROW_NUMBER() OVER (PARTITION BY permit_number ORDER BY CASE role WHEN 'contractor' THEN 0 ELSE 1 END, arrival) AS n FROM contacts WHERE role IN ('contractor', 'subcontractor') AND firm_name IS NOT NULL) WHERE n = 1) """


@query("j2_general_contractor", CON + _GC + "SELECT permit_number, gc_firm, gc_license, gc_role FROM gc")
def _(spark, d):
    return J.general_contractor(frame(spark, d, "contacts"), "arrival").select("permit_number", "gc_firm", "gc_license", "gc_role")


@query("j3_trade_firm_named", CON + "SELECT permit_number, COALESCE(BOOL_OR(REGEXP_MATCHES(firm_name, '00[0-9]*7')), FALSE) AS trade_firm_named FROM contacts GROUP BY 1")
def _(spark, d):
    return J.trade_firm_named(frame(spark, d, "contacts"), "00[0-9]*7")


def _attributed(spark, d):
    o = frame(spark, d, "opportunities")
    return J.attribute(o.drop("permit_number"), o.where("candidate_id % 17 <> 0").select("candidate_id", "permit_number"), frame(spark, d, "records").drop("status"))


_ATT = with_roles("opportunities", "records") + ", att AS (SELECT o.*, r.existing_use, r.proposed_use FROM opportunities o JOIN records r ON r.permit_number = o.permit_number WHERE o.candidate_id % 17 <> 0) "


@query("j4_attribution", _ATT + "SELECT opportunity_id, permit_number, existing_use FROM att")
def _(spark, d):
    return _attributed(spark, d).select("opportunity_id", "permit_number", "existing_use")


@query("j5_not_handled", OPP + "SELECT permit_number, customer_id FROM opportunities EXCEPT SELECT permit_number, customer_id FROM opportunities WHERE status IN ('delivered', 'archived')")
def _(spark, d):
    o = frame(spark, d, "opportunities")
    return J.not_handled(o.select("permit_number", "customer_id"), o.where("status IN ('delivered', 'archived')"))


_LOOK = ", looks AS (SELECT CAST(s_suppkey + 100 AS STRING) AS license, CASE WHEN s_suppkey % 4 = 0 THEN 'expired' ELSE 'active' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'Other Firm LLC' ELSE UPPER(CONCAT(s_name, ' Corp')) END AS business_name FROM supplier WHERE s_suppkey % 5 <> 1) "


def _lookups(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 5 <> 1")
    return s.selectExpr("CAST(s_suppkey + 100 AS STRING) AS license", "CASE WHEN s_suppkey % 4 = 0 THEN 'expired' ELSE 'active' END AS status", "CASE WHEN s_suppkey % 3 = 0 THEN 'Other Firm LLC' ELSE UPPER(CONCAT(s_name, ' Corp')) END AS business_name")


@query(
    "j6_verify_licenses",
    CON + _GC + _LOOK + """SELECT permit_number, status AS license_status, CASE WHEN license IS NULL THEN 'unknown' ELSE 'verified' END AS license_evidence, CASE WHEN license IS NOT NULL THEN business_name <> 'Other Firm LLC' END AS identity_corroborated,
        CASE WHEN license IS NOT NULL THEN NULL WHEN gc_license IS NULL THEN 'no license number on the permit' ELSE 'license not looked up' END AS license_note FROM gc LEFT JOIN looks ON looks.license = gc.gc_license""",
)
def _(spark, d):
    out = J.verify_licenses(J.general_contractor(frame(spark, d, "contacts"), "arrival"), _lookups(spark, d))
    return out.select("permit_number", "license_status", "license_evidence", "identity_corroborated", "license_note")


@query("j7_names_agree", "SELECT s_suppkey, s_suppkey % 3 <> 0 AS agree FROM supplier")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    other = F.when(F.col("s_suppkey") % 3 == 0, F.lit("The Other Firm, Inc.")).otherwise(F.concat(F.lower("s_name"), F.lit(", L.L.C. Company")))
    return s.select("s_suppkey", J.names_agree(F.col("s_name"), F.regexp_replace(other, "l.l.c.|L.L.C.", "llc")).alias("agree"))


@query("j8_judge_relevance", OPP + "SELECT permit_number, customer_id, CASE WHEN opportunity_id % 4 = 3 THEN 'unknown' ELSE 'inferred' END AS relevance_evidence, CASE WHEN opportunity_id % 4 = 0 THEN 'archive' ELSE 'score' END AS relevance_route FROM opportunities")
def _(spark, d):
    o = frame(spark, d, "opportunities")
    judged = o.where("opportunity_id % 4 <> 3").selectExpr("permit_number", "customer_id", "opportunity_id % 4 <> 0 AS relevant", "'text' AS signals")
    return J.judge_relevance(o.select("permit_number", "customer_id"), judged).select("permit_number", "customer_id", "relevance_evidence", "relevance_route")


def _asof(spark, d):
    replies = frame(spark, d, "verdicts").selectExpr("customer_id % 40 AS customer_id", "ts AS reply_ts", "event_id AS reply_id")
    sent = frame(spark, d, "opportunities").where("status = 'delivered'").selectExpr("customer_id", "opportunity_id", "timestampadd(DAY, CAST(opportunity_id % 400 AS INT), timestamp'2023-01-01 00:00:00') AS delivered_at")
    return J.reply_attribution(replies, sent)


@query(
    "j9_reply_attribution",
    with_roles("verdicts", "opportunities") + """, sent AS (SELECT customer_id, opportunity_id, TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(opportunity_id % 400 AS INTEGER)) AS delivered_at FROM opportunities WHERE status = 'delivered')
    SELECT v.customer_id % 40 AS customer_id, v.event_id AS reply_id, (SELECT ARG_MAX(s.opportunity_id, (s.delivered_at, s.opportunity_id)) FROM sent s WHERE s.customer_id = v.customer_id % 40 AND s.delivered_at <= v.ts) AS opportunity_id FROM verdicts v""",
)
def _(spark, d):
    return _asof(spark, d).select("customer_id", "reply_id", "opportunity_id")


@query(
    "j10_match_handles",
    """WITH known AS (SELECT LPAD(CAST(c_custkey % 1000 AS STRING), 10, '5') AS tail, MIN(c_custkey) AS customer_id FROM customer GROUP BY 1 HAVING COUNT(*) = 1), h AS (SELECT DISTINCT LPAD(CAST(o_custkey % 1000 AS STRING), 10, '5') AS tail FROM orders)
    SELECT CONCAT('+1 ', h.tail) AS handle, known.customer_id FROM h LEFT JOIN known ON known.tail = h.tail""",
)
def _(spark, d):
    tail = "LPAD(CAST({0} % 1000 AS STRING), 10, '5')"
    handles = spark.read.parquet(f"{d}/orders.parquet").selectExpr(f"CONCAT('+1 ', {tail.format('o_custkey')}) AS handle").distinct()
    customers = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS customer_id", f"CONCAT('(1) ', {tail.format('c_custkey')}) AS phone")
    return J.match_handles(handles, customers)


@query(
    "j11_join_coverage",
    with_roles("records", "contacts") + """, r AS (SELECT * FROM records WHERE arrival % 10 <> 0), n AS (SELECT permit_number, COUNT(*) AS n FROM contacts GROUP BY 1)
    SELECT (SELECT COUNT(*) FROM r) AS n_keys, COUNT(*) AS matched_keys, MIN(n) AS min_rows, CAST(QUANTILE_CONT(n, 0.5) AS DOUBLE) AS median_rows, FLOOR(AVG(n) * 1000 + 0.5) / 1000 AS mean_rows, MAX(n) AS max_rows,
        (SELECT CAST(SUM(n) AS BIGINT) FROM n WHERE permit_number NOT IN (SELECT permit_number FROM r)) AS orphan_rows FROM n WHERE permit_number IN (SELECT permit_number FROM r)""",
)
def _(spark, d):
    out = J.join_coverage(frame(spark, d, "records").where("arrival % 10 <> 0"), frame(spark, d, "contacts"), "permit_number")
    return out.withColumn("mean_rows", F.floor(F.col("mean_rows") * 1000 + 0.5) / 1000)


def _candidate_rows(spark, d):
    records, contacts = frame(spark, d, "valued"), frame(spark, d, "contacts")
    rows = records.join(J.roster(records, contacts.select("permit_number", "arrival", "role"), "arrival").drop("contacts"), "permit_number")
    rows = rows.join(J.verify_licenses(J.general_contractor(contacts, "arrival"), _lookups(spark, d)), "permit_number", "left").join(J.trade_firm_named(contacts, "00[0-9]*7"), "permit_number", "left")
    return rows.withColumns({"candidate_id": F.col("arrival"), "valuation_source": F.lit("costs"), "gc_business_license": F.when(F.col("arrival") % 6 == 0, F.lit("B-1")), "relevant": F.when(F.col("arrival") % 4 != 3, F.col("arrival") % 4 != 0), "signals": F.lit(None).cast("string")})


_FIND = with_roles("valued", "contacts") + _GC + _LOOK + """, cand AS (SELECT v.*, gc.gc_firm, gc.gc_license, gc.gc_person, looks.license, looks.status AS look_status, looks.business_name, (SELECT COUNT(*) FROM contacts c WHERE c.permit_number = v.permit_number) AS n_contacts,
        (SELECT COALESCE(BOOL_OR(REGEXP_MATCHES(c.firm_name, '00[0-9]*7')), FALSE) FROM contacts c WHERE c.permit_number = v.permit_number HAVING COUNT(*) > 0) AS named FROM valued v LEFT JOIN gc ON gc.permit_number = v.permit_number LEFT JOIN looks ON looks.license = gc.gc_license),
    long AS (SELECT arrival AS candidate_id, key, evidence FROM cand, LATERAL (VALUES ('project.address', CASE WHEN address IS NULL THEN 'unknown' ELSE 'verified' END), ('project.neighborhood', CASE WHEN neighborhood IS NULL THEN 'unknown' ELSE 'verified' END),
        ('project.use', CASE WHEN COALESCE(existing_use, proposed_use) IS NULL THEN 'unknown' ELSE 'verified' END), ('project.valuation', CASE WHEN valuation IS NULL THEN 'unknown' ELSE 'verified' END), ('project.status', 'verified'), ('project.issued_date', CASE WHEN issued_date IS NULL THEN 'unknown' ELSE 'verified' END),
        ('project.stories', CASE WHEN COALESCE(stories_existing, stories_proposed) IS NULL THEN 'unknown' ELSE 'verified' END), ('contacts.rows', 'verified'), ('gc.firm_name', CASE WHEN gc_firm IS NULL THEN 'unknown' ELSE 'verified' END), ('gc.contact_name', CASE WHEN gc_person IS NULL THEN 'unknown' ELSE 'verified' END),
        ('gc.license_number', CASE WHEN gc_license IS NULL THEN 'unknown' ELSE 'verified' END), ('gc.sf_business_license', CASE WHEN arrival % 6 = 0 THEN 'verified' END), ('gc.license_status', CASE WHEN license IS NULL THEN 'unknown' ELSE 'verified' END),
        ('gc.identity_corroborated', CASE WHEN license IS NULL THEN 'unknown' WHEN business_name = 'Other Firm LLC' THEN 'inferred' ELSE 'corroborated' END), ('permit.electrical_sub_named', CASE WHEN named IS NULL THEN 'unknown' ELSE 'verified' END),
        ('trade.relevant', CASE WHEN arrival % 4 = 3 THEN 'unknown' ELSE 'inferred' END), ('trade.scope_signals', 'unknown')) f(key, evidence) WHERE evidence IS NOT NULL) """


@query("f1_build_findings", _FIND + "SELECT candidate_id, key, evidence FROM long")
def _(spark, d):
    return J.build_findings(_candidate_rows(spark, d)).select("candidate_id", "key", "evidence")


_OBS = """WITH obs AS (SELECT event_id, user_id AS candidate_id, CONCAT('k', CAST(event_id % 4 AS STRING)) AS key, CASE event_type WHEN 'signup' THEN 'unknown' WHEN 'view' THEN 'inferred' WHEN 'click' THEN 'corroborated' WHEN 'purchase' THEN 'verified' ELSE 'unknown' END AS evidence,
    CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS s FROM events) """


def _observations(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS seq", "user_id AS candidate_id", "CONCAT('k', CAST(event_id % 4 AS STRING)) AS key", "CASE event_type WHEN 'signup' THEN 'unknown' WHEN 'view' THEN 'inferred' WHEN 'click' THEN 'corroborated' WHEN 'purchase' THEN 'verified' ELSE 'unknown' END AS evidence")


@query("f2_merge_findings", _OBS + "SELECT candidate_id, key, ARG_MIN(event_id, CAST(3 - s AS BIGINT) * 1000000000 + event_id) AS seq FROM obs GROUP BY 1, 2")
def _(spark, d):
    return J.merge_findings(_observations(spark, d)).select("candidate_id", "key", "seq")


@query("f3_finding_actions", _OBS + ", b AS (SELECT *, MAX(s) OVER (PARTITION BY candidate_id, key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM obs) SELECT event_id AS seq, CASE WHEN best IS NULL THEN 'inserted' WHEN s > best THEN 'upgraded' ELSE 'kept' END AS action FROM b")
def _(spark, d):
    return J.finding_actions(_observations(spark, d)).select("seq", "action")


@query(
    "f4_evidence_counts",
    _FIND + """SELECT candidate_id, COUNT(*) AS n_findings, COUNT(*) FILTER (WHERE evidence = 'unknown') AS n_unknown, COUNT(*) FILTER (WHERE evidence = 'inferred') AS n_inferred, COUNT(*) FILTER (WHERE evidence = 'corroborated') AS n_corroborated, COUNT(*) FILTER (WHERE evidence = 'verified') AS n_verified,
        COUNT(*) FILTER (WHERE evidence <> 'unknown') AS n_established FROM long GROUP BY 1""",
)
def _(spark, d):
    rows = _candidate_rows(spark, d)
    return J.evidence_counts(J.build_findings(rows), rows).drop("strength_sum")


@query("f5_strongest_finding", _FIND + "SELECT candidate_id, ARG_MIN(key, (CASE evidence WHEN 'verified' THEN 0 WHEN 'corroborated' THEN 1 ELSE 2 END, key)) AS key FROM long WHERE key LIKE 'gc.%' AND evidence <> 'unknown' GROUP BY 1")
def _(spark, d):
    return J.strongest_finding(J.build_findings(_candidate_rows(spark, d)), "gc.").select("candidate_id", "key")


_CAND = OPP + ", s AS (SELECT permit_number, customer_id, 'old' AS reason, 'gated' AS stage FROM opportunities WHERE opportunity_id % 4 < 3), b AS (SELECT permit_number, customer_id, 'new' AS reason, 'fresh' AS stage FROM opportunities WHERE opportunity_id % 4 > 0) "


@query("p1_upsert_candidates", _CAND + "SELECT COALESCE(s.permit_number, b.permit_number) AS permit_number, COALESCE(s.customer_id, b.customer_id) AS customer_id, COALESCE(b.reason, s.reason) AS reason, COALESCE(s.stage, b.stage) AS stage, CASE WHEN s.stage IS NULL THEN 'inserted' WHEN b.stage IS NULL THEN 'kept' ELSE 'refreshed' END AS merge_action FROM s FULL JOIN b ON s.permit_number = b.permit_number AND s.customer_id = b.customer_id")
def _(spark, d):
    o = frame(spark, d, "opportunities")
    pick = lambda where, reason, stage: o.where(where).select("permit_number", "customer_id", F.lit(reason).alias("reason"), F.lit(stage).alias("stage"))
    return L.upsert_candidates(pick("opportunity_id % 4 < 3", "old", "gated"), pick("opportunity_id % 4 > 0", "new", "fresh"))


@query(
    "p2_route_scored",
    _PAIRS + "SELECT permit_number, profile_id, CASE WHEN flags = '' AND FLOOR(total + 0.5) >= 80 THEN 'delivered' ELSE 'archived' END AS route, CASE WHEN flags <> '' THEN CONCAT('disqualified: ', REPLACE(flags, ',', ', ')) WHEN FLOOR(total + 0.5) < 80 THEN CONCAT('score ', CAST(CAST(FLOOR(total + 0.5) AS INT) AS STRING), ' below 80') END AS route_reason FROM scored",
)
def _(spark, d):
    return L.route_scored(scored(spark, d)).select("permit_number", "profile_id", "route", "route_reason")


@query("p3_merge_opportunities", OPP + ", s AS (SELECT * FROM opportunities WHERE opportunity_id % 3 = 0), b AS (SELECT * FROM opportunities WHERE opportunity_id % 2 = 0) SELECT COALESCE(s.candidate_id, b.candidate_id) AS candidate_id, CASE WHEN b.candidate_id IS NOT NULL THEN b.score + 1 ELSE s.score END AS score, CASE WHEN s.candidate_id IS NOT NULL THEN s.feedback ELSE b.feedback END AS feedback, CASE WHEN s.candidate_id IS NULL THEN 'inserted' WHEN b.candidate_id IS NULL THEN 'kept' ELSE 'refreshed' END AS merge_action FROM s FULL JOIN b ON s.candidate_id = b.candidate_id")
def _(spark, d):
    o = frame(spark, d, "opportunities")
    return L.merge_opportunities(o.where("opportunity_id % 3 = 0"), o.where("opportunity_id % 2 = 0").withColumn("score", F.col("score") + 1)).select("candidate_id", "score", "feedback", "merge_action")


def _survivors(spark, d):
    return frame(spark, d, "opportunities").withColumn("profile_id", F.col("customer_id")).withColumn("rejected_by", F.when(F.col("opportunity_id") % 5 == 0, "status")).withColumn("fatal_flags", F.when(F.col("opportunity_id") % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))


@query("p4_batch_survivors", OPP + "SELECT opportunity_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY opportunity_id) <= 10 THEN 'process' ELSE 'held' END AS batch FROM opportunities WHERE opportunity_id % 5 <> 0")
def _(spark, d):
    return L.batch_survivors(_survivors(spark, d), 10, ["opportunity_id"]).select("opportunity_id", "batch")


@query("p5_best_sample", OPP + ", n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY opportunity_id) AS n FROM opportunities) SELECT customer_id AS profile_id, ARG_MAX(opportunity_id, score * 1000000 - n) AS opportunity_id FROM n WHERE n <= 20 AND opportunity_id % 7 <> 0 GROUP BY 1")
def _(spark, d):
    return L.best_sample(_survivors(spark, d), 20, ["opportunity_id"]).select("profile_id", "opportunity_id")


@query("p6_pick_best", OPP + "SELECT opportunity_id, score FROM opportunities ORDER BY score DESC, created_at DESC, opportunity_id LIMIT 1")
def _(spark, d):
    return L.pick_best(frame(spark, d, "opportunities"), "score", "created_at", "opportunity_id").select("opportunity_id", "score")


@query("p7_inbox", OPP + "SELECT opportunity_id, status, (SELECT COUNT(*) - 5 FROM opportunities WHERE customer_id = 7 AND status IN ('delivered', 'pending')) AS n_hidden FROM opportunities WHERE customer_id = 7 AND status IN ('delivered', 'pending') ORDER BY COALESCE(delivered_at, created_at) DESC, opportunity_id LIMIT 5")
def _(spark, d):
    return L.inbox(frame(spark, d, "opportunities"), 7, 5).select("opportunity_id", "status", "n_hidden")


@query("p8_opportunity_list", OPP + "SELECT opportunity_id, score FROM opportunities WHERE status = 'delivered' ORDER BY created_at DESC, opportunity_id LIMIT 30")
def _(spark, d):
    return L.opportunity_list(frame(spark, d, "opportunities"), 30, status="delivered").select("opportunity_id", "score")


@query("p9_opportunity_feed", _FIND + ", " + with_roles("opportunities")[5:] + "SELECT o.opportunity_id, o.score, (SELECT STRING_AGG(key || '=' || evidence, ',' ORDER BY key, evidence) FROM long WHERE long.candidate_id = o.candidate_id) AS findings FROM (SELECT * FROM opportunities ORDER BY created_at DESC, opportunity_id LIMIT 20) o JOIN valued v ON v.permit_number = o.permit_number")
def _(spark, d):
    o = frame(spark, d, "opportunities")
    feed = L.opportunity_feed(o.drop("permit_number"), o.select("candidate_id", "permit_number"), frame(spark, d, "records").drop("status"), J.build_findings(_candidate_rows(spark, d)), 20)
    return feed.select("opportunity_id", "score", F.array_join(F.transform("findings", lambda x: F.concat(x["key"], F.lit("="), x["evidence"])), ",").alias("findings"))


_POOL = CON + """, pool AS (SELECT license, COUNT(DISTINCT permit_number) AS n_permits, (SELECT STRING_AGG(r, ',' ORDER BY r) FROM (SELECT DISTINCT role AS r FROM contacts k WHERE k.license = c.license AND k.firm_name IS NOT NULL AND k.role IN ('contractor', 'subcontractor'))) AS roles,
    ARG_MIN(city, arrival) FILTER (WHERE city IS NOT NULL) AS city, ARG_MIN(zipcode, arrival) AS zipcode, MAX(permit_number) AS latest_permit, ARG_MAX(firm_name, (permit_number, arrival)) AS firm_name FROM contacts c WHERE REGEXP_MATCHES(license, '^[0-9]+$') AND firm_name IS NOT NULL AND role IN ('contractor', 'subcontractor') GROUP BY 1) """


def _pool(spark, d):
    return L.prospect_pool(frame(spark, d, "contacts"), ["contractor", "subcontractor"])


@query("q1_prospect_pool", _POOL + "SELECT license, n_permits, roles, city, zipcode, latest_permit, firm_name FROM pool")
def _(spark, d):
    return _pool(spark, d).drop("state")


_SEG = ", seg AS (SELECT *, CASE CAST(license AS BIGINT) % 3 WHEN 0 THEN 'commercial' WHEN 1 THEN 'unknown' ELSE 'residential' END AS segment, CASE WHEN CAST(license AS BIGINT) % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(CAST(license AS BIGINT) % 90 AS INTEGER)) END AS contacted_at FROM pool) "
_QUAL = "(COALESCE(LOWER(city) IN ('san francisco'), FALSE) OR REGEXP_MATCHES(zipcode, '^941[0-9]{2}$'))"


def _segmented(spark, d):
    p = _pool(spark, d).withColumn("segment", F.expr("CASE CAST(license AS BIGINT) % 3 WHEN 0 THEN 'commercial' WHEN 1 THEN 'unknown' ELSE 'residential' END"))
    p = p.withColumn("contacted_at", F.expr("CASE WHEN CAST(license AS BIGINT) % 4 = 0 THEN timestampadd(DAY, CAST(CAST(license AS BIGINT) % 90 AS INT), timestamp'2024-01-01 00:00:00') END"))
    return L.qualify_prospects(p.withColumn("segment_evidence", F.lit("unknown")).withColumn("created_at", F.col("latest_permit")))


@query("q2_qualify_prospects", _POOL + f"SELECT license, LENGTH(license) BETWEEN 3 AND 10 AND {_QUAL} AS qualified FROM pool")
def _(spark, d):
    return L.qualify_prospects(_pool(spark, d)).select("license", "qualified")


def _ranked(spark, d):
    p = _segmented(spark, d)
    return L.rank_prospects(p, p.where("CAST(license AS BIGINT) % 5 <> 0").selectExpr("license", "n_permits AS n"))


_RANK = _POOL + _SEG + f", ranked AS (SELECT license, firm_name, contacted_at, LENGTH(license) BETWEEN 3 AND 10 AND {_QUAL} AS qualified, CASE WHEN CAST(license AS BIGINT) % 5 <> 0 THEN n_permits ELSE 0 END AS permit_count, CAST(CASE segment WHEN 'commercial' THEN 40 WHEN 'unknown' THEN 15 ELSE 0 END + 3 * LEAST(10, CASE WHEN CAST(license AS BIGINT) % 5 <> 0 THEN n_permits ELSE 0 END) + CASE WHEN contacted_at IS NULL THEN 20 ELSE 0 END AS DOUBLE) AS prospect_rank FROM seg) "


@query("q3_rank_prospects", _RANK + """SELECT r.license, permit_count, prospect_rank, CONCAT_WS('; ', CASE segment WHEN 'commercial' THEN 'segment commercial: +40' WHEN 'unknown' THEN 'segment unknown: +15' ELSE 'segment residential: +0' END,
    CASE WHEN permit_count > 0 THEN CONCAT('permits ', CAST(permit_count AS STRING), ': +', CAST(3 * LEAST(10, permit_count) AS STRING)) END, CASE WHEN r.contacted_at IS NULL THEN 'not contacted yet: +20' END) AS reasons FROM ranked r JOIN seg ON seg.license = r.license""")
def _(spark, d):
    return _ranked(spark, d).select("license", "permit_count", "prospect_rank", F.array_join("rank_reasons", "; ").alias("reasons"))


@query("q4_next_prospects", _RANK + "SELECT license, CAST(place AS INT) AS place, CASE WHEN place = 1 THEN 'next' ELSE 'runner-up' END AS pick FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY prospect_rank DESC, permit_count DESC, firm_name, license) AS place FROM ranked WHERE qualified AND contacted_at IS NULL) WHERE place <= 8")
def _(spark, d):
    return L.next_prospects(_ranked(spark, d), 8).select("license", "place", "pick")


@query(
    "q5_reconcile_prospects",
    """WITH s AS (SELECT CAST(s_suppkey AS STRING) AS license, s_name AS firm_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Oakland' END AS city, 'CA' AS state FROM supplier WHERE s_suppkey % 4 <> 0), b AS (SELECT CAST(s_suppkey AS STRING) AS license, UPPER(s_name) AS firm_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Berkeley' END AS city, CASE WHEN s_suppkey % 5 = 0 THEN 'NV' END AS state FROM supplier WHERE s_suppkey % 4 <> 1)
    SELECT COALESCE(s.license, b.license) AS license, COALESCE(s.firm_name, b.firm_name) AS firm_name, COALESCE(b.city, s.city) AS city, COALESCE(b.state, s.state) AS state,
        CASE WHEN s.license IS NULL THEN 'inserted' WHEN b.license IS NULL THEN 'kept' WHEN (b.city IS NOT NULL AND b.city IS DISTINCT FROM s.city) OR (b.state IS NOT NULL AND b.state IS DISTINCT FROM s.state) THEN 'updated' ELSE 'unchanged' END AS merge_action FROM s FULL JOIN b ON s.license = b.license AND LOWER(s.firm_name) = LOWER(b.firm_name)""",
)
def _(spark, d):
    x = spark.read.parquet(f"{d}/supplier.parquet")
    store = x.where("s_suppkey % 4 <> 0").selectExpr("CAST(s_suppkey AS STRING) AS license", "s_name AS firm_name", "CASE WHEN s_suppkey % 2 = 0 THEN 'Oakland' END AS city", "'CA' AS state")
    new = x.where("s_suppkey % 4 <> 1").selectExpr("CAST(s_suppkey AS STRING) AS license", "UPPER(s_name) AS firm_name", "CASE WHEN s_suppkey % 3 = 0 THEN 'Berkeley' END AS city", "CASE WHEN s_suppkey % 5 = 0 THEN 'NV' END AS state", "1 AS arrival")
    old = x.where("s_suppkey % 4 <> 1").selectExpr("CAST(s_suppkey AS STRING) AS license", "UPPER(s_name) AS firm_name", "'Nowhere' AS city", "'XX' AS state", "0 AS arrival")
    return L.reconcile_prospects(store, new.unionByName(old), ["city", "state"], "arrival")


@query("q6_qualified_queue", _RANK + ", q AS (SELECT r.license, r.contacted_at, p.latest_permit FROM ranked r JOIN pool p ON p.license = r.license WHERE r.qualified) SELECT license FROM q ORDER BY contacted_at NULLS FIRST, latest_permit, license LIMIT 25")
def _(spark, d):
    return L.qualified_queue(_segmented(spark, d), 25).select("license")


@query("q7_apply_segments", _POOL + _SEG + "SELECT license, CASE CAST(license AS BIGINT) % 5 WHEN 0 THEN 'commercial' WHEN 1 THEN 'residential' ELSE segment END AS segment, CASE WHEN CAST(license AS BIGINT) % 5 < 2 THEN 'inferred' ELSE 'unknown' END AS segment_evidence FROM seg")
def _(spark, d):
    p = _segmented(spark, d)
    c = p.selectExpr("license", "CASE CAST(license AS BIGINT) % 5 WHEN 0 THEN 'commercial' WHEN 1 THEN 'residential' ELSE 'unclear' END AS segment")
    return L.apply_segments(p, c).select("license", "segment", "segment_evidence")


@query("q8_firm_variants", CON + "SELECT license, COUNT(DISTINCT firm_name) AS n_raw, COUNT(DISTINCT TRIM(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(firm_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS n_normalised FROM contacts WHERE license IS NOT NULL GROUP BY 1")
def _(spark, d):
    return L.firm_variants(frame(spark, d, "contacts"))
