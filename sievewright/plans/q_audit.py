"""Queries that profile and audit whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as J
from ..operators import gates as G
from ..operators import profile as A
from ..operators import vocab
from .bindings import NOW, frame, with_roles
from .q_gates import _FOLD, _in, dealt
from .registry import query

REC, CON = with_roles("records"), with_roles("contacts")
PCT = "FLOOR(10000.0 * ({0}) / COUNT(*) + 0.5) / 100".format
_COLS = ("status", "revised_cost", "zipcode", "description", "unit")


@query("a1_column_coverage", REC + " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS populated, {PCT(f'COUNT({c})')} AS populated_pct, COUNT(DISTINCT {c}) AS n_distinct FROM records" for c in _COLS))
def _(spark, d):
    return A.column_coverage(frame(spark, d, "records"), list(_COLS))


@query("a1_sketched_coverage", REC + " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS populated, TRUE AS near FROM records" for c in _COLS))
def _(spark, d):
    records = frame(spark, d, "records")
    kept = A.coverage_sketches(records, list(_COLS), F.col("arrival") % 5)  # five drops, their sketches united
    exact = A.column_coverage(records, list(_COLS)).select("column_name", F.col("n_distinct").alias("exact"))
    both = A.distinct_from_sketches(kept).join(exact, "column_name")
    return both.select("column_name", "populated", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.04 * F.col("exact")).alias("near"))


@query("a2_value_distribution", REC + "SELECT status AS value, COUNT(*) AS n, FLOOR(10000.0 * COUNT(*) / (SELECT COUNT(*) FROM records) + 0.5) / 100 AS share_pct FROM records GROUP BY 1")
def _(spark, d):
    return A.value_distribution(frame(spark, d, "records"), "status")


_ROUND = "FLOOR(({0}) * 1000 + 0.5) / 1000".format


def _rounded(df, *names):
    return df.withColumns({n: F.floor(F.col(n) * 1000 + 0.5) / 1000 for n in names})


@query("a3_numeric_profile", with_roles("valued") + f"SELECT COUNT(valuation) AS n, {_ROUND('QUANTILE_CONT(valuation, 0.5)')} AS p50, {_ROUND('QUANTILE_CONT(valuation, 0.9)')} AS p90, {_ROUND('QUANTILE_CONT(valuation, 0.99)')} AS p99, {_ROUND('MAX(valuation)')} AS max, FLOOR(10000.0 * COUNT(*) FILTER (WHERE valuation >= 100000) / COUNT(valuation) + 0.5) / 100 AS at_floor_pct FROM valued")
def _(spark, d):
    return _rounded(A.numeric_profile(frame(spark, d, "valued"), "valuation", 100_000.0), "p50", "p90", "p99", "max")


_DAYS = "(EPOCH_US(issued_date) - EPOCH_US(filed_date)) / 86400000000.0"


@query("a4_duration_profile", REC + f"SELECT COUNT(issued_date) AS n, {_ROUND(f'QUANTILE_CONT({_DAYS}, 0.1)')} AS p10, {_ROUND(f'QUANTILE_CONT({_DAYS}, 0.5)')} AS p50, {_ROUND(f'QUANTILE_CONT({_DAYS}, 0.9)')} AS p90, COUNT(*) FILTER (WHERE {_DAYS} < 0) AS n_negative FROM records")
def _(spark, d):
    return _rounded(A.duration_profile(frame(spark, d, "records"), "filed_date", "issued_date"), "p10", "p50", "p90")


@query("a5_cost_conflicts", REC + "SELECT COUNT(*) FILTER (WHERE revised_cost > estimated_cost) AS revised_higher, COUNT(*) FILTER (WHERE estimated_cost > revised_cost) AS estimated_higher, COUNT(*) FILTER (WHERE revised_cost = estimated_cost) AS equal, COUNT(*) FILTER (WHERE revised_cost = 0 AND estimated_cost > 0) AS revised_zero_estimated_positive, COUNT(*) FILTER (WHERE revised_cost IS NULL OR estimated_cost IS NULL) AS one_missing FROM records")
def _(spark, d):
    return A.cost_conflicts(frame(spark, d, "records"), "revised_cost", "estimated_cost")


def _class(c: str) -> str:
    return f"CASE WHEN {c} IN {_in(vocab.COMMERCIAL_USES)} THEN 'commercial' WHEN {c} IN {_in(vocab.RESIDENTIAL_USES)} THEN 'residential' WHEN {c} IS NULL THEN 'unknown' ELSE 'unclassified' END"


@query("a6_use_conversions", REC + f"SELECT {_class('existing_use')} AS from_class, {_class('proposed_use')} AS to_class, COUNT(*) AS n FROM records GROUP BY 1, 2")
def _(spark, d):
    return A.use_conversions(frame(spark, d, "records"), "existing_use", "proposed_use")


@query("a7_role_coverage", CON + f"SELECT role, COUNT(*) AS n, {PCT('COUNT(license)')} AS license_pct, {PCT('COUNT(firm_name)')} AS firm_pct FROM contacts GROUP BY 1")
def _(spark, d):
    return A.role_coverage(frame(spark, d, "contacts"))


@query("a8_license_shapes", CON + "SELECT REGEXP_REPLACE(REGEXP_REPLACE(license, '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape, REGEXP_EXTRACT(license, '^[A-Z]+') AS prefix, COUNT(*) AS n FROM contacts WHERE license IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return A.license_shapes(frame(spark, d, "contacts"), "license")


@query("a9_date_disagreement", REC + "SELECT 'filed_date' AS column_name, COUNT(*) FILTER (WHERE arrival % 7 <> 0) AS n_compared, COUNT(*) FILTER (WHERE arrival % 7 <> 0 AND arrival % 5 = 0) AS n_different FROM records UNION ALL SELECT 'issued_date', COUNT(*) FILTER (WHERE arrival % 7 <> 0 AND issued_date IS NOT NULL), COUNT(*) FILTER (WHERE arrival % 7 <> 0 AND issued_date IS NOT NULL AND CAST(issued_date AS DATE) <> CAST(filed_date AS DATE) + CASE WHEN arrival % 5 = 0 THEN 1 ELSE 0 END) FROM records")
def _(spark, d):
    day = F.date_format(F.expr("timestampadd(DAY, CASE WHEN arrival % 5 = 0 THEN 1 ELSE 0 END, filed_date)"), "yyyyMMdd")
    rows = frame(spark, d, "records").withColumn("key", F.when(F.col("arrival") % 7 == 0, F.lit("M20-01")).otherwise(F.concat(day, F.lit("17"))))
    return A.date_disagreement(rows, "key", ["filed_date", "issued_date"])


@query(
    "a10_shortlist_profile",
    _FOLD + ", " + with_roles("contacts")[5:] + """, surv AS (SELECT profile_id, permit_number, description FROM sheet WHERE rejected_by IS NULL OR rejected_by = 'dedupe'), c AS (SELECT permit_number, BOOL_OR(role IN ('contractor', 'subcontractor') AND firm_name IS NOT NULL) AS gc, BOOL_OR(REGEXP_MATCHES(firm_name, '00[0-9]*7')) AS firm FROM contacts GROUP BY 1)
    SELECT profile_id, COUNT(*) AS survivors, COUNT(*) FILTER (WHERE c.gc) AS with_contractor, COUNT(*) FILTER (WHERE NOT COALESCE(c.gc, FALSE)) AS without_contractor, COUNT(*) FILTER (WHERE c.firm) AS with_trade_firm, COUNT(*) FILTER (WHERE LOWER(description) LIKE '%electric%') AS with_keyword FROM surv LEFT JOIN c ON c.permit_number = surv.permit_number GROUP BY 1""",
)
def _(spark, d):
    survivors = G.shortlist(frame(spark, d, "valued"), frame(spark, d, "profiles"), NOW, "description")
    contacts = frame(spark, d, "contacts")
    return A.shortlist_profile(survivors, J.general_contractor(contacts, "arrival"), J.trade_firm_named(contacts, "00[0-9]*7"), F.lower("description").contains("electric"))


@query(
    "a11_copy_policy_audit",
    with_roles("replies") + f"""SELECT reply_id, 'banned-language' AS rule, REGEXP_EXTRACT(copy_text, '{vocab.BANNED_COPY}') AS match, CAST(LEN(REGEXP_EXTRACT_ALL(copy_text, '{vocab.BANNED_COPY}')) AS BIGINT) AS n_matches,
        CAST(LENGTH(REGEXP_EXTRACT(copy_text, '(?is)^(.*?){vocab.BANNED_COPY[4:]}', 1)) AS BIGINT) AS first_index FROM replies WHERE REGEXP_MATCHES(copy_text, '{vocab.BANNED_COPY}')
    UNION ALL SELECT reply_id, 'em-dash', '—', CAST(LENGTH(copy_text) - LENGTH(REPLACE(copy_text, '—', '')) AS BIGINT), CAST(STRPOS(copy_text, '—') - 1 AS BIGINT) FROM replies WHERE CONTAINS(copy_text, '—')""",
)
def _(spark, d):
    return A.copy_policy_audit(frame(spark, d, "replies"), "reply_id", "copy_text")


@query("a12_firm_footprint", CON + "SELECT license, COUNT(*) AS n_rows, COUNT(DISTINCT permit_number) AS n_permits, COUNT(*) FILTER (WHERE role = 'contractor') AS n_as_contractor FROM contacts WHERE license IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.firm_footprint(frame(spark, d, "contacts"))


@query("a13_discipline_of_record", CON + "SELECT permit_number, COALESCE(BOOL_OR(role = 'engineer' AND license LIKE 'E%'), FALSE) AS has_discipline FROM contacts GROUP BY 1")
def _(spark, d):
    return A.discipline_of_record(frame(spark, d, "contacts"), "e")


@query("a14_valuation_rank", _FOLD + "SELECT profile_id, permit_number, CAST(r AS INT) AS valuation_rank FROM (SELECT profile_id, permit_number, RANK() OVER (PARTITION BY profile_id ORDER BY value DESC) AS r, ROW_NUMBER() OVER (PARTITION BY profile_id ORDER BY value DESC, permit_number) AS n FROM sheet WHERE rejected_by IS NULL) WHERE n <= 40")
def _(spark, d):
    one, members = G.alike(frame(spark, d, "profiles"))
    survivors = G.accepted_pairs(G.judged(dealt(spark, d), NOW, deal=False), one, vocab.NEAR_DUPLICATE_DAYS, None, "value")
    return G.for_members(A.valuation_rank(survivors, "value", 40).select("profile_id", "permit_number", "valuation_rank"), members)
