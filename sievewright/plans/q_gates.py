"""Queries over the gate sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import days_since, instant
from ..operators import gates as G
from ..operators import vocab
from .bindings import NOW, frame, with_roles
from .registry import query


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_COM, _RES = _in(vocab.COMMERCIAL_USES), _in(vocab.RESIDENTIAL_USES)


def _n(x: str) -> str:
    return f"TRIM(REGEXP_REPLACE(LOWER(TRANSLATE(COALESCE({x}, ''), '\u2010\u2011\u2012\u2013\u2014\u2015', '------')), '\\s+', ' ', 'g'))"


def _z(x: str) -> str:
    return f"CASE WHEN LENGTH(REGEXP_REPLACE({x}, '[^0-9]', '', 'g')) >= 5 THEN LEFT(REGEXP_REPLACE({x}, '[^0-9]', '', 'g'), 5) ELSE '' END"


def _d(x: str) -> str:
    return f"REGEXP_REPLACE(REGEXP_REPLACE({_n(x)}, '^(supervisor )?district ', ''), '^0+([0-9]+)$', '\\1')"


#: Records and profiles with normal forms; pairs are met on places, and gated have all five gates.
_NORMAL = f""", rv AS (SELECT *, {_z('zipcode')} AS nz, {_d('supervisor_district')} AS nd, {_n('neighborhood')} AS nn FROM valued),
    pv AS (SELECT *, LIST_FILTER(LIST_TRANSFORM(territory_zips, lambda x: {_z('x')}), lambda x: x <> '') AS tz, LIST_FILTER(LIST_TRANSFORM(territory_districts, lambda x: {_d('x')}), lambda x: x <> '') AS td FROM profiles)"""
_G1 = "(LEN(tz) + LEN(td) = 0 OR (nz <> '' AND LIST_CONTAINS(tz, nz)) OR (nd <> '' AND LIST_CONTAINS(td, nd)) OR (nn <> '' AND LIST_CONTAINS(td, nn)))"
_GATED = f"""SELECT *, use_class <> 'residential' AS g4, COALESCE(value >= min_project_value, FALSE) AS g5 FROM
    (SELECT v.*, p.* EXCLUDE (profile_id), p.profile_id, {_G1} AS g1, {_n('status')} IN {_in(vocab.ACTIVE_STATUSES)} AS g2, COALESCE(permit_type_definition NOT IN {_in(vocab.EXCLUDED_TYPES)}, TRUE) AS g3,
        CASE WHEN COALESCE(existing_use IN {_COM}, FALSE) OR COALESCE(proposed_use IN {_COM}, FALSE) THEN 'commercial' WHEN COALESCE(existing_use IN {_RES}, FALSE) OR COALESCE(proposed_use IN {_RES}, FALSE) THEN 'residential'
            WHEN existing_use IS NULL AND proposed_use IS NULL THEN 'unknown' ELSE 'unclassified' END AS use_class,
        COALESCE(valuation, GREATEST(revised_cost, estimated_cost)) AS value FROM met m JOIN rv v ON v.permit_number = m.permit_number JOIN pv p ON p.profile_id = m.profile_id)"""
_MET = """, met AS (SELECT DISTINCT permit_number, profile_id FROM (SELECT permit_number, 'z' || nz AS place FROM rv WHERE nz <> '' UNION SELECT permit_number, 'd' || nd FROM rv WHERE nd <> '' UNION SELECT permit_number, 'd' || nn FROM rv WHERE nn <> '') s
        JOIN (SELECT profile_id, 'z' || UNNEST(tz) AS place FROM pv UNION SELECT profile_id, 'd' || UNNEST(td) FROM pv) t ON s.place = t.place
        UNION ALL SELECT permit_number, profile_id FROM rv JOIN pv ON LEN(tz) + LEN(td) = 0)"""
PAIRS = with_roles("valued", "profiles") + _NORMAL + _MET + f", gated AS ({_GATED}) "
#: Every record against the profile of its owner and the one after it, whether these have it in their territory or not.
OWNERS = with_roles("valued", "profiles") + _NORMAL + f", met AS (SELECT permit_number, profile_id FROM rv JOIN pv ON profile_id = owner_key OR profile_id = owner_key + 1), gated AS ({_GATED}) "


def _owners(spark, d, **more):
    records = frame(spark, d, "valued").withColumn("profile_id", F.explode(F.array(F.col("owner_key"), F.col("owner_key") + 1)))
    return G.five_gates(records.join(frame(spark, d, "profiles"), "profile_id"), NOW, **more)


for _i, _name in enumerate(("g1_geography", "g2_status", "g3_project_type", "g4_commercial_use", "g5_cost_floor")):
    query(_name, OWNERS + f"SELECT permit_number, profile_id, g{_i + 1} AS passed FROM gated")(lambda spark, d, n=_i: _owners(spark, d).select("permit_number", "profile_id", F.col("outcomes")[n]["passed"].alias("passed")))


_DAYS = f"CAST(FLOOR((EPOCH_US(TIMESTAMP '{NOW}') - EPOCH_US(filed_date)) / 86400000000.0) AS INT)"
_WHY2 = f"CONCAT(CASE WHEN status IN {_in(vocab.ACTIVE_STATUSES)} THEN 'open' ELSE 'closed' END, ': status=', status, '; age=', CAST({_DAYS} AS STRING), 'd')"


@query("g2_status_reason", with_roles("records") + f"SELECT permit_number, {_WHY2} AS reason FROM records")
def _(spark, d):
    rows = frame(spark, d, "records")
    return rows.select("permit_number", G.status_gate(F.col("status"), days_since(instant(NOW), F.col("filed_date")))["reason"].alias("reason"))


def dealt(spark, d):
    """Records with what the gates read, dealt out by key."""
    return frame(spark, d, "valued", "permit_number", G.READ)


def _sheet(spark, d, **more):
    return G.gate_sheet(dealt(spark, d), frame(spark, d, "profiles"), NOW, deal=False, **more)


def _counts(spark, d):
    return G.survivor_counts(dealt(spark, d), frame(spark, d, "profiles"), NOW, deal=False)


# The near-duplicate fold in SQL: the first arrival of each bucket, then a recursive walk over each site's buckets.
_FOLD = PAIRS + """, site AS (SELECT profile_id, permit_number, arrival, CASE WHEN address IS NULL OR description IS NULL THEN CONCAT('r', permit_number) ELSE CONCAT_WS('|', TRANSLATE(address, '\u2013', '-'), COALESCE(unit, ''), TRIM(REGEXP_REPLACE(LOWER(description), '[^a-z0-9]+', ' ', 'g'))) END AS s,
        CAST(FLOOR(EPOCH_US(filed_date) / (86400000000.0 * 45)) AS BIGINT) AS b FROM gated WHERE g1 AND g2 AND g3 AND g4 AND g5),
    firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY profile_id, s ORDER BY arrival) AS k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY profile_id, s, b ORDER BY arrival) AS n FROM site) WHERE n = 1),
    walk AS (SELECT profile_id, s, 0 AS k, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT profile_id, s FROM firsts)
        UNION ALL SELECT w.profile_id, w.s, f.k, CASE WHEN LIST_HAS_ANY(w.taken, [f.b - 1, f.b, f.b + 1]) THEN w.taken ELSE LIST_APPEND(w.taken, f.b) END, CASE WHEN LIST_HAS_ANY(w.taken, [f.b - 1, f.b, f.b + 1]) THEN w.kept ELSE LIST_APPEND(w.kept, f.arrival) END
        FROM walk w JOIN firsts f ON f.profile_id = w.profile_id AND f.s = w.s AND f.k = w.k + 1),
    accepted AS (SELECT profile_id, UNNEST(kept) AS arrival FROM (SELECT profile_id, s, ARG_MAX(kept, k) AS kept FROM walk GROUP BY 1, 2)),
    sheet AS (SELECT g.*, a.arrival IS NOT NULL AS g6, CASE WHEN NOT g1 THEN 'geography' WHEN NOT g2 THEN 'status' WHEN NOT g3 THEN 'project_type' WHEN NOT g4 THEN 'commercial_use' WHEN NOT g5 THEN 'cost_floor' WHEN a.arrival IS NULL THEN 'dedupe' END AS rejected_by
        FROM gated g LEFT JOIN accepted a ON a.profile_id = g.profile_id AND a.arrival = g.arrival) """
_FOLD = _FOLD.replace("WITH ", "WITH RECURSIVE ", 1)


@query("g6_dedupe", _FOLD + "SELECT profile_id, permit_number, NOT g6 AS near_duplicate FROM sheet WHERE g1 AND g2 AND g3 AND g4 AND g5")
def _(spark, d):
    return _sheet(spark, d).where("near_duplicate IS NOT NULL").select("profile_id", "permit_number", "near_duplicate")


@query("g7_gate_sheet", _FOLD + "SELECT profile_id, permit_number, rejected_by, value FROM sheet")
def _(spark, d):
    return _sheet(spark, d).select("profile_id", "permit_number", "rejected_by", "value")


_USD = "CONCAT('$', FORMAT('{{:,}}', CAST(FLOOR({0} + 0.5) AS BIGINT)))".format
_USE = "CASE WHEN existing_use = proposed_use OR proposed_use IS NULL THEN COALESCE(existing_use, '') ELSE CONCAT(COALESCE(existing_use, ''), ' to ', proposed_use) END"


@query(
    "g8_rejection_summary",
    _FOLD + f"""SELECT profile_id, permit_number, CONCAT(permit_number, CASE WHEN rejected_by IS NULL THEN ': all gates passed' ELSE CONCAT(': ', rejected_by, ' [', CASE rejected_by WHEN 'status' THEN {_WHY2} WHEN 'project_type' THEN CONCAT('excluded: type=', permit_type_definition)
        WHEN 'commercial_use' THEN CONCAT('residential: use=', {_USE}) WHEN 'cost_floor' THEN CONCAT(CASE WHEN COALESCE(value, 0) <= 0 THEN 'unpriced' ELSE CONCAT('under: value=', {_USD('value')}) END, '; floor=', {_USD('min_project_value')}) ELSE 'repeat: same site and scope accepted in this window or the next' END, ']') END) AS summary FROM sheet""",
)
def _(spark, d):
    return G.rejection_summary(_sheet(spark, d)).select("profile_id", "permit_number", "summary")


@query(
    "g9_funnel",
    _FOLD + """SELECT p.profile_id, step, gate, CAST(CASE step WHEN 0 THEN (SELECT COUNT(*) FROM records) WHEN 1 THEN COALESCE(s1, 0) WHEN 2 THEN COALESCE(s2, 0) WHEN 3 THEN COALESCE(s3, 0) WHEN 4 THEN COALESCE(s4, 0) WHEN 5 THEN COALESCE(s5, 0) ELSE COALESCE(s6, 0) END AS BIGINT) AS survivors FROM profiles p LEFT JOIN
        (SELECT profile_id, COUNT(*) AS s1, COUNT(*) FILTER (WHERE g2) AS s2, COUNT(*) FILTER (WHERE g2 AND g3) AS s3, COUNT(*) FILTER (WHERE g2 AND g3 AND g4) AS s4,
            COUNT(*) FILTER (WHERE g2 AND g3 AND g4 AND g5) AS s5, COUNT(*) FILTER (WHERE g2 AND g3 AND g4 AND g5 AND g6) AS s6 FROM sheet GROUP BY 1) s ON s.profile_id = p.profile_id,
        (VALUES (0, 'all'), (1, 'geography'), (2, 'status'), (3, 'project_type'), (4, 'commercial_use'), (5, 'cost_floor'), (6, 'dedupe')) g(step, gate)""",
)
def _(spark, d):
    return G.funnel(_counts(spark, d))


@query("g10_rejections_by_gate", _FOLD + """SELECT profile_id, rejected_by, COUNT(*) AS n FROM sheet WHERE rejected_by IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT * FROM (SELECT p.profile_id, 'geography', (SELECT COUNT(*) FROM records) - COUNT(s.permit_number) AS n FROM profiles p LEFT JOIN sheet s ON s.profile_id = p.profile_id GROUP BY 1) WHERE n > 0""")
def _(spark, d):
    return G.rejections_by_gate(_counts(spark, d))


@query("g11_strict_use", OWNERS + f"SELECT permit_number, profile_id, NOT (COALESCE(existing_use IN {_RES}, FALSE) OR COALESCE(proposed_use IN {_RES}, FALSE)) AS passed FROM gated")
def _(spark, d):
    return _owners(spark, d, strict_use=True).select("permit_number", "profile_id", F.col("outcomes")[3]["passed"].alias("passed"))


@query("g1_territory_join", PAIRS + "SELECT permit_number, profile_id FROM gated")
def _(spark, d):
    return G.pair_up(frame(spark, d, "valued"), frame(spark, d, "profiles")).select("permit_number", "profile_id")
