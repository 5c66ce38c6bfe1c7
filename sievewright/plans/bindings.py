"""How the given tables play the engine's roles: one SQL text per role, for Spark and for the checking engine.

These texts only rename and derive columns (records from orders, contacts from line items, and so on); no operator is
in them. Dialect differences are the few functions of Dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder  # noqa: F401

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
NOW = "2000-06-01 12:00:00"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def array(self, *items: str) -> str:
        inner = ", ".join(items)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def none(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)" if self.spark else "CAST([] AS VARCHAR[])"

    def plus_days(self, ts: str, n: str) -> str:
        return f"timestampadd(DAY, CAST({n} AS INT), {ts})" if self.spark else f"{ts} + to_days(CAST({n} AS INTEGER))"


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _per(key: str, n: int) -> str:
    return f"CAST(FLOOR({key} / {n}.0) AS BIGINT)"


def _zip(n: str) -> str:
    return f"CAST(10000 + ({n}) % 90000 AS STRING)"


def _quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


SCOPES = [
    "Tenant improvement of office space: lighting, power and data", "Reroofing, new membrane and skylight", "Replace water heater and gas line; restroom fixture upgrade",
    "HVAC rooftop unit with ductwork, electrical panel and fire alarm", "New storefront glazing and curtain wall", "Kitchen remodel with hood, sprinkler, ceiling and partition",
    "Non-electric sign, no electrical work", "Seismic girder and joist work", "Generator, transformer and switchgear; elevator lift", "Demo (e) wall, millwork, paint, flooring, security", "Fire sprinkler and strobe, standpipe", "Paint only",
]
REPLIES = ["STOP", "Yes, but too small", "not my trade", "Great, on it!", "who is this", "Don't text me", "no thanks", "ok", "sure", "The end of the week", "", "I'll call"]
TRADE_KEYS = ["electrical", "plumbing", "hvac", "roofing", "fire_protection", "glazing", "general_building"]


def texts(d: Dialect) -> dict[str, str]:
    """Role -> SQL over the tables, named in braces."""
    records = f"""
        SELECT CAST(o.o_orderkey AS STRING) AS permit_number, o.o_orderkey AS arrival, o.o_custkey AS owner_key,
            CASE o.o_orderstatus WHEN 'O' THEN 'issued' WHEN 'P' THEN 'filed' ELSE {_pick('o.o_orderkey', _quoted(['approved', 'complete', 'expired', 'suspend', 'reinstated']))} END AS status,
            CAST(o.o_orderdate AS TIMESTAMP) AS filed_date, CASE WHEN o.o_orderkey % 4 = 0 THEN {d.plus_days('CAST(o.o_orderdate AS TIMESTAMP)', 'o.o_orderkey % 50')} END AS issued_date,
            CASE WHEN o.o_orderkey % 11 <> 0 THEN o.o_totalprice END AS estimated_cost,
            CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice * 2 WHEN o.o_orderkey % 13 = 0 THEN 0.0 WHEN o.o_orderkey % 17 = 0 THEN o.o_totalprice END AS revised_cost,
            CASE c.c_mktsegment WHEN 'BUILDING' THEN 'office' WHEN 'MACHINERY' THEN 'manufacturing' WHEN 'FURNITURE' THEN 'retail sales' WHEN 'AUTOMOBILE' THEN 'auto repairs' ELSE CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE 'apartments' END END AS existing_use,
            CASE WHEN o.o_orderkey % 9 = 0 THEN 'apartments' WHEN o.o_orderkey % 4 = 0 THEN 'office' WHEN o.o_orderkey % 19 = 0 THEN 'vacant lot' END AS proposed_use,
            CASE o.o_orderpriority WHEN '1-URGENT' THEN 'otc alterations permit' WHEN '2-HIGH' THEN 'additions alterations or repairs' WHEN '3-MEDIUM' THEN 'demolitions' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'new construction' END AS permit_type_definition,
            CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN o.o_orderkey % 4 = 0 THEN CONCAT('CA ', {_zip(_per('o.o_custkey', 4))}) WHEN o.o_orderkey % 4 = 1 THEN CONCAT({_zip(_per('o.o_custkey', 4))}, '-1234') ELSE {_zip(_per('o.o_custkey', 4))} END AS zipcode,
            CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE CONCAT({_pick('o.o_orderkey', ["'0'", "'District '", "'Supervisor  District '", "''", "' '"])}, CAST({_per('o.o_custkey', 16)} AS STRING), CASE WHEN o.o_orderkey % 5 = 3 THEN '.0' ELSE '' END) END AS supervisor_district,
            CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE CONCAT(LOWER(n.n_name), CASE WHEN o.o_orderkey % 2 = 0 THEN ' \u2013  ' ELSE ' - ' END, CAST({_per('o.o_custkey', 64)} AS STRING)) END AS neighborhood,
            CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE CONCAT(CAST({_per('o.o_custkey', 16)} % 50 AS STRING), CASE WHEN o.o_orderkey % 3 = 0 THEN '\u2013' ELSE '-' END, '9 Main St') END AS address, CASE WHEN o.o_orderkey % 2 = 0 THEN '1' END AS unit,
            CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE CONCAT({_pick('o.o_orderkey', _quoted(SCOPES))}, CASE WHEN o.o_orderkey % 24 >= 12 THEN ' !' ELSE '' END) END AS description,
            CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST(o.o_orderkey % 27 AS INT) END AS stories_existing, CASE WHEN o.o_orderkey % 7 = 0 THEN CAST(o.o_orderkey % 33 AS INT) END AS stories_proposed,
            CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(o.o_orderkey % 41 AS INT) END AS existing_units, CAST(NULL AS INT) AS proposed_units,
            {_pick('o.o_orderkey', ["'B, A-2'", "'R-2'", 'NULL', "'M/s;M'", "'R3,B'"])} AS existing_occupancy
        FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"""
    contacts = f"""
        SELECT DISTINCT CAST(l.l_orderkey AS STRING) AS permit_number, CAST(l.l_linenumber AS BIGINT) * 1000000000000 + l.l_partkey * 100000 + l.l_suppkey AS arrival,
            {_pick('l.l_linenumber', _quoted(['contractor', 'subcontractor', 'engineer', 'owner']))} AS role,
            CASE WHEN l.l_partkey % 9 = 0 THEN NULL ELSE CONCAT(s.s_name, CASE WHEN l.l_partkey % 5 = 0 THEN ', Inc.' ELSE '' END) END AS firm_name,
            CASE WHEN l.l_suppkey % 7 = 0 THEN NULL WHEN l.l_suppkey % 6 = 0 THEN CONCAT('E', CAST(l.l_suppkey AS STRING)) ELSE CAST(l.l_suppkey + 100 AS STRING) END AS license,
            CASE WHEN l.l_partkey % 4 = 0 THEN CONCAT('Person ', CAST(l.l_partkey AS STRING)) END AS person,
            CASE s.s_nationkey % 3 WHEN 0 THEN 'San Francisco' WHEN 1 THEN 'Oakland' END AS city, 'CA' AS state, CONCAT('941', LPAD(CAST(s.s_nationkey AS STRING), 2, '0')) AS zipcode
        FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey"""
    profiles = f"""
        SELECT c_custkey AS profile_id, c_name AS business_name, {_pick('c_custkey', _quoted(TRADE_KEYS))} AS trade, CAST(50000.0 * (1 + c_custkey % 4) AS DOUBLE) AS min_project_value,
            {_pick('c_custkey', [d.none(), d.array(f"CONCAT({_zip(_per('c_custkey', 4))}, '-9999')", _zip(_per('c_custkey', 4) + ' + 1')), d.none(), d.array(f"CONCAT('CA ', {_zip(_per('c_custkey', 4) + ' + 1')})")])} AS territory_zips,
            CASE WHEN c_custkey = 0 THEN {d.none()} ELSE {_pick('c_custkey', [d.array(f"CONCAT('District ', CAST({_per('c_custkey', 16)} AS STRING))"), d.none(), d.array(f"CONCAT('00', CAST({_per('c_custkey', 16)} AS STRING))", f"CONCAT(n_name, ' \u2014 ', CAST({_per('c_custkey', 64)} AS STRING))"), d.none()])} END AS territory_districts,
            {d.array("'office'", "'retail sales'")} AS preferred_uses,
            CAST(1.0 + 0.25 * (c_custkey % 3) AS DOUBLE) AS w_fit, CAST(1.0 AS DOUBLE) AS w_demand, CAST(1.0 - 0.1 * (c_custkey % 2) AS DOUBLE) AS w_timing, CAST(1.0 AS DOUBLE) AS w_value, CAST(0.5 + 0.5 * (c_custkey % 3) AS DOUBLE) AS w_evidence
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""
    opportunities = f"""
        SELECT o_orderkey AS opportunity_id, o_orderkey AS candidate_id, o_custkey % 40 AS customer_id, CAST(o_orderkey AS STRING) AS permit_number, CAST(o_orderkey * 37 % 101 AS INT) AS score,
            {_pick('o_orderkey', _quoted(['delivered', 'archived', 'pending']))} AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at,
            CASE WHEN o_orderkey % 3 = 0 THEN {d.plus_days('CAST(o_orderdate AS TIMESTAMP)', 'o_orderkey % 20')} END AS delivered_at,
            CASE WHEN o_orderkey % 3 = 0 THEN {_pick('o_orderkey', ["'good'", "'too_small'", 'NULL', "'wrong_scope'", "'good'"])} END AS feedback
        FROM {{orders}}"""
    log = f"""
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type AS agent, {_pick('event_id', _quoted(['allocation.set', 'weights.applied', 'candidate.rejected', 'weights.noop', 'lead.delivered']))} AS decision,
            CONCAT('Decision {chr(8212)} on  ', CAST(user_id AS STRING), CASE WHEN event_id % 7 = 0 THEN REPEAT(' long text', 60) ELSE '' END) AS summary, CAST(event_id * 7 % 3000 AS STRING) AS ref_opportunity,
            CASE WHEN event_id % 5 = 0 THEN {_pick('event_id', _quoted(['office', 'retail sales', 'manufacturing']))} END AS ref_segment
        FROM {{events}}"""
    messages = """
        SELECT event_id, CONCAT('h', CAST(user_id AS STRING)) AS handle, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'opt_out' ELSE 'inbound' END AS kind,
            event_type = 'error' AND event_id % 8 = 0 AND user_id % 3 = 0 AS opt_out
        FROM {events}"""
    queue = """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CONCAT('h', CAST(user_id AS STRING)) AS handle, CASE WHEN event_id % 2 = 0 THEN 'lead' ELSE 'nudge' END AS purpose,
            CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'abandoned' ELSE 'enqueue' END AS action
        FROM {events}"""
    billing = f"""
        SELECT event_id - event_id % 3 AS provider_event, event_id AS arrival, CAST(ts AS TIMESTAMP) AS ts, user_id AS customer_id,
            {_pick('event_id', _quoted(['active', 'trialing', 'past_due', 'unpaid', 'canceled', 'incomplete', 'incomplete_expired', 'paused', 'unheard_of']))} AS provider_status
        FROM {{events}}"""
    replies = f"""
        SELECT conv_id * 1000 + turn AS reply_id, conv_id, turn, {_pick('(conv_id + turn)', _quoted(REPLIES))} AS text, CONCAT({_pick('conv_id', _quoted(['', 'Our agent said: ', 'GPT, robot — ', 'An automatic ']))}, text) AS copy_text
        FROM {{conversations}} WHERE role = 'user'"""
    verdicts = f"""
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS customer_id, user_id * 10 + event_id % 4 AS opportunity_id, {_pick('(event_id * 7)', _quoted(['good', 'too_small', 'wrong_scope', 'good', 'too_small']))} AS verdict
        FROM {{events}} WHERE event_type IN ('click', 'view')"""
    responses = f"SELECT event_id, {_pick('user_id', _quoted(['v1', 'v2', 'v3']))} AS variant_id, {_pick('event_id', _quoted(['trust', 'clarity', 'reply']))} AS question FROM {{events}}"
    previous = "SELECT CAST(p_partkey AS STRING) AS key, p_partkey AS arrival, p_brand AS brand, p_type AS kind, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS size FROM {part} WHERE p_partkey % 10 <> 3"
    current = """
        SELECT CASE WHEN p_partkey % 50 = 7 THEN '' ELSE CAST(p_partkey AS STRING) END AS key, p_partkey AS arrival, CASE WHEN p_partkey % 6 = 0 THEN CONCAT(p_brand, '*') ELSE p_brand END AS brand, p_type AS kind,
            CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END END AS size
        FROM {part} WHERE p_partkey % 10 <> 5"""
    raw = """
        SELECT CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE CONCAT(' ', CAST(o_orderkey AS STRING), ' ') END AS permit_number, CONCAT('r', CAST(o_orderkey AS STRING)) AS record_id,
            CAST(o_orderkey % 900 AS STRING) AS street_number, CASE WHEN o_orderkey % 5 = 0 THEN 'A' END AS street_number_suffix, 'Main' AS street_name, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'St' END AS street_suffix,
            CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '12' END AS unit, CASE WHEN o_orderkey % 8 = 1 THEN 'B' END AS unit_suffix, ' North Beach ' AS neighborhoods_analysis_boundaries,
            CONCAT(' ', UPPER(o_orderstatus), CASE o_orderstatus WHEN 'O' THEN 'PEN' ELSE '' END, ' ') AS status,
            CASE o_orderkey % 6 WHEN 0 THEN CONCAT(SUBSTR(CAST(o_orderdate AS STRING), 1, 10), 'T02:30:00.000') WHEN 1 THEN CONCAT(SUBSTR(CAST(o_orderdate AS STRING), 1, 10), 'T23:00:00Z') WHEN 2 THEN '1999-02-31T00:00:00.000' WHEN 3 THEN 'soon' WHEN 4 THEN SUBSTR(CAST(o_orderdate AS STRING), 1, 10) END AS filed_date,
            CASE o_orderkey % 7 WHEN 0 THEN CONCAT('$', CAST(o_custkey AS STRING), ',000.50') WHEN 1 THEN '1e5' WHEN 2 THEN ' ' WHEN 3 THEN 'NaN' WHEN 4 THEN '-5' ELSE CAST(o_custkey AS STRING) END AS estimated_cost,
            CASE o_orderkey % 5 WHEN 0 THEN '0.0' WHEN 1 THEN CONCAT(CAST(o_custkey AS STRING), '.5') END AS revised_cost,
            CASE o_orderkey % 7 WHEN 0 THEN CONCAT('{"type":"Point","coordinates":[-122.', CAST(400 + o_custkey % 100 AS STRING), ',37.', CAST(700 + o_orderkey % 90 AS STRING), ']}') WHEN 1 THEN CONCAT('{"type":"Point","coordinates":[-222.', CAST(400 + o_custkey % 100 AS STRING), ',37.7]}')
                WHEN 2 THEN 'oops' WHEN 3 THEN '{"type":"Polygon","coordinates":[-122.4,37.7]}' WHEN 4 THEN CONCAT('{"type":"Point","coordinates":[-122.4,97.', CAST(100 + o_custkey % 100 AS STRING), ']}') WHEN 5 THEN CONCAT('{"type":"Point","coordinates":[180,-', CAST(o_custkey % 91 AS STRING), ']}') END AS location,
            CAST(o_orderkey % 12 AS STRING) AS number_of_existing_stories, CASE WHEN o_orderkey % 2 = 0 THEN '3.9' END AS number_of_proposed_stories
        FROM {orders}"""
    rows = "SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag FROM {lineitem}"
    return {k: v for k, v in locals().items() if k not in ("d", "k", "v")}


#: Roles over other roles.
OVER = {"valued": "SELECT *, CASE WHEN COALESCE(revised_cost, 0) > 0 OR COALESCE(estimated_cost, 0) > 0 THEN GREATEST(COALESCE(revised_cost, 0), COALESCE(estimated_cost, 0)) END AS valuation FROM {records}"}


def _protected(sql: str) -> str:
    """JSON braces of literals must survive the filling in of table names."""
    out = sql.replace('{"type"', '{{"type"').replace("]}'", "]}}'")
    return out


def frame(spark: SparkSession, sf_dir: str, role: str, dealt: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A role as a DataFrame; weights, refs and names that only Spark uses are added here. dealt: a role over another adds
    its columns once that one's rows (with these columns only) are dealt out by this key: all of it in one stage is code too
    long for the JVM to compile."""
    if role in OVER:
        below = frame(spark, sf_dir, "records")
        if dealt:
            below = below.select(*(c for c in below.columns if columns is None or c in columns)).repartition(dealt)
        return spark.sql(OVER[role], records=below)
    sql = _protected(texts(Dialect(True))[role])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    out = spark.sql(sql, **used)
    if role == "profiles":
        out = out.withColumn("weights", F.struct(*(F.col(f"w_{c}").cast("double").alias(c) for c in ("fit", "demand", "timing", "value", "evidence")))).withColumn("min_project_value", F.col("min_project_value").cast("double"))
    if role == "log":
        out = out.withColumn("refs", F.create_map(F.lit("opportunity"), F.col("ref_opportunity"), F.lit("segment"), F.col("ref_segment")))
    return out


def with_roles(*roles: str) -> str:
    """A WITH clause of the roles for the checking engine, without the final select."""
    found = texts(Dialect(False))
    wanted = dict.fromkeys(r for role in roles for r in (("records", role) if role in OVER else (role,)))
    parts = []
    for role in wanted:
        sql = OVER[role].replace("{records}", "records") if role in OVER else _protected(found[role])
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
        parts.append(f"{role} AS ({sql.replace('{{', '{').replace('}}', '}')})")
    return "WITH " + ", ".join(parts) + " "
