"""Queries over duplicates, snapshots and staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as D
from ..sources.shared import shared_folder, stored
from ..sources.store import KeyedStore
from .bindings import NOW, frame, with_roles
from .q_normalize import PC, _hashed
from .registry import ORACLES, query

_ORDER = "flag DESC, l_shipdate DESC, l_extendedprice DESC, l_suppkey DESC, l_partkey, l_quantity, l_discount, l_tax, l_linestatus"
_RANKED = with_roles("rows") + f", r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS n, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM rows) "


def _collapsed(spark, d):
    return D.canonical_collapse(frame(spark, d, "rows"), ["l_orderkey", "l_linenumber"], [F.col("flag"), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_suppkey")], [F.col(c) for c in ("l_partkey", "l_quantity", "l_discount", "l_tax", "l_linestatus")])


@query("d1_canonical_collapse", _RANKED + "SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag, c - 1 AS collapsed FROM r WHERE n = 1")
def _(spark, d):
    return _collapsed(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", F.col("_collapsed").alias("collapsed"))


@query(
    "d2_duplicate_groups",
    """WITH g AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS group_size, COUNT(DISTINCT l_suppkey) > 1 AS s, COUNT(DISTINCT l_returnflag) > 1 AS f FROM lineitem GROUP BY 1, 2)
    SELECT group_size, COUNT(*) AS n_groups, CAST(SUM(group_size - 1) AS BIGINT) AS surplus_rows, COUNT(*) FILTER (WHERE s) AS differ_l_suppkey, COUNT(*) FILTER (WHERE f) AS differ_l_returnflag FROM g GROUP BY 1""",
)
def _(spark, d):
    return D.duplicate_groups(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_returnflag"])


_DIFF = PC + """, diff AS (SELECT COALESCE(c.key, p.key) AS key, CASE WHEN p.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'not_observed' ELSE 'changed' END AS status,
    CASE WHEN p.key IS NULL OR c.key IS NULL THEN '' ELSE CONCAT_WS(',', CASE WHEN p.brand IS DISTINCT FROM c.brand THEN 'brand' END, CASE WHEN p.kind IS DISTINCT FROM c.kind THEN 'kind' END, CASE WHEN p.size IS DISTINCT FROM c.size THEN 'size' END) END AS changed_fields,
    COALESCE(c.h, p.h) AS content_hash FROM p FULL JOIN c ON p.key = c.key WHERE p.h IS DISTINCT FROM c.h) """


def _diff(spark, d, **more):
    return D.snapshot_diff(_hashed(frame(spark, d, "previous")), _hashed(frame(spark, d, "current")), "key", "h", ["brand", "kind", "size"], "arrival", NOW, **more)


@query("d3_snapshot_diff", _DIFF + f"SELECT key, status, content_hash, '{NOW}' AS observed FROM diff")
def _(spark, d):
    return _diff(spark, d).select("key", "status", "content_hash", F.col("observed_at").cast("string").alias("observed"))


@query("d3_partial_pull", _DIFF + "SELECT key, status FROM diff WHERE status <> 'not_observed'")
def _(spark, d):
    return _diff(spark, d, report_not_observed=False).select("key", "status")


def _stored_diff(spark, d):
    store = KeyedStore(spark, shared_folder(spark, "store"), "key", 64)
    store.apply(_hashed(frame(spark, d, "previous")), 0, lambda before, new: new, "h")
    return store.diff(_hashed(frame(spark, d, "current")), "h", ["brand", "kind", "size"], NOW)


@query("d3_bucket_diff", _DIFF + f"SELECT key, status, changed_fields, content_hash, '{NOW}' AS observed FROM diff")
def _(spark, d):
    out, _same = _stored_diff(spark, d)
    return out.select("key", "status", F.array_join("changed_fields", ",").alias("changed_fields"), "content_hash", F.col("observed_at").cast("string").alias("observed"))


@query("d4_changed_fields", _DIFF + "SELECT key, changed_fields FROM diff WHERE status = 'changed'")
def _(spark, d):
    return _diff(spark, d).where("status = 'changed'").select("key", F.array_join("changed_fields", ",").alias("changed_fields"))


@query("d5_summarize_deltas", _DIFF + "SELECT s.status, COUNT(diff.key) AS n FROM (VALUES ('added'), ('changed'), ('not_observed')) s(status) LEFT JOIN diff ON diff.status = s.status GROUP BY 1")
def _(spark, d):
    return D.summarize_deltas(_diff(spark, d))


@query("d6_actionable_keys", _DIFF + "SELECT key FROM diff WHERE status IN ('added', 'changed')")
def _(spark, d):
    return D.actionable_keys(_diff(spark, d), "key")


@query("d7_mark_not_observed", _DIFF + "SELECT p.key, CASE WHEN diff.status = 'not_observed' THEN 'not_observed' ELSE 'observed' END AS snapshot_status FROM p LEFT JOIN diff ON p.key = diff.key")
def _(spark, d):
    store = frame(spark, d, "previous").withColumn("snapshot_status", F.lit("observed"))
    return D.mark_not_observed(store, D.deltas_with_status(_diff(spark, d), "not_observed"), "key").select("key", "snapshot_status")


@query(
    "d8_ingest_counts",
    _DIFF + """SELECT (SELECT COUNT(*) FROM current) AS fetched, (SELECT COUNT(*) FROM current WHERE TRIM(key) = '') AS unnormalisable, (SELECT COUNT(*) - COUNT(DISTINCT key) FROM c) AS collapsed,
        COUNT(*) FILTER (WHERE status = 'added') AS added, COUNT(*) FILTER (WHERE status = 'changed') AS changed, (SELECT COUNT(DISTINCT key) FROM c) - COUNT(*) FILTER (WHERE status IN ('added', 'changed')) AS unchanged,
        COUNT(*) FILTER (WHERE status IN ('added', 'changed')) AS written FROM diff""",
)
def _(spark, d):
    current = frame(spark, d, "current")
    collapsed = D.canonical_collapse(current.where("TRIM(key) <> ''"), "key", [F.col("brand")], [F.col("arrival")])
    return D.ingest_counts(current, "key", collapsed, _diff(spark, d))


_SITE = "CASE WHEN address IS NULL OR {0} IS NULL THEN CONCAT('record|', permit_number) ELSE CONCAT_WS('|', 'site', REPLACE(LOWER(address), '\u2013', '-'), COALESCE(LOWER(unit), ''), TRIM(REGEXP_REPLACE(LOWER({0}), '[^a-z0-9]+', ' ', 'g'))) END".format


def _sites(spark, d):
    return frame(spark, d, "records").withColumn("_site", D.site_key(F.col("address"), F.col("unit"), F.lit("same scope"), F.col("permit_number")))


@query(
    "d9_near_duplicate_collapse",
    with_roles("records").replace("WITH ", "WITH RECURSIVE ", 1) + f""", site AS (SELECT permit_number, arrival, {_SITE("'same scope'")} AS s, CAST(FLOOR(EPOCH_US(filed_date) / (86400000000.0 * 45)) AS BIGINT) AS b FROM records),
    firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s ORDER BY arrival) AS k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY s, b ORDER BY arrival) AS n FROM site) WHERE n = 1),
    walk AS (SELECT s, 0 AS k, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT s FROM firsts)
        UNION ALL SELECT w.s, f.k, CASE WHEN LIST_HAS_ANY(w.taken, [f.b - 1, f.b, f.b + 1]) THEN w.taken ELSE LIST_APPEND(w.taken, f.b) END, CASE WHEN LIST_HAS_ANY(w.taken, [f.b - 1, f.b, f.b + 1]) THEN w.kept ELSE LIST_APPEND(w.kept, f.arrival) END
        FROM walk w JOIN firsts f ON f.s = w.s AND f.k = w.k + 1),
    accepted AS (SELECT UNNEST(kept) AS arrival FROM (SELECT s, ARG_MAX(kept, k) AS kept FROM walk GROUP BY 1))
    SELECT permit_number, a.arrival IS NULL AS near_duplicate FROM site LEFT JOIN accepted a ON a.arrival = site.arrival""",
)
def _(spark, d):
    return D.near_duplicate_collapse(_sites(spark, d), [], "_site", F.col("filed_date"), "permit_number", "arrival").select("permit_number", "near_duplicate")


@query("d9_accepted_history", ORACLES["d9_near_duplicate_collapse"])
def _(spark, d):
    # sites are found once, not once a pass and once for the cuts
    rows, history, out = stored(_sites(spark, d).select("permit_number", "arrival", "filed_date", "_site"), "sites"), None, []
    cuts = rows.agg(F.percentile_approx("arrival", F.array(F.lit(1 / 3), F.lit(2 / 3)), 1000).alias("cuts")).first()["cuts"] or []
    drop = sum((F.coalesce(F.col("arrival") > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for i in range(3):  # three passes, each given what the ones before accepted
        judged = stored(D.near_duplicate_collapse(rows.where(drop == i), [], "_site", F.col("filed_date"), "permit_number", "arrival", accepted=history), "judged")
        history = stored(D.accepted_buckets(judged, [], "_site", F.col("filed_date"), accepted=history), "accepted")
        out.append(judged.select("permit_number", "near_duplicate"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d10_site_key", with_roles("records") + f"SELECT permit_number, SHA256({_SITE('description')}) AS site FROM records")
def _(spark, d):
    return frame(spark, d, "records").select("permit_number", D.site_key(F.col("address"), F.col("unit"), F.col("description"), F.col("permit_number")).alias("site"))


def _staging(spark, d):
    return frame(spark, d, "records").withColumn("released", F.col("arrival") % 3 == 0)


@query("d11_due_batch", with_roles("records") + f"SELECT permit_number, CAST(filed_date AS STRING) AS filed FROM records WHERE filed_date <= TIMESTAMP '{NOW}' AND arrival % 3 <> 0 ORDER BY filed_date, permit_number LIMIT 50")
def _(spark, d):
    return D.due_batch(_staging(spark, d), "filed_date", "released", "permit_number", NOW, 50).select("permit_number", F.col("filed_date").cast("string").alias("filed"))


@query(
    "d12_staging_progress",
    with_roles("records") + "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE arrival % 3 = 0) AS released, COUNT(*) FILTER (WHERE arrival % 3 <> 0) AS pending, CAST(MIN(filed_date) FILTER (WHERE arrival % 3 <> 0) AS STRING) AS next_due FROM records",
)
def _(spark, d):
    return D.staging_progress(_staging(spark, d), "filed_date", "released").withColumn("next_due", F.col("next_due").cast("string"))


@query("d13_staging_plan", _RANKED + "SELECT COUNT(*) FILTER (WHERE l_tax > 0) AS n_dated, COUNT(*) FILTER (WHERE l_tax <= 0) AS n_undatable, CAST(MIN(l_shipdate) FILTER (WHERE l_tax > 0) AS STRING) AS earliest, CAST(MAX(l_shipdate) FILTER (WHERE l_tax > 0) AS STRING) AS latest FROM r WHERE n = 1")
def _(spark, d):
    plan = D.staging_plan(_collapsed(spark, d), F.when(F.col("l_tax") > 0, F.col("l_shipdate")))
    return plan.withColumn("earliest", F.col("earliest").cast("string")).withColumn("latest", F.col("latest").cast("string"))
