"""Queries over sources and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import normalize as N
from ..sources import extract as S
from ..sources.store import KeyedStore
from .bindings import NOW, frame, shared_folder, with_roles
from .registry import query

RAW, REC = with_roles("raw"), with_roles("records")
TRIM = "NULLIF(REGEXP_REPLACE({0}, '^\\s+|\\s+$', '', 'g'), '')".format


#: A value full of what records are cut at.
_NOTE = 'a},{"b":"c"} ,{ d \\ "quoted" ] [x'


def _arrays(spark, d):
    """The raw table as JSON arrays of some thousand objects a file, every fiftieth object cut off within a name or value."""
    raw, folder = frame(spark, d, "raw").withColumn("note", F.when(F.substring("record_id", 2, 20).cast("long") % 7 == 0, F.lit(_NOTE))), shared_folder(spark, "extract")
    number, line = F.substring("record_id", 2, 20).cast("long"), F.to_json(F.struct("*"))
    one = F.when(number % 50 == 7, F.substring(line, 1, 30)).otherwise(line)
    files = max(1, raw.count() // 5000)
    lists = raw.groupBy(F.pmod(F.xxhash64("record_id"), F.lit(files)).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n "), F.lit("]\n")).alias("value"))
    lists.repartition(files, "file").write.partitionBy("file").text(folder)
    return S.read_extract(spark, folder, raw.columns)


@query("s1_read_extract", RAW + f"""SELECT record_id, status, location, CASE WHEN CAST(SUBSTR(record_id, 2) AS BIGINT) % 7 = 0 THEN '{_NOTE}' END AS note FROM raw WHERE CAST(SUBSTR(record_id, 2) AS BIGINT) % 50 <> 7""")
def _(spark, d):
    rows, _rejected = _arrays(spark, d)
    return rows.select("record_id", "status", "location", "note")


@query("s1_extract_counts", RAW + "SELECT COUNT(*) FILTER (WHERE CAST(SUBSTR(record_id, 2) AS BIGINT) % 50 <> 7) AS n_read, COUNT(*) FILTER (WHERE CAST(SUBSTR(record_id, 2) AS BIGINT) % 50 = 7) AS n_rejected FROM raw")
def _(spark, d):
    return S.extract_counts(*_arrays(spark, d))


@query("s1_read_lines", RAW + "SELECT record_id, status, location FROM raw WHERE CAST(SUBSTR(record_id, 2) AS BIGINT) % 50 <> 7")
def _(spark, d):
    raw, folder = frame(spark, d, "raw"), shared_folder(spark, "extract")
    line = F.to_json(F.struct("*"))
    broken = F.substring("record_id", 2, 20).cast("long") % 50 == 7  # lines that were cut off
    raw.select(F.when(broken, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(folder)
    rows, _rejected = S.read_extract(spark, folder, raw.columns, multi_line=False)
    return rows.select("record_id", "status", "location")


@query("s10_append_events", with_roles("log") + "SELECT ts, agent, decision, summary, ref_opportunity, ref_segment FROM log")
def _(spark, d):
    log, folder = frame(spark, d, "log"), shared_folder(spark, "log")
    for half in (0, 1):
        S.append_events(log.where(F.col("event_id") % 2 == half), folder)
    return spark.read.parquet(folder).select("ts", "agent", "decision", "summary", F.col("refs")["opportunity"].alias("ref_opportunity"), F.col("refs")["segment"].alias("ref_segment"))


@query("s2_incremental_scan", "SELECT event_id, user_id, value FROM events WHERE event_id > 400 AND event_type = 'view'")
def _(spark, d):
    return S.incremental_scan(spark.read.parquet(f"{d}/events.parquet"), "event_id", 400, F.col("event_type") == "view").select("event_id", "user_id", "value")


@query("s2_next_cursor", "SELECT MAX(event_id) AS next_cursor, COUNT(*) AS n_rows FROM events WHERE event_id > 400")
def _(spark, d):
    return S.next_cursor(S.incremental_scan(spark.read.parquet(f"{d}/events.parquet"), "event_id", 400), "event_id")


@query("s3_filed_window", REC + f"SELECT permit_number, CAST(filed_date AS STRING) AS filed FROM records WHERE filed_date > TIMESTAMP '{NOW}' - INTERVAL 180 DAY")
def _(spark, d):
    return S.filed_window(frame(spark, d, "records"), "filed_date", NOW).select("permit_number", F.col("filed_date").cast("string").alias("filed"))


@query("s4_split_keyless", RAW + "SELECT 'keyed' AS part, COUNT(*) AS n FROM raw WHERE TRIM(permit_number) <> '' UNION ALL SELECT 'quarantine', COUNT(*) FROM raw WHERE TRIM(permit_number) = ''")
def _(spark, d):
    good, bad = S.split_keyless(frame(spark, d, "raw"), "permit_number")
    return good.agg(F.lit("keyed").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit("quarantine").alias("part"), F.count(F.lit(1)).alias("n")))


@query("s5_pull_related", with_roles("records", "contacts") + "SELECT c.permit_number, c.arrival, c.role FROM contacts c WHERE EXISTS (SELECT 1 FROM records r WHERE r.permit_number = c.permit_number AND r.status = 'issued')")
def _(spark, d):
    return S.pull_related(frame(spark, d, "contacts"), frame(spark, d, "records").where("status = 'issued'"), "permit_number").select("permit_number", "arrival", "role")


@query("s6_stamp_provenance", REC + f"SELECT permit_number, 'agency' AS source, 'permits' AS dataset, '{NOW}' AS retrieved_at, TRUE AS replayed FROM records")
def _(spark, d):
    p = S.stamp_provenance(frame(spark, d, "records"), "agency", "permits", NOW, True)
    return p.select("permit_number", "provenance.source", "provenance.dataset", F.col("provenance.retrieved_at").cast("string").alias("retrieved_at"), "provenance.replayed")


@query(
    "s7_extract_manifest",
    with_roles("records", "contacts") + """, cov AS (SELECT COUNT(DISTINCT r.permit_number) AS covered_keys FROM records r JOIN contacts c ON r.permit_number = c.permit_number)
    SELECT s.*, CAST(180 AS INT) AS window_days, 'permit_number' AS join_key, covered_keys FROM (SELECT 'permits' AS source, COUNT(*) AS n_rows, COUNT(DISTINCT permit_number) AS n_keys FROM records UNION ALL SELECT 'contacts', COUNT(*), COUNT(DISTINCT permit_number) FROM contacts) s, cov""",
)
def _(spark, d):
    return S.extract_manifest({"permits": frame(spark, d, "records"), "contacts": frame(spark, d, "contacts")}, "permit_number", 180, "permits", "contacts")


def _hashed(df):
    return df.where("TRIM(key) <> ''").withColumn("h", F.sha2(F.concat_ws("|", "brand", "kind", F.col("size").cast("string")), 256))


_HASH = "SHA256(CONCAT_WS('|', brand, kind, CAST(size AS STRING)))"
PC = with_roles("previous", "current") + f", p AS (SELECT *, {_HASH} AS h FROM previous WHERE TRIM(key) <> ''), c AS (SELECT *, {_HASH} AS h FROM current WHERE TRIM(key) <> '') "


@query(
    "s8_merge_snapshot",
    PC + f"""SELECT COALESCE(p.key, c.key) AS key, CASE WHEN c.key IS NOT NULL THEN c.h ELSE p.h END AS h, CASE WHEN c.key IS NOT NULL THEN c.brand ELSE p.brand END AS brand,
        CASE WHEN p.key IS NULL THEN '{NOW}' ELSE '2000-01-01 00:00:00' END AS first_seen, CASE WHEN c.key IS NOT NULL THEN '{NOW}' ELSE '2000-01-01 00:00:00' END AS last_seen,
        CASE WHEN p.key IS NULL THEN 'inserted' WHEN c.key IS NULL THEN 'kept' WHEN p.h <> c.h THEN 'updated' ELSE 'unchanged' END AS merge_action FROM p FULL JOIN c ON p.key = c.key""",
)
def _(spark, d):
    store = _hashed(frame(spark, d, "previous")).withColumn("first_seen_at", C.instant("2000-01-01 00:00:00")).withColumn("last_seen_at", C.instant("2000-01-01 00:00:00"))
    out = S.merge_snapshot(store, _hashed(frame(spark, d, "current")), "key", "h", NOW, ["brand"])
    return out.select("key", "h", "brand", F.col("first_seen_at").cast("string").alias("first_seen"), F.col("last_seen_at").cast("string").alias("last_seen"), "merge_action")


@query("s8_keyed_store", PC + "SELECT COALESCE(p.key, c.key) AS key, CASE WHEN c.key IS NOT NULL THEN c.h ELSE p.h END AS h, CASE WHEN c.key IS NOT NULL THEN c.brand ELSE p.brand END AS brand FROM p FULL JOIN c ON p.key = c.key")
def _(spark, d):
    store = KeyedStore(spark, shared_folder(spark, "store"), "key")
    current = _hashed(frame(spark, d, "current"))
    drops = [_hashed(frame(spark, d, "previous")), current.where("arrival % 2 = 0"), current.where("arrival % 2 = 1"), current.where("arrival % 2 = 1")]

    def merge(before, new):
        before = new.limit(0).withColumns({c: F.lit(None).cast("timestamp") for c in ("first_seen_at", "last_seen_at")}) if before is None else before
        return S.merge_snapshot(before, new, "key", "h", NOW, ["brand"])

    for version, rows in zip((0, 1, 2, 2), drops, strict=True):  # the last drop comes twice
        store.apply(rows, version, merge, "h")
    return store.read().select("key", "h", "brand")


@query("s9_append_new", PC + "SELECT key, brand FROM c WHERE key NOT IN (SELECT key FROM p)")
def _(spark, d):
    return S.append_new(frame(spark, d, "previous"), frame(spark, d, "current").where("TRIM(key) <> ''"), "key", "arrival").select("key", "brand")


@query("n1_text_vocabulary", RAW + f"SELECT record_id, {TRIM('neighborhoods_analysis_boundaries')} AS place, LOWER({TRIM('status')}) AS status, {TRIM('street_suffix')} AS suffix FROM raw")
def _(spark, d):
    return frame(spark, d, "raw").select("record_id", C.text("neighborhoods_analysis_boundaries").alias("place"), C.vocabulary("status").alias("status"), C.text("street_suffix").alias("suffix"))


_BARE = "REGEXP_REPLACE({0}, '[$,\\s]', '', 'g')".format
_NUM = lambda c: f"CASE WHEN REGEXP_MATCHES({_BARE(c)}, '^-?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN CAST({_BARE(c)} AS DOUBLE) END"


@query("n2_number_integer", RAW + f"SELECT record_id, {_NUM('estimated_cost')} AS estimated, CAST(TRUNC({_NUM('estimated_cost')}) AS INT) AS whole, CAST(TRUNC({_NUM('number_of_proposed_stories')}) AS INT) AS stories FROM raw")
def _(spark, d):
    return frame(spark, d, "raw").select("record_id", C.number("estimated_cost").alias("estimated"), C.integer("estimated_cost").alias("whole"), C.integer("number_of_proposed_stories").alias("stories"))


_ADDRESS = f"""CONCAT(street_number, COALESCE(street_number_suffix, ''), ' ', street_name, COALESCE(' ' || {TRIM('street_suffix')}, ''),
        CASE WHEN CONCAT(CASE WHEN unit = '0' THEN '' ELSE COALESCE(unit, '') END, COALESCE(unit_suffix, '')) = '' THEN '' ELSE CONCAT(' Unit ', CASE WHEN unit = '0' THEN '' ELSE COALESCE(unit, '') END, COALESCE(unit_suffix, '')) END)"""


@query("n3_assemble_address", RAW + f"SELECT record_id, {_ADDRESS} AS address FROM raw")
def _(spark, d):
    return frame(spark, d, "raw").select("record_id", N.assemble_address("street_number", "street_number_suffix", "street_name", "street_suffix", "unit", "unit_suffix").alias("address"))


_INSTANT = """CASE WHEN filed_date IS NULL OR filed_date = 'soon' THEN NULL WHEN filed_date LIKE '%Z' THEN EPOCH_MS(CAST(REPLACE(SUBSTR(filed_date, 1, 19), 'T', ' ') AS TIMESTAMP))
    ELSE EPOCH_MS(TIMEZONE('America/Los_Angeles', TRY_CAST(REPLACE(filed_date, 'T', ' ') AS TIMESTAMP))) END"""


@query("n4_agency_timestamp", RAW + f"SELECT record_id, {_INSTANT} AS filed_ms FROM raw")
def _(spark, d):
    return frame(spark, d, "raw").select("record_id", F.unix_millis(N.agency_timestamp("filed_date")).alias("filed_ms"))


@query("n5_floating_literal", RAW + f"SELECT record_id, STRFTIME(TIMEZONE('America/Los_Angeles', TO_TIMESTAMP(({_INSTANT}) / 1000.0)), '%Y-%m-%dT%H:%M:%S.%g') AS wall FROM raw")
def _(spark, d):
    return frame(spark, d, "raw").select("record_id", N.floating_literal(N.agency_timestamp("filed_date")).alias("wall"))


_POINT = "REGEXP_EXTRACT(location, '\"type\":\"Point\",\"coordinates\":\\[(-?[0-9.]+),(-?[0-9.]+)\\]', {0})".format
_IN_RANGE = f"ABS(TRY_CAST({_POINT(1)} AS DOUBLE)) <= 180 AND ABS(TRY_CAST({_POINT(2)} AS DOUBLE)) <= 90"
_LAT, _LON = (f"CASE WHEN {_IN_RANGE} THEN TRY_CAST({_POINT(i)} AS DOUBLE) END" for i in (2, 1))


@query("n6_coordinates", RAW + f"SELECT record_id, {_LAT} AS lat, {_LON} AS lon FROM raw")
def _(spark, d):
    lat, lon = N.coordinates("location")
    return frame(spark, d, "raw").select("record_id", lat.alias("lat"), lon.alias("lon"))


@query(
    "n7_resolve_valuation",
    REC + """SELECT permit_number, GREATEST(NULLIF(GREATEST(COALESCE(revised_cost, 0), 0), 0), NULLIF(GREATEST(COALESCE(estimated_cost, 0), 0), 0)) AS value,
        CASE WHEN COALESCE(revised_cost, 0) <= 0 AND COALESCE(estimated_cost, 0) <= 0 THEN NULL WHEN COALESCE(revised_cost, 0) >= COALESCE(estimated_cost, 0) THEN 'revised_cost' ELSE 'estimated_cost' END AS source FROM records""",
)
def _(spark, d):
    value, source = N.resolve_valuation(F.col("revised_cost"), F.col("estimated_cost"))
    return frame(spark, d, "records").select("permit_number", value.alias("value"), source.alias("source"))


@query(
    "n8_normalize_records",
    RAW + f"""SELECT TRIM(permit_number) AS permit_number, LOWER(TRIM(status)) AS status, {_INSTANT} AS filed_ms, CAST(number_of_existing_stories AS INT) AS stories_existing,
        GREATEST(CASE WHEN {_NUM('revised_cost')} > 0 THEN {_NUM('revised_cost')} END, CASE WHEN {_NUM('estimated_cost')} > 0 THEN {_NUM('estimated_cost')} END) AS valuation FROM raw WHERE TRIM(permit_number) <> ''""",
)
def _(spark, d):
    good, _rejected = N.normalize_records(frame(spark, d, "raw"))
    return good.select("permit_number", "status", F.unix_millis("filed_date").alias("filed_ms"), "stories_existing", "valuation")


@query("n8_quarantine", RAW + "SELECT record_id FROM raw WHERE TRIM(permit_number) = ''")
def _(spark, d):
    return N.normalize_records(frame(spark, d, "raw"))[1].select("record_id")


_TEXT = "COALESCE('\"' || {0} || '\"', 'null')".format
_FRACTION = "COALESCE(CAST(CAST({0} AS DECIMAL(38, 6)) AS STRING), 'null')".format
_WHOLE = "COALESCE(CAST({0} AS STRING), 'null')".format
#: Every normalised column as the checking engine writes it in JSON; what the raw table lacks is null.
_JSON = {c: "'null'" for c in N.NORMALIZED} | {
    "permit_number": _TEXT("TRIM(permit_number)"), "record_id": _TEXT("record_id"), "address": _TEXT("whole"), "neighborhood": _TEXT("place"), "latitude": _FRACTION("CASE WHEN near THEN lat END"), "longitude": _FRACTION("CASE WHEN near THEN lon END"),
    "status": _TEXT("LOWER(TRIM(status))"), "filed_date": _WHOLE("1000 * ms"), "stories_existing": _WHOLE("s1"), "stories_proposed": _WHOLE("s2"), "valuation": _FRACTION("GREATEST(r, e)"),
    "valuation_source": _TEXT("CASE WHEN r IS NOT NULL AND COALESCE(e <= r, TRUE) THEN 'revised_cost' WHEN e IS NOT NULL THEN 'estimated_cost' END"),
}
_READ = f""", num AS MATERIALIZED (SELECT *, {_ADDRESS} AS whole, {TRIM('neighborhoods_analysis_boundaries')} AS place, TRY_CAST({_POINT(1)} AS DOUBLE) AS lon, TRY_CAST({_POINT(2)} AS DOUBLE) AS lat, {_INSTANT} AS ms, {_NUM('revised_cost')} AS r0, {_NUM('estimated_cost')} AS e0,
    CAST(TRUNC({_NUM('number_of_existing_stories')}) AS INT) AS s1, CAST(TRUNC({_NUM('number_of_proposed_stories')}) AS INT) AS s2 FROM raw WHERE TRIM(permit_number) <> ''),
    typed AS MATERIALIZED (SELECT *, ABS(lon) <= 180 AND ABS(lat) <= 90 AS near, CASE WHEN r0 > 0 THEN r0 END AS r, CASE WHEN e0 > 0 THEN e0 END AS e FROM num) """
_CANONICAL = "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {_JSON[c]}" for c in sorted(N.NORMALIZED)) + " || '}'"


@query("n9_content_hash", RAW + _READ + f"SELECT record_id, SHA256({_CANONICAL}) AS content_hash FROM typed")
def _(spark, d):
    return N.normalize_records(frame(spark, d, "raw"))[0].select("record_id", "content_hash")


@query("n10_scoring_view", RAW + f"SELECT TRIM(permit_number) AS permit_number, {_NUM('estimated_cost')} AS estimated_cost, {_NUM('revised_cost')} AS revised_cost FROM raw WHERE TRIM(permit_number) <> ''")
def _(spark, d):
    raw = frame(spark, d, "raw").withColumns({c: F.lit(None).cast("string") for c in ("existing_units", "proposed_units", "last_permit_activity_date")})
    return N.scoring_view(raw, N.normalize_records(raw)[0]).select("permit_number", "estimated_cost", "revised_cost")


@query("n11_shortlist_view", RAW + f"SELECT TRIM(permit_number) AS permit_number, unit, {_NUM('revised_cost')} AS revised_cost FROM raw WHERE TRIM(permit_number) <> ''")
def _(spark, d):
    raw = frame(spark, d, "raw")
    return N.shortlist_view(raw, N.normalize_records(raw)[0]).select("permit_number", "unit", "revised_cost")


@query(
    "n12_normalize_contacts",
    with_roles("contacts") + "SELECT permit_number, arrival, LOWER(role) AS role, firm_name, license, person, COALESCE(city, 'Daly City') AS city, zipcode FROM contacts",
)
def _(spark, d):
    c = frame(spark, d, "contacts")
    raw = c.select(
        "permit_number", "arrival", F.concat(F.lit(" "), F.upper("role")).alias("role"), "firm_name", F.col("license").alias("license1"), F.split("person", " ")[0].alias("first_name"), F.split("person", " ")[1].alias("last_name"),
        F.col("city").alias("firm_city"), F.lit("Daly City").alias("city"), F.lit("").alias("firm_state"), "state", F.concat("zipcode", F.lit("-0000")).alias("firm_zipcode"), F.lit("94000").alias("agent_zipcode"),
    )
    return N.normalize_contacts(raw.withColumn("permit_number", F.concat_ws("#", "permit_number", F.col("arrival").cast("string")))).select(
        F.split("permit_number", "#")[0].alias("permit_number"), F.split("permit_number", "#")[1].cast("long").alias("arrival"), "role", "firm_name", "license", "person", "city", "zipcode"
    )


@query("n13_occupancy_letters", REC + "SELECT permit_number, CASE permit_number::BIGINT % 5 WHEN 0 THEN 'B,A' WHEN 1 THEN 'R' WHEN 2 THEN '' WHEN 3 THEN 'M,S' ELSE 'R,B' END AS letters FROM records".replace("'M,S'", "'M'"))
def _(spark, d):
    return frame(spark, d, "records").select("permit_number", F.array_join(N.occupancy_letters(F.regexp_replace("existing_occupancy", "/s", "")), ",").alias("letters"))


@query(
    "n14_formats",
    with_roles("valued") + """SELECT permit_number, FORMAT('${:,}', CAST(FLOOR(valuation + 0.5) AS BIGINT)) AS usd,
        CASE WHEN FLOOR(valuation / 50000 * 100 + 0.5) % 100 = 0 THEN CONCAT(CAST(CAST(FLOOR(valuation / 50000 * 100 + 0.5) / 100 AS BIGINT) AS STRING), 'x') ELSE PRINTF('%.2fx', FLOOR(valuation / 50000 * 100 + 0.5) / 100) END AS multiple,
        CASE WHEN valuation >= 1000000 THEN CONCAT('$', REPLACE(PRINTF('%.1f', FLOOR(valuation / 100000 + 0.5) / 10), '.0', ''), 'M') ELSE CONCAT('$', CAST(CAST(FLOOR(valuation / 1000 + 0.5) AS BIGINT) AS STRING), 'k') END AS short FROM valued WHERE valuation IS NOT NULL""",
)
def _(spark, d):
    v = F.col("valuation")
    return frame(spark, d, "valued").where("valuation IS NOT NULL").select("permit_number", C.usd(v).alias("usd"), C.multiple(v / 50000).alias("multiple"), C.project_value(v).alias("short"))


@query("n15_days_since", REC + f"SELECT permit_number, CAST(FLOOR((EPOCH_US(TIMESTAMP '{NOW}') - EPOCH_US(filed_date)) / 86400000000.0) AS INT) AS days FROM records")
def _(spark, d):
    return frame(spark, d, "records").select("permit_number", C.days_since(C.instant(NOW), F.col("filed_date")).alias("days"))
