"""Raw string records to typed ones: text, numbers, addresses, agency times, coordinates, valuation, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column, integer, number, text, vocabulary

#: Values fixed by the agency: wall times are in this zone.
AGENCY_ZONE = "America/Los_Angeles"
TIME_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
#: Order of normalised columns; also the columns that the content hash covers.
NORMALIZED = (
    "permit_number", "record_id", "address", "neighborhood", "supervisor_district", "zipcode", "latitude", "longitude", "status", "status_date", "filed_date",
    "issued_date", "approved_date", "completed_date", "description", "permit_type_definition", "existing_use", "proposed_use", "existing_occupancy",
    "proposed_occupancy", "stories_existing", "stories_proposed", "valuation", "valuation_source", "data_as_of", "data_loaded_at",
)


def assemble_address(house: Column | str, suffix: Column | str, street: Column | str, kind: Column | str, unit: Column | str, unit_suffix: Column | str) -> Column:
    """'12A Main St Unit 3B': number and suffix glued; a unit of zero stands for none."""
    first = F.concat(text(house), F.coalesce(text(suffix), F.lit("")))
    site = F.concat_ws(" ", first, text(street), text(kind))
    number_ = F.when(~F.coalesce(text(unit), F.lit("0")).rlike("^0+$"), text(unit))
    place = F.concat(F.coalesce(number_, F.lit("")), F.coalesce(text(unit_suffix), F.lit("")))
    whole = F.when(place != "", F.concat(site, F.lit(" Unit "), place)).otherwise(site)
    return F.when(site != "", whole)


def agency_timestamp(c: Column | str, zone: str = AGENCY_ZONE) -> Column:
    """An instant: text without an offset is wall time in zone, text with one keeps it; anything else is null."""
    value = text(c)
    return _instant_of(F.when(value.rlike(TIME_PATTERN), value), zone)


def _instant_of(checked: Column, zone: str) -> Column:
    """The instant of a text that fits TIME_PATTERN."""
    offset = checked.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & checked.contains(":")
    wall = F.to_utc_timestamp(F.replace(checked, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz").cast("timestamp"), zone)
    return F.when(offset, checked.try_cast("timestamp")).otherwise(wall)


def floating_literal(c: Column, zone: str = AGENCY_ZONE) -> Column:
    """The wall time of an instant, without offset."""
    return F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def coordinates(c: Column | str) -> tuple[Column, Column]:
    """(latitude, longitude) of a GeoJSON point [lon, lat]; both in range, or neither."""
    point = F.from_json(as_column(c), "type STRING, coordinates ARRAY<DOUBLE>")
    lon, lat = F.get(point["coordinates"], F.lit(0)), F.get(point["coordinates"], F.lit(1))
    good = (point["type"] == "Point") & lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(good, lat), F.when(good, lon)


def resolve_valuation(revised: Column, estimated: Column) -> tuple[Column, Column]:
    """(value, which column it came from): the larger positive one; on a tie the revised one."""
    r, e = F.when(revised > 0, revised), F.when(estimated > 0, estimated)
    source = F.when(r.isNotNull() & (e.isNull() | (r >= e)), "revised_cost").when(e.isNotNull(), "estimated_cost")
    return F.greatest(r, e), source


def occupancy_letters(c: Column | str) -> Column:
    """Distinct leading letters of a list like 'B, A-2/M'."""
    parts = F.transform(F.split(F.coalesce(as_column(c), F.lit("")), "[,/;]"), lambda p: F.upper(F.substring(F.regexp_replace(p, r"(?U)^\s+", ""), 1, 1)))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike("^[A-Z]$")))


def canonical_json(columns: dict[str, str], exclude: tuple[str, ...] = ()) -> Column:
    """JSON of the columns (name: Spark type) in the order of their names, the same whatever the session's settings: times
    are microseconds since 1970, fractions have six decimals, and a null is written as null."""
    plain = {"timestamp": lambda c: F.unix_micros(c), "double": lambda c: F.when(~F.isnan(c), c).try_cast("decimal(38,6)")}
    return F.to_json(F.struct(*(plain.get(kind, lambda c: c)(F.col(n)).alias(n) for n, kind in sorted(columns.items()) if n not in exclude)), {"ignoreNullFields": "false"})


def content_hash(columns: dict[str, str], exclude: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical JSON of the columns. A null counts: a value that goes or comes changes the hash."""
    return F.sha2(canonical_json(columns, exclude), 256)


def normalize_records(raw: DataFrame, zone: str = AGENCY_ZONE, exclude_from_hash: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed records with content_hash, rows without a key). Only a missing key rejects a row; missing columns are null.

    All texts are trimmed in one projection and read in the next, so no expression is worked out twice.
    """
    have = {c: t for c, t in raw.dtypes}
    trimmed = raw.select(*(text(c).alias(c) if t == "string" else F.col(c) for c, t in have.items())).where(F.col("permit_number").isNotNull())
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    dated = ("status_date", "filed_date", "issued_date", "approved_date", "completed_date", "data_as_of", "data_loaded_at")
    read = trimmed.withColumns({"_place": F.array(*coordinates(col("location"))), "_revised": number(col("revised_cost")), "_estimated": number(col("estimated_cost")), **{f"_{d}": F.when(col(d).rlike(TIME_PATTERN), col(d)) for d in dated}})
    value, source = resolve_valuation(F.col("_revised"), F.col("_estimated"))
    typed = {
        "permit_number": col("permit_number"), "record_id": col("record_id"),
        "address": assemble_address(col("street_number"), col("street_number_suffix"), col("street_name"), col("street_suffix"), col("unit"), col("unit_suffix")),
        "neighborhood": col("neighborhoods_analysis_boundaries"), "supervisor_district": col("supervisor_district"), "zipcode": col("zipcode"),
        "latitude": F.get("_place", F.lit(0)), "longitude": F.get("_place", F.lit(1)), "status": F.lower(col("status")), **{d: _instant_of(F.col(f"_{d}"), zone) for d in dated},
        "description": col("description"), "permit_type_definition": F.lower(col("permit_type_definition")),
        "existing_use": F.lower(col("existing_use")), "proposed_use": F.lower(col("proposed_use")),
        "existing_occupancy": col("existing_occupancy"), "proposed_occupancy": col("proposed_occupancy"),
        "stories_existing": integer(col("number_of_existing_stories")), "stories_proposed": integer(col("number_of_proposed_stories")),
        "valuation": value, "valuation_source": source,
    }
    out = read.select(*(typed[c].alias(c) for c in NORMALIZED))
    return out.withColumn("content_hash", content_hash(dict(out.dtypes), exclude_from_hash)), raw.where(text(F.col("permit_number")).isNull())


def scoring_view(raw: DataFrame, normalized: DataFrame, key: str = "permit_number") -> DataFrame:
    """Normalised records with units, both costs and the last activity of the raw rows."""
    extra = raw.select(text(key).alias(key), integer("existing_units").alias("existing_units"), integer("proposed_units").alias("proposed_units"), number("estimated_cost").alias("estimated_cost"), number("revised_cost").alias("revised_cost"), agency_timestamp("last_permit_activity_date").alias("last_activity"))
    return normalized.join(extra, key, "left")


def shortlist_view(raw: DataFrame, normalized: DataFrame, key: str = "permit_number") -> DataFrame:
    """Normalised records with the unit and both costs of the raw rows."""
    extra = raw.select(text(key).alias(key), text("unit").alias("unit"), number("estimated_cost").alias("estimated_cost"), number("revised_cost").alias("revised_cost"))
    return normalized.join(extra, key, "left")


def normalize_contacts(raw: DataFrame) -> DataFrame:
    """Contacts with the firm's city, state and zip before the agent's own, a person's name and the role in lower case."""
    zip5 = lambda c: F.nullif(F.regexp_extract(F.coalesce(text(c), F.lit("")), r"^\d{5}", 0), F.lit(""))
    return raw.select(
        text("permit_number").alias("permit_number"), vocabulary("role").alias("role"), text("firm_name").alias("firm_name"), text("license1").alias("license"),
        F.nullif(F.concat_ws(" ", text("first_name"), text("last_name")), F.lit("")).alias("person"),
        F.coalesce(text("firm_city"), text("city")).alias("city"), F.coalesce(text("firm_state"), text("state")).alias("state"),
        F.coalesce(zip5("firm_zipcode"), zip5("agent_zipcode")).alias("zipcode"),
    )
