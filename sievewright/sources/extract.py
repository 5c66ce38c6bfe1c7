"""Sources and sinks: extracts of all-string rows, incremental scans, windows on the filing date, provenance, merges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.columns import instant, text
from .shared import stored


def _numbered(df: DataFrame, step: Column, order: list[str], name: str) -> DataFrame:
    """Adds name: the sum of step over the rows of the file up to and with this one. Sums run within a range of the file
    (block), and what earlier ranges hold is added; a range is a split of the file, so no task has more than one."""
    rows = df.withColumn("_step", step.cast("long"))
    totals = rows.groupBy("file", "block").agg(F.sum("_step").alias("_sum"))
    ahead = totals.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("_sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.sum("_step").over(Window.partitionBy("file", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.withColumn("_own", own).join(ahead, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return met.withColumn(name, F.col("_own") + F.col("_ahead")).drop("_step", "_own", "_f", "_b", "_ahead")


#: A record begins behind the array's bracket or a comma.
_BEGIN = r"^[\s\x{FEFF}]*[\[,]\s*(?=\{)"


def read_array(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of files that hold one JSON array of flat objects each, read in ranges; every value is a string.

    Files are read up to each closing brace, in parallel ranges. Where a comma and an opening brace follow, a record may
    end; such pieces are parsed where they are. A piece that is no object was cut at a brace within a string, or the
    source cut it off. Such pieces in a row are put together, from left to right, while their quotes are open; what makes an
    object is one, and what closes its quotes without making one, or stands before an object, is rejected as text. So a
    broken object takes nothing else with it.

    An array without objects and an empty file give no rows; objects within a value are strings, lists of several objects
    within a value are not flat and not supported; null and missing values are null.
    """
    schema = StructType([*(StructField(c, StringType()) for c in columns), StructField("_corrupt", StringType())])
    parsed = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    fine = lambda x: x.isNotNull() & x["_corrupt"].isNull()
    bare = lambda t: F.regexp_replace(t, r"^[\s\x{FEFF}]*[\[,]?\s*", "")
    read = spark.read.option("lineSep", "}").text(path)
    part = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    begins = F.col("value").rlike(_BEGIN)
    numbered = _numbered(part, begins, ["id"], "piece")
    # what follows the last brace of a file: the array's end, or the beginning of an object that was cut off
    pieces = numbered.groupBy("file", "piece").agg(F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct("block", "id", "value"))).alias("x"), F.max(F.struct("block", "id")).alias("at"))
    last = pieces.groupBy(F.col("file").alias("_f")).agg(F.max("piece").alias("_last"))
    pieces = pieces.join(last, (F.col("file") == F.col("_f")) & (F.col("piece") == F.col("_last")), "left")
    fragments = F.transform("x", lambda f: f["value"])
    tail = F.when(F.col("_last").isNotNull(), F.element_at(fragments, -1))
    closed = F.when(tail.isNull(), F.concat(F.array_join(fragments, "}"), F.lit("}"))).when(tail.rlike(r"^\s*(\[\s*)?\]?\s*$"), F.concat(F.array_join(F.slice(fragments, 1, F.size(fragments) - 1), "}"), F.when(F.size(fragments) > 1, "}").otherwise(""))).otherwise(F.array_join(fragments, "}"))
    text_of = pieces.select("file", "block", "piece", closed.alias("text")).where(bare(F.col("text")) != "")
    judged = stored(text_of.withColumn("row", parsed(bare(F.col("text")))), "pieces")
    good = fine(F.col("row")) & F.contains("text", F.lit('"'))
    # pieces that are no object, in a row: all have the same number of objects before them
    runs = _numbered(judged.select("file", "block", "piece", good.alias("good"), F.when(~good, F.col("text")).alias("text")), F.col("good"), ["piece"], "run").where(~F.col("good"))
    begun = F.split("text", r'(?=,\s*\{\s*")')  # an object that was cut off ends where the next one begins
    runs = runs.groupBy("file", "run").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", begun.alias("texts")))), lambda x: x["texts"])).alias("texts"))
    quotes = lambda t: F.length(F.regexp_replace(F.regexp_replace(t, r"\\\\.", ""), '[^"]', ""))
    unclosed = lambda t: F.pmod(quotes(t), F.lit(2)) == 1
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")

    sound = lambda t: F.transform(F.array(parsed(bare(t))), fine)[0]  # noqa: E731  # named once, so parsed once

    def step(s: Column, x: Column) -> Column:
        t, alone, odd = x["t"], x["alone"], F.pmod(x["quotes"], F.lit(2)) == 1
        both, opened, whole, broken = F.concat(s["open"], t), s["open"], s["whole"], s["broken"]
        put = lambda o, w, b: F.struct(o.alias("open"), F.concat(whole, w).alias("whole"), F.concat(broken, b).alias("broken"))
        return (
            F.when(opened.isNull() & alone, put(none, F.array(t), nothing)).when(opened.isNull() & odd, put(t, nothing, nothing)).when(opened.isNull(), put(none, nothing, F.array(t)))
            .when(alone & (x["quotes"] > 0), put(none, F.array(t), F.array(opened))).when(sound(both), put(none, F.array(both), nothing))
            .when(unclosed(both), put(both, nothing, nothing)).when(odd, put(t, nothing, F.array(opened))).otherwise(put(none, nothing, F.array(opened, t)))
        )

    seen = runs.select(F.transform("texts", lambda t: F.struct(t.alias("t"), sound(t).alias("alone"), quotes(t).alias("quotes"))).alias("texts"))
    folded = seen.select(F.aggregate("texts", F.struct(none.alias("open"), nothing.alias("whole"), nothing.alias("broken")), step).alias("s"))
    folded = stored(folded, "folded")  # rows and rejected are both read from it
    joined = folded.select(F.explode("s.whole").alias("t")).select(parsed(bare(F.col("t"))).alias("row"))
    rejected = folded.select(F.explode(F.array_compact(F.concat("s.broken", F.array("s.open")))).alias("t")).select(bare(F.col("t")).alias("_corrupt"))
    rows = judged.where(good).select("row").unionByName(joined)
    return rows.select(*(F.col(f"row.{c}").alias(c) for c in columns)), rejected


def read_extract(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON objects, every value read as a string: one array a file, or (multi_line false) one object a
    line; unparseable ones are rejected."""
    if multi_line:
        return read_array(spark, path, columns)
    schema = StructType([*(StructField(c, StringType()) for c in columns), StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # Spark refuses to look at the corrupt column alone, so a data column is always read with it
    read = F.length(F.concat_ws("", *columns)) >= 0
    return rows.where(F.col("_corrupt").isNull() & read).drop("_corrupt"), rows.where(F.col("_corrupt").isNotNull() & read).select("_corrupt")


def extract_counts(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """n_read and n_rejected of an extract."""
    return rows.agg(F.count(F.lit(1)).alias("n_read")).crossJoin(rejected.agg(F.count(F.lit(1)).alias("n_rejected")))


def incremental_scan(df: DataFrame, cursor: str, since, where: Column | None = None) -> DataFrame:
    """Rows strictly after the cursor. The bare column is compared, so the filter reaches the files."""
    rows = df.where(F.col(cursor) > F.lit(since)) if since is not None else df
    return rows if where is None else rows.where(where)


def next_cursor(df: DataFrame, cursor: str) -> DataFrame:
    """The largest cursor of a scan, rows without a key included."""
    return df.agg(F.max(cursor).alias("next_cursor"), F.count(F.lit(1)).alias("n_rows"))


def filed_window(df: DataFrame, filed: str, now: datetime | str, days: int = 180, zone: str | None = None) -> DataFrame:
    """Rows filed after now minus days. With zone, filed is wall time there and so is the cutoff."""
    cutoff = instant(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    if zone:
        cutoff = F.from_utc_timestamp(cutoff, zone)
    return df.where(F.col(filed) > cutoff)


def split_keyless(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rows whose key is blank)."""
    blank = text(F.col(key).cast("string")).isNull()
    return df.where(~blank), df.where(blank)


def pull_related(contacts: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Contacts of exactly these records."""
    return contacts.join(records.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def stamp_provenance(df: DataFrame, source: str, dataset: str, retrieved_at: datetime | str, replayed: bool = False) -> DataFrame:
    """Adds a provenance struct with the source, the dataset, the time of retrieval and whether this is a replay."""
    return df.withColumn("provenance", F.struct(F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), instant(retrieved_at).alias("retrieved_at"), F.lit(replayed).alias("replayed")))


def extract_manifest(sources: dict[str, DataFrame], key: str, window_days: int, main: str, related: str) -> DataFrame:
    """One row per source: rows, window, join key; and how many distinct keys of main the related source covers."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")).select(F.lit(name).alias("source"), "n_rows", "n_keys", F.lit(window_days).alias("window_days"), F.lit(key).alias("join_key")) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    covered = sources[main].select(key).distinct().join(sources[related].select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("covered_keys"))
    return out.crossJoin(F.broadcast(covered))


def merge_snapshot(store: DataFrame, batch: DataFrame, key: str, hash_column: str, observed_at: datetime | str, values: list[str]) -> DataFrame:
    """A new version of the store: batch wins where its hash moved, first_seen_at stays, last_seen_at follows what was seen.

    ``merge_action`` says inserted, updated, unchanged or kept (not in the batch).
    """
    s, b = store.alias("s"), batch.alias("b")
    both = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    seen, known = F.col(f"b.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    moved = seen & ~F.col(f"s.{hash_column}").eqNullSafe(F.col(f"b.{hash_column}"))
    at = instant(observed_at)
    pick = lambda c: F.when(moved, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(
        F.coalesce(f"s.{key}", f"b.{key}").alias(key), pick(hash_column), *(pick(v) for v in values),
        F.coalesce(F.col("s.first_seen_at"), at).alias("first_seen_at"),
        F.when(seen, at).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(~known, "inserted").when(~seen, "kept").when(moved, "updated").otherwise("unchanged").alias("merge_action"),
    )


def append_new(store: DataFrame, batch: DataFrame, key: str | list[str], arrival: str | None = None) -> DataFrame:
    """Rows of the batch whose key the store doesn't have; the first arrival where the batch repeats a key."""
    keys = [key] if isinstance(key, str) else key
    fresh = batch.join(store.select(keys), keys, "left_anti")
    if arrival is None:
        return fresh.dropDuplicates(keys)
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(keys).orderBy(arrival))).where("_n = 1").drop("_n")


def append_events(df: DataFrame, path: str) -> None:
    """Adds decisions to the append-only log: (ts, agent, decision, summary, refs)."""
    df.select("ts", "agent", "decision", "summary", "refs").write.mode("append").parquet(path)
