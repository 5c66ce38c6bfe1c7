"""WARC archives: written as text records, read back by boundary-chain verification.

Writing: one record per page, HTTP response block, files of a bounded number of records. Of equal payloads the one with
the largest page_id is kept as response; the others become revisit records that refer to it and carry no payload.

Reading: the reader splits files wherever the version line ``WARC/1.0`` occurs, also inside payloads. Every such place is
a candidate; its header says where its successor would begin. Within a split a task follows these pointers by pointer
jumping to where they leave the split; between splits the exits are jumped by joins until nothing new is reached from
the start of the file. Candidates that are not reached are payload: they are glued back to the record they lie in.

Defined results: a null html is an empty payload; a null or multi-line url is written on one line; repeated rows give
records that refer to the same page_id; a null page_id is written empty and read back null; a very long
payload is one record, whose text one task holds when it is read back; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Records of one file at most.
FILE_RECORDS = 2000
#: Groups of equal payloads up to which their table is broadcast (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_GROUPS = 50_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """40 hexadecimal digits as 32 upper-case base32 letters: five digits are four letters."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.lit(_BASE32).substr((F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload.cast("binary")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html) as WARC files into the folder path."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", payload_digest(F.col("html"))).withColumn("size", F.octet_length("html"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = common.written(groups.withColumnsRenamed({"digest": "g_digest", "size": "g_size"}), "payloads")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if small else groups, (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    header = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text(F.col("page_id")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(text(F.col("url")), r"[\r\n]+", " "),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), text(F.col("first_id")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block"), F.lit(END),
    )
    rows.withColumn("block", block).select(F.concat(header, F.col("block")).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _field(name: str) -> Column:
    got = F.regexp_extract("header", rf"(?m)^{name}: ?(.*?)\r?$", 1)
    return F.when(got != "", got)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line, with its place: file, block, place in the block, bytes, header fields, payload
    facts where the record ends with its row, and the raw row where it doesn't."""
    rows = spark.read.option("lineSep", VERSION).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.octet_length("value").cast("long").alias("bytes")
    )
    rows = rows.withColumn("header", F.substring_index("value", END, 1)).withColumn("head", F.octet_length("header").cast("long") + len(END))
    rows = rows.withColumn("length", F.expr("try_cast(nullif(regexp_extract(header, '(?m)^Content-Length: *([0-9]{1,15})\\\\r?$', 1), '') AS BIGINT)"))
    rows = rows.withColumn("needs", F.col("head") + F.col("length") + len(END)).withColumn("whole", F.coalesce(F.col("bytes") == F.col("needs"), F.lit(False)))
    body = F.col("value").substr(F.char_length("header") + len(END) + 1, F.char_length("value") - F.char_length("header") - 2 * len(END))
    rows = rows.withColumn("body", F.when(F.col("whole"), body))
    return _facts(rows).select("file", "block", "at", "bytes", "needs", "whole", "type", "page_id", "refers_to", "declared", "payload_bytes", "digest", F.when(~F.col("whole"), F.col("value")).alias("raw"))


def _facts(rows: DataFrame) -> DataFrame:
    """Fields of the record and of its payload from header and body."""
    http = F.substring_index("body", END, 1)
    payload = F.col("body").substr(F.char_length(http) + len(END) + 1, F.lit(2**31 - 1))
    number = lambda f: F.expr(f"try_cast(nullif(regexp_extract({f}, '<urn:page:(-?[0-9]+)>', 1), '') AS BIGINT)")
    rows = rows.withColumn("type", _field("WARC-Type")).withColumn("_id", F.coalesce(_field("WARC-Record-ID"), F.lit(""))).withColumn("_refers", F.coalesce(_field("WARC-Refers-To"), F.lit("")))
    rows = rows.withColumn("declared", F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", ""))
    rows = rows.withColumn("page_id", number("_id")).withColumn("refers_to", number("_refers")).withColumn("_payload", payload)
    stated = F.regexp_extract(http, r"(?m)^Content-Length: *([0-9]{1,15})\r?$", 1).try_cast("long")
    revisit = F.col("type") == "revisit"
    return rows.withColumn("payload_bytes", F.when(revisit, stated).otherwise(F.octet_length("_payload").cast("long"))).withColumn("digest", F.when(revisit, F.col("declared")).otherwise(payload_digest(F.col("_payload"))))


def _jumped(begins: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places that point on: (index of the last place each chain reaches here, where that one points)."""
    order = np.argsort(begins)
    at = np.searchsorted(begins[order], nexts)
    found = (at < len(begins)) & (begins[order][np.minimum(at, len(begins) - 1)] == nexts)
    to = np.where(found & (nexts > begins), order[np.minimum(at, len(begins) - 1)], np.arange(len(begins)))
    while (to[to] != to).any():
        to = to[to]
    return to, nexts[to]


def reachable(places: DataFrame) -> DataFrame:
    """(file, begin) of the candidates of places (file, block, begin, next) on the chain from the start of their file."""

    def exits(key: tuple, group: pa.Table) -> pa.Table:
        begins = group.column("begin").to_numpy()
        _, out = _jumped(begins, group.column("next").to_numpy())
        return pa.table({"file": group.column("file"), "begin": pa.array(begins), "exit": pa.array(out)})

    def chain(key: tuple, group: pa.Table) -> pa.Table:
        begins, nexts = group.column("begin").to_numpy(), group.column("next").to_numpy()
        reached = set(begins[group.column("entry").to_numpy(zero_copy_only=False).astype(bool)].tolist())
        step = dict(zip(begins.tolist(), nexts.tolist(), strict=True))
        for b in list(reached):
            while (b := step.get(b)) is not None and b not in reached:
                reached.add(b)
        got = np.isin(begins, np.array(sorted(reached), np.int64))
        return group.select(["file", "begin"]).filter(pa.array(got))

    known = places.where("next IS NOT NULL")
    pointers = common.written(known.groupBy("file", "block").applyInArrow(exits, "file string, begin long, exit long"), "exits")
    entries = common.written(pointers.where("begin = 0").select("file", "begin"), "entries")
    count, jump = entries.count(), pointers
    while True:
        # entries reached so far, plus what they reach by one jump; then every jump is doubled
        ahead = jump.select("file", F.col("begin").alias("_from"), F.col("exit").alias("_to"))
        more = entries.join(ahead, (entries["file"] == ahead["file"]) & (entries["begin"] == ahead["_from"])).select(entries["file"], F.col("_to").alias("begin"))
        more = more.join(pointers.select("file", "begin"), ["file", "begin"], "left_semi")
        entries = common.written(entries.unionByName(more).distinct(), "entries")
        if (now := entries.count()) == count:
            break
        count = now
        j, k = jump.alias("j"), jump.alias("k")
        jump = common.written(j.join(k, (F.col("j.file") == F.col("k.file")) & (F.col("j.exit") == F.col("k.begin"))).select(F.col("j.file").alias("file"), F.col("j.begin").alias("begin"), F.col("k.exit").alias("exit")), "jumps")
    marked = known.join(entries.withColumn("entry", F.lit(True)), ["file", "begin"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.select("file", "block", "begin", "next", "entry").groupBy("file", "block").applyInArrow(chain, "file string, begin long")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth and raw: what follows each version line, numbered from 0 within each range of a file. A task reads a
    range in whole and in order, whichever ranges it is given besides."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in it:
            nth = np.empty(len(batch), np.int64)
            for i, place in enumerate(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                last, n = (place, n + 1) if place == last else (place, 0)
                nth[i] = n
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(nth), batch.column("value")], names=["file", "block", "nth", "raw"])

    read = spark.read.option("lineSep", VERSION).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").mapInArrow(run, "file string, block long, nth long, raw string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, type, page_id, refers_to, payload_bytes, digest (of the payload read), declared for every record."""
    rows = common.written(candidates(spark, path), "candidates")
    line = len(VERSION)
    inside = Window.partitionBy("file", "block").orderBy("at")
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("bytes") + line).alias("sum"))
    ahead = blocks.select("file", "block", F.coalesce(F.sum("sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = rows.withColumn("nth", (F.row_number().over(inside) - 1).cast("long")).withColumn("_before", F.coalesce(F.sum(F.col("bytes") + line).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(ahead, ["file", "block"])
    # what stands before a row is a version line, but for the first row of a file
    placed = placed.withColumn("begin", F.col("ahead") + F.col("_before") - line).drop("_before", "ahead")
    placed = common.written(placed.withColumn("next", F.when(F.col("begin") >= 0, F.col("begin") + line + F.col("needs"))), "places")
    chain = common.written(reachable(placed.select("file", "block", "begin", "next")), "chain")
    records = placed.join(chain, ["file", "begin"], "left_semi")
    facts = ["file", "begin", "type", "page_id", "refers_to", "payload_bytes", "digest", "declared"]
    whole = records.where("whole").select(facts)
    # records whose payload holds version lines: their pieces are the rows up to the successor
    owner = records.where("NOT whole").select("file", F.col("begin").alias("o_begin"), "next", "needs")
    pieces = placed.where("begin >= 0").select(F.col("file").alias("p_file"), F.col("begin").alias("p_begin"), "raw", "whole")
    # a piece that looks whole by itself has no raw text: it is read again, by its number within the range of the file
    inner = owner.join(placed.where("whole").select("file", "begin", "block", "nth"), "file").where("begin > o_begin AND begin < next").select("file", "block", "nth", "begin", "o_begin")
    inner = common.written(inner, "inner")
    extra = None if inner.isEmpty() else _numbered(spark, path).join(inner, ["file", "block", "nth"]).select("file", "o_begin", F.col("begin").alias("p_begin"), "raw")
    own = owner.join(pieces.where("NOT whole"), (F.col("file") == F.col("p_file")) & (F.col("p_begin") >= F.col("o_begin")) & (F.col("p_begin") < F.col("next"))).select("file", "o_begin", "p_begin", "raw")
    every = own if extra is None else own.unionByName(extra)
    glued = every.groupBy("file", "o_begin").agg(F.sort_array(F.collect_list(F.struct("p_begin", "raw"))).alias("p")).select("file", F.col("o_begin").alias("begin"), F.array_join(F.transform("p", lambda x: x["raw"]), VERSION).alias("value"))
    glued = glued.withColumn("header", F.substring_index("value", END, 1))
    body = F.col("value").substr(F.char_length("header") + len(END) + 1, F.char_length("value") - F.char_length("header") - 2 * len(END))
    return whole.unionByName(_facts(glued.withColumn("body", body)).select(facts))


def archive_folder(spark: SparkSession) -> str:
    return f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
