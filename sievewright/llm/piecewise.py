"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes decides where a piece ends: where it leaves block-1 modulo the block size. Every piece
gives one character of the signature, however many there are, so an edit changes a few characters only. A fingerprint is
``block:signature:signature at twice the block``; the block size is the smallest for which about 64 pieces are expected,
halved while fewer than half of them are found. Repeated lines may give many more: all of them count. Fingerprints of equal or neighbouring block sizes are compared by the
edit distance of the signatures that belong to the same block size; all others have likeness 0.

Defined results: null and empty texts have the fingerprint ``3::``; equal texts have equal fingerprints, which have
likeness 1; rows that share a doc_id follow each other in the order of their texts; a null doc_id comes before all
others; a table of one row is its own next row; very
long texts count in whole, with a character for every piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .edits import distance

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK = 3
PIECES = 64
REACH = 7
#: Signatures that share no run of so many characters have likeness 0.
COMMON_RUN = 6


def rolling(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted xor of the last REACH bytes."""
    c = np.zeros(len(data) + REACH - 1, np.uint32)
    c[REACH - 1 :] = np.frombuffer(data, np.uint8)
    n = len(data)
    out, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(REACH):
        part = c[REACH - 1 - j : REACH - 1 - j + n]
        out += part * np.uint32(REACH - j + 1)
        mixed ^= part << np.uint32(5 * j)
    return out + mixed


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = (ends + 1).tolist()
    begin, out = 0, []
    for end in cuts:
        out.append(LETTERS[zlib.crc32(data[begin:end]) & 63])
        begin = end
    if begin < len(data):
        out.append(LETTERS[zlib.crc32(data[begin:]) & 63])
    return "".join(out)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    block = LEAST_BLOCK
    if not data:
        return f"{block}::"
    while block * PIECES < len(data):
        block *= 2
    r = rolling(data)
    while True:
        ends = np.flatnonzero(r % np.uint32(block) == block - 1)
        if block <= LEAST_BLOCK or len(ends) >= PIECES // 2:
            break
        block //= 2
    double = np.flatnonzero(r % np.uint32(2 * block) == 2 * block - 1)
    return f"{block}:{_signature(data, ends)}:{_signature(data, double)}"


def _score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON_RUN, len(a), len(b))
    if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 1.0 - distance(a, b) / max(len(a), len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1."""
    if one == other:
        return 1.0
    (a, a1, a2), (b, b1, b2) = ((int(x[0]), x[1], x[2]) for x in (one.split(":"), other.split(":")))
    if a == b:
        return max(_score(a1, b1), _score(a2, b2))
    if a == 2 * b:
        return _score(a1, b2)
    if b == 2 * a:
        return _score(a2, b1)
    return 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint for every row of docs (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(fingerprint, batch.column("text").to_pylist()), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of doc_id: _route, _guest, _key, doc_id, text, each partition in this order.

    A range is followed by the first rows of the next one as guests, so that every row's successor is at hand; the last
    range is followed by the first. There are as many ranges as shuffle partitions; only their bounds reach the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    found = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"] if n > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def route(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    firsts = {r["_route"]: r["first"] for r in rows.select("_key", route("_key").alias("_route")).groupBy("_route").agg(F.min("_key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}
    guests = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_key")) if before else F.lit(None).cast("int")
    own = F.struct(F.col("_home").alias("r"), F.lit(0).alias("g"))
    extra = F.struct(F.col("_guest_of").alias("r"), F.lit(1).alias("g"))
    placed = rows.withColumn("_home", route("_key")).withColumn("_guest_of", guests)
    placed = placed.withColumn("_at", F.explode(F.when(F.col("_guest_of").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    placed = placed.select(F.col("_at.r").alias("_route"), F.col("_at.g").alias("_guest"), "_key", "doc_id", "text")
    return placed.repartition(n, "_route").sortWithinPartitions("_route", "_guest", "_key", "text")


def next_comparisons(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row's text.

    The edited text has its last half (rounded down) replaced by as much of the next text's beginning.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # route, guest, doc_id, text, fingerprint
        for batch in it:
            for part in common.batches(batch):
                out = []
                for r, g, doc, text in zip(part.column("_route").to_pylist(), part.column("_guest").to_pylist(), part.column("doc_id").to_pylist(), common.text_rows(part), strict=True):
                    own = fingerprint(text)
                    if last is not None and last[0] == r and not last[1]:
                        _, _, d, t, fp = last
                        edited = t[: len(t) - len(t) // 2] + text[: len(t) // 2]
                        changed = fingerprint(edited)
                        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp, changed, likeness(fp, changed), likeness(fp, own)))
                    last = (r, g, doc, text, own)
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
