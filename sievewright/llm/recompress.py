"""Exact substring deduplication by recompression.

A document is a sequence of words. Rounds of recompression rename it bottom-up: runs of one word become one symbol, then
each round splits the symbols into left and right by a bit of their name and joins every left-right neighbour pair into
one symbol. Names are 64-bit mixes of the parts' names, so they are global without a dictionary: equal substrings get
equal symbols wherever what decides about a symbol (its context) lies inside them. Each window of ``window`` words is
represented by one symbol whose context it holds (the highest round, ties by name); windows without any use their own
hash. Two equal windows therefore share their representative's key.

Spark deals the work out in shuffles of narrow rows: representative keys of all documents (one row per document and
key); keys met in several documents then reveal, per document, which windows may repeat; those windows are verified by
hashes of their words (96 bits, from two independent names of each word), and the smallest doc_id per window decides
what goes. Keys and windows that very many documents have are found on a part of the documents first; their rows are
dealt out by a salt, as such a key is shared anyway and such a window's smallest doc_id is aggregated before it is joined.

Defined results: null and empty texts have no words; documents shorter than a window keep all; very long texts are read
whole; rows that repeat a doc_id are judged as one document's parts, i.e. they never remove each other's words; a null
doc_id neither removes nor loses words; an empty table gives no rows; other columns are kept by remove_repeats(),
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW = 13
#: Rounds of pair compression.
ROUNDS = 3
#: Text that a task holds as arrays at once.
BATCH_BYTES = 4 << 20
#: One in so many documents is looked at for keys that very many have: those in over a HOT_SHARE-th of them, and in
#: HOT_LEAST at least. This only decides which rows are salted.
PART, HOT_SHARE, HOT_LEAST, SALTS = 64, 2000, 50, 64
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_NO = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _P1
    x = (x ^ (x >> np.uint64(29))) * _P2
    return x ^ (x >> np.uint64(32))


def word_names(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, second names, ends): two independent 64-bit names for every word of all texts in turn, and where each
    text's words end."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = words.flatten()
    coded = flat.dictionary_encode()
    ends = np.cumsum(np.asarray(words.value_lengths()).astype(np.int64))
    known = [w.encode() for w in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
    first, second = (np.array([f(w) for w in known], np.uint64)[at] for f in (xxh64_intdigest, xxh3_64_intdigest))
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    if blank.any():  # blanks at the edges of a text leave empty pieces
        gone = np.concatenate(([0], np.cumsum(blank)))
        first, second, ends = first[~blank], second[~blank], ends - gone[ends]
    return first, second, ends


def window_starts(n: int, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Where the windows begin that lie in one text, of n words in all."""
    starts = np.arange(max(0, n - window + 1))
    text = np.searchsorted(ends, starts, side="right")
    return starts[ends[text] - starts >= window] if len(starts) else starts


def window_hashes(names: np.ndarray, starts: np.ndarray, seed: np.uint64, window: int = WINDOW) -> np.ndarray:
    """Hashes of the windows that begin at starts."""
    n = len(names)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = np.zeros(n - window + 1, np.uint64)
    mixed = _mix(names ^ seed)
    for i in range(window):
        h = h * seed + mixed[i : n - window + 1 + i]
    return _mix(h)[starts]


def _symbols(names: np.ndarray, ends: np.ndarray, rounds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(round, names, context begins, context ends) of the runs (round 0) and pairs that each round forms."""
    n = len(names)
    first = np.zeros(n + 1, bool)  # words that open a text
    first[0] = True
    first[ends] = True
    new = np.concatenate(([True], names[1:] != names[:-1])) | first[:n]
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    name = np.where(hi - lo > 1, _mix(names[lo] + (hi - lo).astype(np.uint64) * _P3), names[lo])
    opens = first[lo]
    # what lies outside the text can't be seen: such a symbol stands for no window
    left, right = np.where(opens, -n, lo - 1), np.where(np.append(opens[1:], True), 3 * n, hi + 1)
    runs = hi - lo > 1
    yield 0, name[runs], left[runs], right[runs]
    for r in range(1, rounds + 1):
        if len(name) < 2:
            return
        turned = _mix(name ^ np.uint64((int(_P2) * r) % 2**64)) >> np.uint64(63) == 1
        pair = np.append(~turned[:-1] & turned[1:] & ~opens[1:], False)
        second = np.concatenate(([False], pair[:-1]))
        at = np.flatnonzero(pair)
        joined = _mix(name[at] * _P1 + _mix(name[at + 1] + np.uint64((int(_P3) * r) % 2**64)))
        begin, end = left.copy(), right.copy()
        # a symbol that stays single was decided by a neighbour
        alone = ~pair & ~second
        before, after = np.concatenate(([-n], left[:-1])), np.append(right[1:], 3 * n)
        begin = np.where(alone & turned, np.where(opens, -n, np.minimum(before, begin)), begin)
        end = np.where(alone & ~turned, np.where(np.append(opens[1:], True), 3 * n, np.maximum(after, end)), end)
        end[at] = right[at + 1]
        name = name.copy()
        name[at] = joined
        yield r, joined, left[at], right[at + 1]
        keep = ~second
        name, left, right, opens = name[keep], begin[keep], end[keep], opens[keep]


def representatives(names: np.ndarray, ends: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, h1): every window's start, its representative's key and its hash.

    A key covers the words of the representative's whole context, which is part of the window.
    """
    n, starts = len(names), window_starts(len(names), ends, window)
    h1 = window_hashes(names, starts, _P1, window)
    if not len(starts):
        return starts, h1, h1
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(names ^ _P2) * _powers(n))))
    best, key = np.full(n, _NO), np.zeros(n, np.uint64)
    for r, name, lo, hi in _symbols(names, ends, rounds):
        fits = (lo >= 0) & (hi <= n) & (hi - lo <= window)
        name, lo, hi = name[fits], lo[fits], hi[fits]
        order = np.full(n + window, _NO)
        order[lo] = (_mix(name) >> np.uint64(4)) | (np.uint64(rounds - r) << np.uint64(60))
        size = np.full(n + window, window + 1)
        size[lo] = hi - lo
        own = np.zeros(n + window, np.uint64)
        own[lo] = _mix((prefix[hi] - prefix[lo]) * _inverses(n)[lo] + (hi - lo).astype(np.uint64))
        for d in range(window - 1):
            here = order[d : d + n]
            better = (here < best) & (size[d : d + n] + d <= window)
            best = np.where(better, here, best)
            key = np.where(better, own[d : d + n], key)
    return starts, np.where(best[starts] == _NO, _mix(h1 ^ _P3), key[starts]), h1


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def _table(which: str, base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64."""
    known = _TABLES.get(which)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _TABLES[which] = np.multiply.accumulate(steps)
    return known[:n]


def _powers(n: int) -> np.ndarray:
    return _table("up", _BASE, n)


def _inverses(n: int) -> np.ndarray:
    return _table("down", pow(_BASE, -1, 1 << 64), n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def document_keys(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, digest, doc_id): the representative keys of each document of docs (doc_id, digest, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch, most_bytes=BATCH_BYTES):
                names, _, ends = word_names(part.column("text"))
                starts, keys, _ = representatives(names, ends, window)
                at = _once_per_text(np.searchsorted(ends, starts, side="right"), keys)
                text = pa.array(np.searchsorted(ends, starts[at], side="right"))
                yield pa.RecordBatch.from_arrays([_signed(keys[at]), part.column("digest").take(text), part.column("doc_id").take(text)], names=["key", "digest", "doc_id"])

    return docs.mapInArrow(run, "key long, digest long, doc_id long")


def _once_per_text(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions, in order, of the first occurrence of each value within its text."""
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]))) if len(t) else np.zeros(0, bool)
    return np.sort(order[fresh])


def _marked(part: pa.RecordBatch, text: np.ndarray, values: np.ndarray, column: str) -> np.ndarray:
    """Which values are in their text's list of that column."""
    lists = part.column(column)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    wanted = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(sizes)
    cut = np.searchsorted(text, np.arange(len(part) + 1))
    out = np.zeros(len(values), bool)
    for i in np.flatnonzero(sizes):
        span = slice(cut[i], cut[i + 1])
        out[span] = np.isin(values[span], wanted[ends[i] - sizes[i] : ends[i]])
    return out


def repeated_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h1, h2, doc_id): the windows of documents (doc_id, text, keys) whose representative is among keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch.filter(batch.column("keys").is_valid()), most_bytes=BATCH_BYTES):
                names, second, ends = word_names(part.column("text"))
                starts, keys, h1 = representatives(names, ends, window)
                text = np.searchsorted(ends, starts, side="right")
                at = np.flatnonzero(_marked(part, text, keys, "keys"))
                at = at[_once_per_text(text[at], h1[at])]
                h2 = window_hashes(second, starts, _P3, window)
                yield pa.RecordBatch.from_arrays([_signed(h1[at]), pa.array((h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("doc_id").take(pa.array(text[at]))], names=["h1", "h2", "doc_id"])

    return keyed.mapInArrow(run, "h1 long, h2 int, doc_id long")


def _hot(rows: DataFrame, key: list[str], documents: int) -> DataFrame:
    """Keys of rows (of one in PART documents) that very many of these documents have."""
    least = max(HOT_LEAST, documents // HOT_SHARE)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*key)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, gone, copy) for the documents of docs (doc_id long, text string) that lose words: gone holds the hashes h1
    of the windows that also occur in a document with a smaller doc_id; copy says instead that the whole text is that of
    a document with a smaller doc_id.

    Exact copies need no windows: they lose everything, and what they could remove the first copy removes as well. Both
    joins take the documents through the same shuffle, which Spark runs once.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").where("doc_id IS NOT NULL")
    digests = rows.select("doc_id", "digest", F.md5("text").alias("check"))
    first = digests.groupBy("digest", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = common.written(first, "first")
    copies = common.written(digests.join(first, ["digest", "check"]).where("doc_id > first").select("doc_id").distinct(), "copies")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0
    some = rows.where(part).count()
    hot = common.written(_hot(document_keys(rows.where(part), window), ["key"], some).withColumn("hot", F.lit(True)), "hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int")).otherwise(0)
    keys = document_keys(rows, window).join(F.broadcast(hot), "key", "left").withColumn("salt", salt)
    met = Window.partitionBy("key", "salt")
    shared = keys.withColumn("lo", F.min("digest").over(met)).withColumn("hi", F.max("digest").over(met)).where("hot OR lo < hi")
    per_doc = shared.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).join(copies, "doc_id", "left_anti").withColumnRenamed("doc_id", "of")
    windows = common.written(repeated_windows(docs.join(per_doc, docs["doc_id"] == F.col("of"), "left").select("doc_id", "text", "keys"), window), "windows")
    often = common.written(_hot(windows.where(part), ["h1", "h2"], some), "often")
    least = windows.join(F.broadcast(often), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    salted = windows.join(F.broadcast(common.written(least, "least")), ["h1", "h2"], "left").withColumn("salt", F.when(F.col("least").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    same = Window.partitionBy("h1", "h2", "salt")
    later = salted.withColumn("lo", F.coalesce("least", F.min("doc_id").over(same))).where("lo < doc_id")
    gone = later.groupBy("doc_id").agg(F.collect_set("h1").alias("gone")).withColumn("copy", F.lit(None).cast("boolean"))
    return gone.unionByName(copies.select("doc_id", F.lit(None).cast("array<bigint>").alias("gone"), F.lit(True).alias("copy")))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the words covered by such windows removed from text (kept words joined by one blank),
    plus n_words and n_removed; these two names win over columns of docs."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    of, lost, copied = (common.fresh(c, docs) for c in ("of", "gone", "copy"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in others))
    marks = repeats(base.select("doc_id", "text"), window).toDF(of, lost, copied)
    found = base.join(marks, base["doc_id"] == marks[of], "left")
    kept = ["doc_id", *others]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch, most_bytes=BATCH_BYTES):
                hit = part.column(lost).is_valid()
                some = part.filter(hit)
                names, _, ends = word_names(some.column("text"))
                starts = window_starts(len(names), ends, window)
                at = starts[_marked(some, np.searchsorted(ends, starts, side="right"), window_hashes(names, starts, _P1, window), lost)]
                change = np.bincount(at, minlength=len(names) + window + 1) - np.bincount(at + window, minlength=len(names) + window + 1)
                keep, begins, nth = np.cumsum(change)[: len(names)] == 0, np.concatenate(([0], ends)), 0
                out, total, removed = [], [], []
                for text, windows, copy in zip(common.text_rows(part), hit.to_pylist(), part.column(copied).to_pylist(), strict=True):
                    words = text.encode().split()
                    total.append(len(words))
                    if windows:
                        words = list(compress(words, keep[begins[nth] : begins[nth + 1]].tolist()))
                        nth += 1
                    elif copy and len(words) >= window:
                        words = []
                    removed.append(total[-1] - len(words))
                    out.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*kept, "text", "n_words", "n_removed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text"), "text string, n_words long, n_removed long"])
    return found.select(base["doc_id"], *(base[f"`{c}`"] for c in others), "text", lost, copied).mapInArrow(run, schema)
