"""Sequence packing by minimum bin slack.

Documents are tokenised once, cut into full windows plus one remainder, and the remainders are packed. How the
remainders fill the windows depends only on how many there are of each length, so the planner sees a histogram of at
most ``capacity`` counts, whatever the size of the corpus. For each window a subset-sum bitset finds the multiset of
remaining lengths whose sum comes closest to the capacity; backtracking through the bitsets gives the count of each
length, and the pattern is repeated as often as the histogram allows.

Defined results: a null or empty text is the closing id alone; repeated rows are packed once each; a very long
text is cut into full sequences and a rest, all of whose ids are kept; an empty table gives no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Parts that the rows of one length are ranked in, so that no length is ranked by one task.
RANK_PARTS = 64
#: Words whose ids a worker remembers within a task.
CACHE_WORDS = 300_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Ids of words this worker process has met in the task at hand.
_KNOWN: dict[str, bytes] = {}
#: Latin letters and punctuation after them: the tokenizer splits between the two, and only lower-cases the letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|)\]}#$%&*\"]*)")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def _forget() -> None:
    """At a task's end: its worker lives on, for other stages too."""
    _KNOWN.clear()


def _learn(words: list[str], path: str) -> None:
    """Fills _KNOWN for words. Plain words go to the BPE model itself, all others through the whole tokenizer."""
    model, letters = _tokenizer(path).model, _byte_letters()
    others, tails = [], {"": b""}
    for word in words:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            others.append(word)
            continue
        stem, tail = plain[1].lower(), plain[2]
        ids = _KNOWN.get(stem)
        if ids is None:
            got = model.tokenize(stem if stem.isascii() else stem.encode().decode("latin-1").translate(letters))
            ids = struct.pack(f"<{len(got)}I", *[x.id for x in got])
        end = tails.get(tail)
        if end is None:
            got = _tokenizer(path).encode(tail, add_special_tokens=False).ids
            end = tails[tail] = struct.pack(f"<{len(got)}I", *got)
        _KNOWN[stem] = ids
        _KNOWN[word] = ids + end
    for begin in range(0, len(others), 20_000):
        some = others[begin : begin + 20_000]
        for word, got in zip(some, _tokenizer(path).encode_batch_fast(some, add_special_tokens=False), strict=True):
            _KNOWN[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)


def _token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all texts in turn, and where each text's ids end.

    No token of this vocabulary holds a blank, so a text's ids are those of its blank-separated words; each word is
    tokenised once while this process remembers it."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    if new := [w for w in names if w not in _KNOWN]:
        if len(_KNOWN) + len(new) > CACHE_WORDS:
            _KNOWN.clear()
            new = names
        _learn(new, path)
    own = [_KNOWN[w] for w in names]
    sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
    flat, begins = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
    index = coded.indices.to_numpy()
    each = sizes[index]
    ends = np.cumsum(each)
    ids = flat[np.repeat(begins[index] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
    counts = np.asarray(words.value_lengths())
    return ids, np.concatenate(([0], ends))[np.cumsum(counts)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens (long) and ids (binary, little-endian 32-bit)."""
    width = 4 * capacity
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pieces(it)
        finally:
            _forget()

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = end_id.to_bytes(4, "little")
        for batch in it:
            for part in common.batches(batch, most_bytes=2 << 20):
                doc, start, total, ids, begin = [], [], [], [], 0
                every, ends = _token_ids(part.column("text"), tokenizer)
                for d, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    own, begin = every[begin:end].tobytes() + closing, end
                    for at in range(0, len(own), width):
                        doc.append(d)
                        start.append(at // 4)
                        total.append(len(own) // 4)
                        ids.append(own[at : at + width])
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.trimmed(run), "doc_id long, start long, length long, doc_tokens long, ids binary")


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram of lengths: (multiset as length -> count, how often), until all are used.

    Each pattern holds the longest length left; the rest comes from the subset-sum bitset. Every pattern uses a length
    up, so there are at most as many patterns as there are lengths, plus one for each length's odd rest.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths lie between 1 and the capacity")
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        room = capacity - lengths[0]
        reach, steps = 1, []
        for n in lengths:
            usable, k = min(left[n] - (n == lengths[0]), room // n), 1
            while usable > 0:  # a count as a sum of 1, 2, 4, ... copies
                take = min(k, usable)
                steps.append((n, take, reach))
                reach |= (reach << (n * take)) & ((1 << (room + 1)) - 1)
                usable, k = usable - take, k * 2
            if reach >> room & 1:
                break
        total, chosen = reach.bit_length() - 1, {lengths[0]: 1}
        for n, take, before in reversed(steps):
            if not before >> total & 1:  # not reachable without this step
                total -= n * take
                chosen[n] = chosen.get(n, 0) + take
        times = min(left[n] // c for n, c in chosen.items())
        out.append((chosen, times))
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def slot_ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, copies per sequence): where the rows of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in patterns:
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            begin = used.get(n, 0)
            rows.append((n, begin, begin + c * times, sequence, offset, c))
            used[n] = begin + c * times
            offset += n * c
        sequence += times
    return rows


def assign_sequences(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id, offset, sequence_tokens and padded_length to pieces (doc_id, start, length and any columns).

    ``pieces`` is read three times: pass a written table. Full pieces are sequences of their own and never move. The
    rest is ranked within its length in RANK_PARTS parts; part sizes come from a grouped count. What is broadcast is
    the part table (at most capacity * RANK_PARTS rows) and the slot table (bounded by the capacity as well).
    """
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_PARTS)).cast("int")
    loose = pieces.where(F.col("length") < capacity).withColumn("_part", part)
    sizes = loose.groupBy("length", "_part").count()
    per_length = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    patterns = slack_patterns(per_length, capacity)
    packed = sum(times for _, times in patterns)
    slots = spark.createDataFrame(
        [(n, lo, hi, seq, off, c, sum(k * v for k, v in chosen.items())) for (n, lo, hi, seq, off, c), chosen in zip(slot_ranges(patterns), (p for p, _ in patterns for _ in p), strict=True)],
        "s_length long, lo long, hi long, s_sequence long, s_offset long, copies long, sequence_tokens long",
    )
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select(F.col("length").alias("p_length"), F.col("_part").alias("p_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "start")
    ranked = loose.withColumn("_row", F.row_number().over(within) - 1).join(F.broadcast(parts), (F.col("length") == F.col("p_length")) & (F.col("_part") == F.col("p_part"))).withColumn("_rank", F.col("_row") + F.col("ahead"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    step = F.col("_rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("s_sequence") + F.floor(step / F.col("copies"))).withColumn("offset", F.col("s_offset") + (step % F.col("copies")) * F.col("length"))
    keep = [*pieces.columns, "sequence_id", "offset", "sequence_tokens"]
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(packed) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "sequence_tokens": F.lit(capacity).cast("long")})
    both = placed.select(keep).unionByName(full.select(keep))
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return both.withColumn("padded_length", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(capacity).cast("long")))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packed pieces with their ids: doc_id, start, length, doc_tokens, ids, sequence_id, offset, sequence_tokens, padded_length."""
    return assign_sequences(common.written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def pack_digests(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """As pack(), but each piece carries the CRC-32 of its ids in place of them, so only narrow rows are moved."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign_sequences(common.written(pieces, "pieces"), capacity)
