"""Phrase collocation mining: which runs of two to four words occur together far more often than apart.

Rabin-Karp over whole texts. A prefix polynomial over the bytes gives every word a hash, one over the word hashes gives
every n-gram a fingerprint, both as numpy arrays modulo 2**64 for a slice of texts at a time. Spark adds the fingerprints up level by level;
an n-gram is only sent if both its (n-1)-grams can be frequent, as no phrase occurs more often than its parts. What can
be frequent is a bitmap of bounded size (``FILTER_BITS``): it never turns a frequent phrase away, and where it grows too
full it merely lets more through, so results are the same at every size.

The fingerprints' counts only ever err upwards, by collisions. So in a last reading each occurrence of a fingerprint
that is frequent is compared, by its words, with the occurrence that the fingerprint points to in its slice, phrases
that collide are told apart, and only these phrases are made into text and counted by it. Words alone and rare phrases
never leave the slice as text.

Defined results: A-Z count in lower case; null and empty texts have no words; a null language is ``und``; repeated rows
count once each; a null doc_id only loses its pointer; very long texts count in whole (memory follows the longest piece
between separators, beyond a megabyte); ties in score go by count, then by phrase in order of UTF-8 bytes; an empty
table, or one where nothing is frequent, gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most bits of a level's bitmap of frequent fingerprints (16 MB), and bits for each fingerprint below that.
FILTER_BITS, BITS_EACH = 27, 16
#: Bytes of text whose arrays a worker holds at once, more only where a single piece is longer.
SLICE_BYTES = 1 << 20
#: Parts of a language whose phrases are ranked side by side.
SALTS = 64
_BYTE, _WORD, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))
_BLANK, _END = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_powers = {b: Powers(b) for b in (_BYTE, _WORD)}


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[start:end] for each start and end: a difference of prefix polynomials, shifted to power zero."""
    up, down = _powers[base].to(len(values) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return (prefix[ends] - prefix[starts]) * down[starts]


class Words:
    """The words of a slice: byte spans, the piece and the text each stands in, and a hash."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, salts: np.ndarray):
        """data: texts in lower case, one after the other from begins on; salts: a number for each text's language."""
        kind = _KIND[data]
        text_start = np.zeros(len(data) + 1, np.int64)
        np.add.at(text_start, begins, 1)
        inside = kind == 0
        before = np.concatenate([[False], inside[:-1]]) & (text_start[:-1] == 0)
        self.data, self.starts = data, np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) & (text_start[1:] == 0)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.piece = np.cumsum((kind == _END) + text_start[:-1])[self.starts]
        self.text = np.cumsum(text_start[:-1])[self.starts] - 1
        self.salt = salts[self.text]
        self.hash = polynomial(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTE)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each n-gram that lies within a piece, its fingerprint, by language)."""
        at = np.flatnonzero(self.piece[n - 1 :] == self.piece[: max(0, len(self.piece) - n + 1)])
        key = (polynomial(self.hash, at, at + n, _WORD) ^ self.salt[at]) * _MIX
        return at, key ^ (key >> np.uint64(29))

    def names(self) -> pa.Array:
        """The words, as a dictionary array: equal words have equal indices."""
        letters = self.data[_KIND[self.data] == 0]  # each belongs to one word
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))).dictionary_encode()


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the key's bit: its leading bits are the bit's number."""
    size = len(bits).bit_length() + 2  # bits is bytes, a power of two of them
    place = key >> np.uint64(64 - size)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def candidates(words: Words, n: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words whose (n-1)-grams both pass the last filter: (first word, fingerprint)."""
    at, key = words.keys(n)
    if filters:
        shorter, its_key = words.keys(n - 1)
        fine = np.zeros(len(words.starts) + 1, bool)
        fine[shorter[passes(filters[-1], its_key)]] = True
        both = fine[at] & fine[at + 1]
        at, key = at[both], key[both]
    return at, key


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Texts of a batch as Words, about SLICE_BYTES at a time; longer texts are cut behind a separator. The language of
    text i of a slice is row i of the batch that comes with it."""
    for part in common.batches(batch, most_bytes=SLICE_BYTES):
        texts = pc.ascii_lower(pc.fill_null(part.column("text"), "")).cast(pa.large_binary())
        begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
        begins = (begins - begins[0])[:-1]
        salts = np.array([zlib.crc32(x.encode()) * int(_MIX) % 2**64 for x in part.column("lang").to_pylist()], np.uint64)
        if len(part) > 1 or len(data) <= 2 * SLICE_BYTES:
            yield part, Words(data, begins, salts)
            continue
        begin = 0
        while begin < len(data):
            end = begin + SLICE_BYTES
            while end < len(data) and not (cut := np.flatnonzero(_KIND[data[end : end + SLICE_BYTES]] == _END)).size:
                end += SLICE_BYTES
            end = len(data) if end >= len(data) else end + int(cut[0]) + 1
            yield part, Words(data[begin:end], begins[:1], salts)
            begin = end


def _sums(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(column, return_counts=True)
    return values.view(np.int64), counts.astype(np.int64)


def level(docs: DataFrame, n: int, filters: list, least: int) -> DataFrame:
    """(lang, key, c): fingerprints of n-grams that occur least times or more, by language in their key; at n = 1 also,
    with a null key, the number of words of each language."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for batch in it:
            for part, words in _slices(batch):
                key, c = _sums(candidates(words, n, known)[1])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.string()), pa.array(key), pa.array(c)], names=["lang", "key", "c"])
                if n == 1:
                    each = np.bincount(words.text, minlength=len(part)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("lang"), pa.nulls(len(part), pa.int64()), pa.array(each)], names=["lang", "key", "c"])

    found = docs.mapInArrow(run, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))
    return common.written(found.where(F.col("key").isNull() | (F.col("c") >= least)), "phrase-keys")


def bitmap(keys: DataFrame, each: int = BITS_EACH) -> np.ndarray:
    """The bits of the keys as bytes: ``each`` for each key, at most 2 ** FILTER_BITS in all."""
    size = min(FILTER_BITS, max(6, (keys.count() * each).bit_length()))
    place = F.shiftrightunsigned("key", 64 - size)
    rows = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[got.column("at").to_numpy()] = got.column("bit").to_numpy()
    return bits.view(np.uint8)


#: Stands for a null doc_id: it comes after all others.
_NO_DOC = 2**63 - 1


def _verified(words: Words, at: np.ndarray, key: np.ndarray, n: int, index: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of one occurrence, number of occurrences, smallest doc_id) of each phrase: those of a fingerprint that are
    not the words its pointer points to are taken out, round by round, and counted as phrases of their own. docs: the
    doc_id of each text."""
    out = []
    while len(at):
        _, pointer, group = np.unique(key, return_index=True, return_inverse=True)
        same = np.ones(len(at), bool)
        for j in range(n):
            same &= index[at + j] == index[at[pointer][group] + j]
        same &= words.salt[at] == words.salt[at[pointer][group]]
        low = np.full(len(pointer), _NO_DOC)
        np.minimum.at(low, group[same], docs[words.text[at[same]]])
        out.append((at[pointer], np.bincount(group[same], minlength=len(pointer)), low))
        at, key = at[~same], key[~same]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def materialised(docs: DataFrame, filters: list, least: int) -> DataFrame:
    """(lang, phrase, size, f, first_doc_id): all phrases of one to len(filters) words that occur least times or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        for batch in it:
            for part, words in _slices(batch):
                names = words.names()
                index, distinct = names.indices.to_numpy(), names.dictionary.cast(pa.string())
                docs = pc.fill_null(part.column("doc_id"), _NO_DOC).to_numpy()
                for n in range(1, len(known) + 1):
                    at, key = candidates(words, n, known[: n - 1])
                    fine = passes(known[n - 1], key)
                    first, count, low = _verified(words, at[fine], key[fine], n, index, docs)
                    if not len(first):
                        continue
                    text = pc.binary_join_element_wise(*(distinct.take(pa.array(index[first + j])) for j in range(n)), " ")
                    lang = part.column("lang").take(pa.array(words.text[first]))
                    yield pa.RecordBatch.from_arrays([lang, text, pa.array(np.full(len(first), n, np.int32)), pa.array(count.astype(np.int64)), pa.array(low, mask=low == _NO_DOC)], names=["lang", "phrase", "size", "f", "first_doc_id"])

    found = docs.mapInArrow(run, "lang string, phrase string, size int, f long, first_doc_id long").groupBy("lang", "phrase", "size")
    return common.written(found.agg(F.sum("f").alias("f"), F.min("first_doc_id").alias("first_doc_id")).where(F.col("f") >= least), "phrases")


def frequent_phrases(docs: DataFrame, most_words: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f, first_doc_id) for each phrase of up to most_words words that occurs least times or more in
    docs (doc_id, text, lang), and (lang, n): all word occurrences of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    filters, totals = [], None
    for n in range(1, most_words + 1):
        found = level(rows, n, filters, least)
        if n == 1:
            totals = found.where("key IS NULL").select("lang", F.col("c").alias("n"))
        filters.append(spark.sparkContext.broadcast(bitmap(found.where("key IS NOT NULL"))))
    return materialised(rows, filters, least), totals


def _part(words: Column, begin: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, most_words: int = 4, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and first_doc_id of the top phrases of each language of docs (doc_id, text, lang).

    A phrase of two words or more that occurs a times has the lowest score of its cuts, floor(2,000,000 a / (l + r)); one
    that lies within a longer phrase which has at least share hundredths of its occurrences is dropped.
    """
    phrases, totals = frequent_phrases(docs, most_words, least)
    several = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    parts = phrases.select("lang", "phrase", "f")
    # within longer ones: 100 f(longer) >= share a, in decimals, as products may pass 64 bits
    begin_size = F.explode(F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), b -> struct(b AS b, s AS s))))"))
    inner = several.where("size > 2").select("lang", "f", "words", begin_size.alias("x")).select("lang", _part(F.col("words"), F.col("x.b"), F.col("x.s")).alias("phrase"), "f")
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = several.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * share))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", "words", "first_doc_id", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "first_doc_id", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.col("size")).alias("right"))
    found = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = found.withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 DIV (CAST(l AS DECIMAL(20,0)) + r)").cast("long"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "first_doc_id")).alias("x")).select("lang", "phrase", "x.*")
    # no task ranks a language: the top of each of SALTS parts first, then the top of these
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    lowest = lowest.withColumn("part", part).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, part ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top).drop("part", "rank")
    ranked = lowest.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)").cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc_id")
