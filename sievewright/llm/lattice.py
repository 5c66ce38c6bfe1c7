"""Language-model scores from a subword lattice: every segmentation of a text counts.

The pieces of an existing vocabulary are a unigram model: a text's probability is the sum, over all its segmentations,
of the product of its pieces' probabilities, times that of the end. Pieces never reach over a blank, so a text's
logarithm is the sum over its words, and the forward recursion in log space runs once per distinct word. The existing
scores give the first weights; one expectation step over all words of the training documents, weighted by their counts,
then fits the weights to the corpus. Bytes without a piece of their own have a piece each, so every text has a score.

Word counts come from a grouped count over the whole corpus. The most frequent words, at most ``head_words``, are broadcast
(their number and length are bounded); all others are looked up by a join on the word, so no table of all words is ever held
in one place.

Defined results: null and empty texts are the end alone; repeated rows are scored once each; without training documents
every count is zero and the existing weights remain; words of equal count are looked up alike, whichever way; very long
texts count in whole, and very long words too; an empty table gives no rows; other columns are ignored. The same input
gives the same scores, however often it is scored in a session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose counts every worker holds.
HEAD_WORDS = 100_000
#: Bytes of a word beyond which it is never among them.
HEAD_BYTES = 64
#: Words whose lattices are held at once.
CHUNK = 4096
#: Pseudo-count of every piece.
SMOOTH = 0.1
_START = b"\xff"  # stands for the mark of a word's beginning: no UTF-8 text has this byte
_BASE = np.uint64(0x100000001B3)
LN10 = math.log(10)


class Pieces:
    """Pieces of a vocabulary, found by the hash of their bytes; ids are positions in ``log`` (natural logarithms), the
    vocabulary's own weights. Fitted weights are arguments: a Pieces never changes, as workers keep theirs."""

    def __init__(self, pieces: list[bytes], scores: list[float]):
        """The last weight is the end's. Scores are logarithms, or minus a rank where any lies under -100."""
        keep = {p: s for p, s in zip(pieces, scores, strict=True) if p}
        for b in range(256):
            keep.setdefault(bytes([b]), min(scores, default=0.0) - 1)
        self.pieces = sorted(keep)
        s = np.array([keep[p] for p in self.pieces])
        s = -np.log(2.0 - s) if s.min() < -100 else s
        rest = np.logaddexp.reduce(s)
        self.log = np.append(s - rest + math.log(1 - 0.002), math.log(0.002))
        self.bits = 20
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.hash = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.probes = 1
        for i, at in enumerate(self._place(self.hash).tolist()):
            n = 1
            while self.slot[at] >= 0:
                at, n = (at + 1) % len(self.slot), n + 1
            self.slot[at] = i
            self.probes = max(self.probes, n)
        self.longest = max(map(len, self.pieces))
        self.size = np.array(list(map(len, self.pieces)), np.int64)
        padded = b"".join(p.ljust(-(-self.longest // 8) * 8, b"\0") for p in self.pieces)
        self.eights = np.frombuffer(padded, "<u8").reshape(len(self.pieces), -1)
        self.log.flags.writeable = False

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) % 2**64
        return h

    def _place(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray, eights: np.ndarray, step: int) -> np.ndarray:
        """Pieces of step bytes with hash h, or -1; a hash's piece only counts if its bytes are those of the word, which
        has the eight bytes from each place on as a number in eights."""
        at = self._place(h)
        out = np.full(h.shape, -1, np.int32)
        for _ in range(self.probes):
            got = self.slot[at]
            out = np.where((got >= 0) & (self.hash[got] == h), got, out)
            at = (at + 1) & (len(self.slot) - 1)
        same = self.size[out] == step
        for k in range(0, step, 8):
            ours = eights[:, k : k + h.shape[1]] & np.uint64(2 ** (8 * min(8, step - k)) - 1)
            same &= ours == self.eights[out, k // 8]
        return np.where(same, out, -1)

    def edges(self, words: np.ndarray) -> list[np.ndarray]:
        """Per piece length l from 1: the piece that starts at each place of each word (matrix of bytes), or -1."""
        n, size = words.shape
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * _BASE + words[:, j].astype(np.uint64) + np.uint64(1)
        eights = np.zeros((n, size), np.uint64)
        for j in range(min(8, size)):
            eights[:, : size - j] |= words[:, j:].astype(np.uint64) << np.uint64(8 * j)
        power, out = np.uint64(1), []
        with np.errstate(over="ignore"):
            for step in range(1, min(self.longest, size) + 1):
                power = power * _BASE
                out.append(self._find(prefix[:, step:] - prefix[:, :-step] * power, eights, step))
        return out

    def forward(self, edges: list[np.ndarray], n: int, size: int, log: np.ndarray, backward: bool = False) -> np.ndarray:
        """Log-space recursion with weights log: mass of all segmentations up to (backward: from) each place."""
        log = np.append(log, -np.inf)  # -1 finds this
        weight = [log[e] for e in edges]
        total = np.full((n, size + 1), -np.inf)
        total[:, size if backward else 0] = 0.0
        for j in range(size - 1, -1, -1) if backward else range(1, size + 1):
            steps = range(1, min(len(edges), size - j if backward else j) + 1)
            parts = np.stack([total[:, j + s] + weight[s - 1][:, j] if backward else total[:, j - s] + weight[s - 1][:, j - s] for s in steps])
            top = parts.max(axis=0)
            total[:, j] = top + np.log(np.exp(parts - top).sum(axis=0))
        return total

    def chunks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in words, matrix of bytes) for words of one length at a time."""
        data = [_START + w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for same in np.split(order, cuts):
            most = max(1, CHUNK * 16 // max(16, int(size[same[0]]) if len(same) else 16))
            for begin in range(0, len(same), most):
                own = same[begin : begin + most]
                yield own, np.frombuffer(b"".join([data[i] for i in own]), np.uint8).reshape(len(own), -1)

    def log_words(self, words: list[str], log: np.ndarray) -> np.ndarray:
        """Natural logarithm of every word's marginal probability under weights log."""
        out = np.zeros(len(words))
        for own, matrix in self.chunks(words):
            out[own] = self.forward(self.edges(matrix), *matrix.shape, log)[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece, by the vocabulary's own weights, in words that occur counts times."""
        used = np.zeros(len(self.log))
        for own, matrix in self.chunks(words):
            n, size = matrix.shape
            edges = self.edges(matrix)
            a, b = self.forward(edges, n, size, self.log), self.forward(edges, n, size, self.log, backward=True)
            whole = a[:, -1:]
            for step, e in enumerate(edges, 1):
                at = e >= 0
                mass = a[:, : size - step + 1] + b[:, step:] - whole
                share = np.exp(np.where(at, mass + self.log[e], -np.inf)) * counts[own][:, None]
                used += np.bincount(e[at], share[at], len(used))
        return used


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Pieces:
    """Pieces and scores of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.append(model.id_to_piece(i).replace("▁", "\x00").encode().replace(b"\x00", _START))
            scores.append(model.get_score(i))
    return Pieces(pieces, scores)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all texts in turn, text of each word), A-Z in lower case."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.asarray(words.value_lengths()))
    if "" in names:  # blanks at the edges of a text
        keep = index != names.index("")
        index, text = index[keep], text[keep]
    return names, index, text


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of docs (text, training) and how often training documents have it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch, most_bytes=16 << 20):
                names, index, text = _words(part.column("text"))
                train = part.column("training").to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.bincount(index, train[text], len(names)).astype(np.int64)
                used = np.bincount(index, minlength=len(names)) > 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).filter(pa.array(used)), pa.array(counts[used])], names=["word", "c"])

    return docs.select("text", "training").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, ends: int, path: str) -> np.ndarray:
    """Log weights of the pieces and the end after one expectation step over counts (word, c) and ends ends of text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = vocabulary(path), 0.0
        for batch in it:
            total = total + pieces.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy())
        if not np.isscalar(total):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.float64())], names=["piece", "n"])

    pieces = vocabulary(path)
    if not ends:
        return pieces.log
    used = np.full(len(pieces.log), SMOOTH)
    for r in counts.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        used[r["piece"]] += r["n"]
    used[-1] += ends
    return np.log(used / used.sum())


def score(docs: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score for docs (doc_id, text, training)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "training")
    counts = common.written(word_counts(rows), "words")
    ends = rows.where("training").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train_tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    least = math.log10(train_tokens + 0.1 * (distinct + 1))
    weights = spark.sparkContext.broadcast(fit(counts, ends, path))

    def log_words(words: list[str]) -> np.ndarray:
        return vocabulary(path).log_words(words, weights.value) / LN10

    # the head: all words above the lowest count that at most head_words reach, found from counts per eighth of an octave
    octave = F.floor(F.log2("c") * 8)
    short = counts.where((F.col("c") > 0) & (F.octet_length("word") <= HEAD_BYTES))
    reached, lowest = 0, None
    for r in sorted(short.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["o"]):
        if (reached := reached + r["n"]) > head_words:
            break
        lowest = r["o"]
    first = short.where(octave >= lowest if lowest is not None else F.lit(False)).select("word", "c").toPandas()
    head_score = log_words(first["word"].tolist())
    head = spark.sparkContext.broadcast((dict(zip(first["word"].tolist(), range(len(first)), strict=True)), first["c"].to_numpy(np.int64), head_score))
    end = (math.log10(ends + 0.1) - least, float(weights.value[-1]) / LN10, int(ends > 0))

    def by_document(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, own_score = head.value
        base = np.append(np.log10(c + 0.1) - least, 0.0)
        own, seen = np.append(own_score, 0.0), np.append(c > 0, False)
        for batch in it:
            for part in common.batches(batch, most_bytes=8 << 20):
                names, index, text = _words(part.column("text"))
                at = np.array([place.get(w, -1) for w in names], np.int64)
                here, n = at[index] if len(names) else index, len(part)
                total = [np.bincount(text, minlength=n) + 1, np.bincount(text, seen[here], n).astype(np.int64) + end[2], np.bincount(text, base[here], n) + end[0], np.bincount(text, own[here], n) + end[1]]
                rest = here < 0
                pair, times = np.unique(text[rest] * max(1, len(names)) + index[rest], return_counts=True)
                doc, word = pair // max(1, len(names)), pair % max(1, len(names))
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("training"), *(pa.array(t) for t in total), none], names=columns)
                zero = np.zeros(len(doc))
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(doc)), pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.bool_()), pa.array(times), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero), pa.array(names, pa.string()).take(pa.array(word))], names=columns)

    columns = ["row", "doc_id", "training", "n_tokens", "n_known", "base_score", "score", "word"]
    split = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "training", "text").mapInArrow(by_document, "row long, doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double, word string")

    def with_score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_words(batch.column("word").to_pylist()))], names=["word", "c", "own"])

    split = common.written(split, "split")
    whole = split.where("word IS NULL").drop("word")
    tail = split.where("word IS NOT NULL").select("row", "word", F.col("n_tokens").alias("times"))
    table = counts.mapInArrow(with_score, "word string, c long, own double")
    found = tail.join(table, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - least)).alias("t_base"),
        F.sum(F.col("times") * F.col("own")).alias("t_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.join(found, "row", "left").select(
        "doc_id", "training", "n_tokens",
        (F.col("n_known") + zero("t_known")).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("t_base")).alias("base_score"),
        (F.col("score") + zero("t_score")).alias("score"),
    )
