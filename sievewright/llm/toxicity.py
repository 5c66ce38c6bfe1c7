"""Toxicity by two class-conditional Kneser-Ney models: is a text likelier as toxic or as ordinary writing?

Two bigram models, one of toxic and one of ordinary documents, count in how many documents a pair of words occurs, and in
how many different contexts a word does (continuation counts, so that a repeated line counts once). Both back off to the
counts they share: an absolute discount is taken off every count and goes to the word's own class, from there to both
classes together; words and pairs that are rarer than a cutoff in both classes together have no ratio of their own. So what
one class has by chance alone tells nothing.

A text's evidence is the logarithm of the ratio of its two likelihoods, divided by its length: over the whole text, and
over the stretches of SPANS words where it is largest, as a few words can make a long text toxic. A logistic curve turns
these length-normalised ratios into a score. It is fitted on labelled rows left out of the counts (FOLDS times each), as
is the choice of the cutoff.

The fit reads at most ``MOST_ROWS`` labelled rows of each class, and of one at most ``MOST_TO_ONE`` times as many as of the
other, in order of a hash of doc_id; texts that repeat among them count once. Everything that is counted of them is counted by Spark; the driver gets
words and pairs above the smallest cutoff. All documents are scored in whole, where they are.

Defined results: null, empty and wordless texts have no evidence either way and get the score of such; repeated rows are
scored alike; a doc_id with several labels is toxic if any says so, labels that are null or neither 0 nor 1 are ignored,
and so are labels without a document; without labels of both classes every score is the share of toxic labels, zero
without any; very long texts count in whole; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that are learned from, at most, and of one class for each row of the other.
MOST_ROWS, MOST_TO_ONE = 4000, 8
#: Parts of the labelled rows that are left out in turn.
FOLDS = 3
#: Occurrences (documents of a pair, contexts of a word) under which there is no ratio; the best of these is taken.
CUTOFFS = (3, 6, 12, 24, 48, 96)
DISCOUNT = 0.75
#: Words of the stretches whose likelihoods are compared besides those of whole texts.
SPANS = (8, 32)
_BITS = 21  # of a fold's count in a packed one


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all texts in turn, text of each word): runs of letters and digits in lower
    case, so that marks around or within a text don't hide its words."""
    plain = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\pL\pN]+", " "))
    words = pc.ascii_split_whitespace(pc.utf8_trim(plain, " "))
    coded = words.flatten().dictionary_encode()
    index, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.asarray(words.value_lengths()))
    full = pc.binary_length(coded.dictionary).to_numpy()[index] > 0 if len(index) else np.zeros(0, bool)
    return coded.dictionary, index[full], text[full]


@dataclass
class Ratios:
    """Log ratios of a word (the last: of all others), of a pair, and of backing off after a word; keys are pairs of word
    numbers in one, rising."""

    words: list[str]
    word: np.ndarray
    after: np.ndarray
    keys: np.ndarray
    pair: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: the mean ratio of its words, the largest mean of each span, and the logarithm of its length."""
        names, index, text = _words(texts)
        place = np.where((at := pc.fill_null(pc.index_in(names, self._value_set()), -1).to_numpy()) < 0, len(self.words), at)[index] if len(index) else index
        ratio = self.word[place]
        if len(place) > 1:
            follows, key = text[1:] == text[:-1], place[:-1] * np.int64(len(self.words) + 1) + place[1:]
            spot = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            known = self.keys[spot] == key if len(self.keys) else np.zeros(len(key), bool)
            ratio[1:] = np.where(follows, np.where(known, self.pair[spot] if len(self.keys) else 0.0, ratio[1:] + self.after[place[:-1]]), ratio[1:])
        n = np.bincount(text, minlength=len(texts))
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        begin = np.concatenate([[0], np.cumsum(n)])
        out = [(total[begin[1:]] - total[begin[:-1]]) / np.maximum(n, 1)]
        for span in SPANS:
            first = np.arange(len(ratio))
            last = np.minimum(first + span, begin[1:][text]) if len(ratio) else first
            size = np.minimum(span, n[text]) if len(ratio) else first
            mean = np.where(last - first == size, (total[last] - total[first]) / np.maximum(size, 1), -np.inf)
            most = np.full(len(texts), -np.inf)
            if len(ratio):
                most[n > 0] = np.maximum.reduceat(mean, begin[:-1][n > 0])
            out.append(np.where(n > 0, most, 0.0))
        return np.stack([*out, np.log1p(n)], axis=1)

    def _value_set(self) -> pa.Array:
        return pa.array(self.words, pa.string())


@dataclass
class Model:
    """Ratios and the logistic curve over their evidence; without ratios every score is the share."""

    ratios: Ratios | None
    weights: np.ndarray
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(texts), self.share)
        return _logistic(self.ratios.evidence(texts), self.weights)


def _logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ w[1:] + w[0], -500, 500)))


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of a logistic curve (the first: alone) by Newton's method with a small ridge, and its loss."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    penalty = ridge * weight.sum() * np.append(0.0, np.ones(x.shape[1]))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (weight * (y - p)) - penalty * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30))), 1e-6, 1 - 1e-6)
    loss = float(-(weight * np.where(y > 0, np.log(p), np.log(1 - p))).sum() / weight.sum())
    return np.append(w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread), loss


# --- counts


def _pairs(sample: DataFrame) -> DataFrame:
    """(v, w, t, o): in how many toxic (t) and ordinary (o) texts w follows v, the folds' counts packed into one number;
    v is empty before the first word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch):
                names, index, text = _words(part.column("text"))
                names = pa.concat_arrays([names.cast(pa.string()), pa.array([""])])
                before = np.concatenate([[len(names) - 1], index[:-1]]) if len(index) else index
                before = np.where(np.concatenate([[True], text[1:] != text[:-1]]), len(names) - 1, before) if len(index) else before
                once = np.unique(np.stack([text, before, index]).astype(np.int64), axis=1)  # each pair of a text once
                unit = np.int64(1) << (_BITS * part.column("fold").to_numpy().astype(np.int64))
                toxic = part.column("toxic").to_numpy().astype(np.int64)
                t, o = (unit * toxic)[once[0]], (unit * (1 - toxic))[once[0]]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(once[1])), names.take(pa.array(once[2])), pa.array(t), pa.array(o)], names=["v", "w", "t", "o"])

    found = sample.select("text", "toxic", "fold").mapInArrow(run, "v string, w string, t long, o long")
    return common.written(found.groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "word-pairs")


def _without(packed: str, fold: int) -> Column:
    """A packed count's sum over the folds but one (FOLDS: over all)."""
    parts = [F.shiftrightunsigned(packed, _BITS * f).bitwiseAND((1 << _BITS) - 1) for f in range(FOLDS) if f != fold]
    return sum(parts[1:], parts[0])


def _counted(pairs: DataFrame) -> tuple:
    """(words, contexts, pairs, totals) above the smallest cutoff, each with a count per class and left-out fold."""
    each = [(c, f) for f in range(FOLDS + 1) for c in ("t", "o")]
    name = lambda c, f: f"{c}{f}"
    full = pairs.select("v", "w", *(_without(c, f).alias(name(c, f)) for c, f in each))
    whole = F.col(name("t", FOLDS)) + F.col(name("o", FOLDS))
    words = full.groupBy("w").agg(*(F.count_if(F.col(name(c, f)) > 0).alias(name(c, f)) for c, f in each))
    contexts = full.where("v <> ''").groupBy("v").agg(*(F.sum(name(c, f)).alias(name(c, f)) for c, f in each))
    least = min(CUTOFFS)
    totals = words.agg(*(F.sum(name(c, f)).alias(name(c, f)) for c, f in each)).first()
    kept = full.where((F.col("v") != "") & (whole >= least))
    return words.where(whole >= least).toPandas(), contexts.where(whole >= least).toPandas(), kept.toPandas(), totals


def _ratios(counted: tuple, fold: int, cutoff: int) -> Ratios:
    words, contexts, pairs, totals = counted
    t, o = f"t{fold}", f"o{fold}"
    pairs = pairs[pairs[t] + pairs[o] >= cutoff]
    paired = set(pairs["v"]) | set(pairs["w"])
    known = words[(words[t] + words[o] >= cutoff) | words["w"].isin(paired)]
    names = sorted(set(known["w"]) | paired)
    place = {w: i for i, w in enumerate(names)}
    at = known["w"].map(place).to_numpy(np.int64)
    total, n, log_p, level = [max(1, int(totals[c] or 0)) for c in (t, o)], np.zeros((2, len(names) + 1)), [], []
    for k, c in enumerate((t, o)):
        n[k, at] = known[c].to_numpy()
        n[k, -1] = max(0.0, total[k] - n[k].sum())
    shared = (n.sum(axis=0) + 0.1) / (n + 0.1 / 2).sum()
    for k in range(2):
        off = np.minimum(n[k], DISCOUNT)
        log_p.append((n[k] - off) / n[k].sum() + off.sum() / n[k].sum() * shared if n[k].sum() else shared)
    v, w = (pairs[c].map(place).to_numpy(np.int64) for c in ("v", "w"))
    of = contexts["v"].map(place)
    fine = of.notna().to_numpy()
    for k, c in enumerate((t, o)):
        seen = np.zeros(len(names) + 1)
        seen[of[fine].to_numpy(np.int64)] = contexts[c].to_numpy()[fine]
        own = np.maximum(pairs[c].to_numpy(float) - DISCOUNT, 0.0)
        own = np.where(seen[v] > 0, own / np.maximum(seen[v], 1.0), 0.0)
        left = np.maximum(1.0 - np.bincount(v, own, len(names) + 1), 1e-6)
        level.append((left, own + left[v] * log_p[k][w]))
    key = v * np.int64(len(names) + 1) + w
    order = np.argsort(key, kind="stable")
    return Ratios(names, np.log(log_p[0] / log_p[1]), np.log(level[0][0] / level[1][0]), key[order], np.log(level[0][1] / level[1][1])[order])


# --- fitting and scoring


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The model of docs (doc_id, text) by labels (doc_id, toxic: 0 or 1), learned from at most most_rows rows a class."""
    spark = docs.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    rows = min(most_rows, *(sizes.get(c, 0) for c in (0, 1)))
    none = Model(None, np.zeros(0), share)
    if not rows:
        return none
    dealt = F.xxhash64("doc_id")
    chosen = [one.where(F.col("toxic") == c).orderBy(dealt, "doc_id").limit(min(most_rows, MOST_TO_ONE * rows)) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # at most two ids a row allowed
    sample = common.written(sample.withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy", "toxic"]).select("text", "toxic", F.pmod("copy", F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    counted = _counted(_pairs(sample))
    trials = [(cutoff, [_ratios(counted, f, cutoff) for f in range(FOLDS)]) for cutoff in CUTOFFS]
    sent = spark.sparkContext.broadcast(trials)
    width = 2 + len(SPANS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch):
                fold = part.column("fold").to_numpy()
                for i, (_, by_fold) in enumerate(sent.value):
                    for f, ratios in enumerate(by_fold):
                        own = part.filter(pa.array(fold == f))
                        if len(own):
                            x = ratios.evidence(own.column("text"))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), own.column("toxic"), *(pa.array(x[:, j]) for j in range(width))], names=["trial", "toxic", *(f"x{j}" for j in range(width))])

    found = sample.mapInArrow(run, "trial int, toxic int, " + ", ".join(f"x{j} double" for j in range(width))).toPandas()
    found = found.sort_values(list(found.columns))  # the same sums whatever the order of rows
    best = None
    for i, cutoff in enumerate(CUTOFFS):
        own = found[found["trial"] == i]
        y = own["toxic"].to_numpy(float)
        if len(set(y)) < 2:
            return none
        weight = np.where(y > 0, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())  # as many as there are labels
        w, loss = _fitted(own[[f"x{j}" for j in range(width)]].to_numpy(), y, weight)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, cutoff, w)
    return Model(_ratios(counted, FOLDS, best[1]), best[2], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any others but score) with score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches(batch):
                keep = [i for i, c in enumerate(names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(sent.value.scores(part.column("text")))], names=[*(names[i] for i in keep), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, score double")
