"""Toxicity, whitening and collocations against brute force, held-out accuracy and odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import collocations, common, queries, toxicity, whitening

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "de"), (2, "", None), (3, "   \n", "en"), (4, "A b. c", "en"), (4, "A b. c", "en"), (None, "a b c", None), (5, "\x1c x\x1cy\x0bz", "en"), (6, "É " * 40, ""), (7, "w " * 3000, "en"), (8, "x" * 5000 + " y", "en"), (9, "! . ; :", "fr")]


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("score", "toxic", "key", "fold", "phrase", "n")})


# --- toxicity


def test_ratios_are_kneser_ney():
    """One pair model by hand: discounts, class continuation counts, shared backoff."""
    import pandas as pd

    n = toxicity.FOLDS
    words = pd.DataFrame({"w": ["bad", "day", "good"], f"t{n}": [6, 3, 1], f"o{n}": [0, 3, 5]})
    contexts = pd.DataFrame({"v": ["bad", "good"], f"t{n}": [8, 2], f"o{n}": [0, 10]})
    pairs = pd.DataFrame({"v": ["bad", "good"], "w": ["day", "day"], f"t{n}": [6, 0], f"o{n}": [0, 6]})
    r = toxicity._ratios((words, contexts, pairs, {f"t{n}": 12, f"o{n}": 10}), n, 3)
    d = toxicity.DISCOUNT
    counts = {"t": {"bad": 6, "day": 3, "good": 1, None: 2}, "o": {"bad": 0, "day": 3, "good": 5, None: 2}}
    both = {w: counts["t"][w] + counts["o"][w] + 0.1 for w in counts["t"]}
    shared = {w: x / (sum(both.values()) + 0.0) for w, x in both.items()}
    one = {c: {w: (x - min(x, d)) / sum(own.values()) + sum(min(y, d) for y in own.values()) / sum(own.values()) * shared[w] for w, x in own.items()} for c, own in counts.items()}
    for i, w in enumerate([*r.words, None]):
        assert math.isclose(r.word[i], math.log(one["t"][w] / one["o"][w]), rel_tol=0.05)
    bad_day = (6 - d) / 8 + (1 - (6 - d) / 8) * one["t"]["day"]
    place = {w: i for i, w in enumerate(r.words)}
    at = r.keys.tolist().index(place["bad"] * 4 + place["day"])
    assert math.isclose(r.pair[at], math.log(bad_day / one["o"]["day"]), rel_tol=0.05)
    texts = pa.array(["bad day good zzz", "", "BAD, day!"])
    x = r.evidence(texts)
    steps = [r.word[place["bad"]], r.pair[at], r.word[place["good"]] + r.after[place["day"]], r.word[-1] + r.after[place["good"]]]
    assert math.isclose(x[0, 0], np.mean(steps)) and (x[1] == 0).all() and math.isclose(x[2, 1], np.mean(steps[:2]))


def test_spans_are_the_largest_means():
    rng = random.Random(2)
    r = toxicity.Ratios(["a", "b"], np.array([1.0, -0.5, 0.1]), np.zeros(3), np.zeros(0, np.int64), np.zeros(0))
    texts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(n)) for n in (1, 5, 8, 40, 300)]
    x = r.evidence(pa.array(texts))
    for row, t in zip(x, texts, strict=True):
        v = [{"a": 1.0, "b": -0.5, "c": 0.1}[w] for w in t.split()]
        assert math.isclose(row[0], np.mean(v)) and math.isclose(row[-1], math.log1p(len(v)))
        for k, span in enumerate(toxicity.SPANS):
            size = min(span, len(v))
            assert math.isclose(row[1 + k], max(np.mean(v[i : i + size]) for i in range(len(v) - size + 1)), abs_tol=1e-12)


def _insults(spark, n=1500, share=0.2):
    rng = random.Random(12)
    ordinary = [f"w{int(rng.paretovariate(1.1))}" for _ in range(20_000)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(ordinary) for _ in range(rng.randint(3, 400))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["blorp", "Zarg,", "fleeb"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = _insults(spark)
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 4 <> 2"), marks.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [(i, t) for i, t in labels if i % 4 == 2]
    assert sum(got[i] >= 0.3 for i, t in held if t) >= 0.95 * sum(t for _, t in held)
    assert sum(got[i] >= 0.3 for i, t in held if not t) <= 0.02 * len(held)
    again = toxicity.fit(docs.repartition(7).where("doc_id % 4 <> 2"), marks.repartition(3).where("doc_id % 4 <> 2"))
    assert np.allclose(again.weights, model.weights) and again.ratios.words == model.ratios.words


def test_toxicity_of_odd_rows(spark):
    rows, labels = _insults(spark, 300)
    docs = docs_of(spark, rows)
    marks = spark.createDataFrame([*labels, (0, 1), (5, None), (6, 7), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs_of(spark).select("doc_id", "text", "lang"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3, 9)}) == 1  # no evidence
    for some, share in ((marks.limit(0), 0.0), (marks.where("toxic = 1"), 1.0), (marks.where("toxic = 0"), 0.0)):
        assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, some)).collect()} == {share}
    assert toxicity.score(docs.limit(0).select("doc_id", "text"), toxicity.fit(docs.limit(0), marks)).count() == 0


def test_toxicity_query(spark):
    got = queries.QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.01")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    both = got.join(labels, "doc_id").where("held_out")
    assert got.count() == common.table(spark, "/root/testdata/sf0.01", "documents").count()
    assert both.where("toxic = 0 AND predicted = 1").count() <= 0.05 * both.where("toxic = 0").count()
    assert both.where("toxic = 1 AND predicted = 1").count() >= 0.5 * both.where("toxic = 1").count()
    assert got.where("predicted <> CAST(score >= 0.3 AS INT)").count() == 0


# --- whitening


@pytest.mark.parametrize("kind", ["random", "equal", "one", "low", "split", "zero"])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 65])
def test_leading_components(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {"random": np.abs(rng.normal(size=n)) * 10, "equal": np.r_[[5.0] * min(n, 3), np.ones(n)][:n], "one": np.ones(n), "low": np.r_[3.0, 1.0, np.zeros(n)][:n], "split": np.r_[2.0, 2.0 - 1e-9, np.linspace(0, 1, n)][:n], "zero": np.zeros(n)}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.leading_components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    want = want[want > n * whitening.EPS * max(np.trace(a), 0)]
    assert len(e) == len(want) and np.allclose(e, want, rtol=0, atol=1e-13 * max(1, np.abs(values).max()) * n)
    assert np.allclose(v.T @ v, np.eye(len(e)), atol=1e-14 * n) and np.allclose(a @ v, v * e, atol=1e-13 * n * max(1, np.abs(values).max()))
    d, off, _ = whitening.tridiagonal(a)
    assert np.allclose(np.linalg.eigvalsh(np.diag(d) + np.diag(off, 1) + np.diag(off, -1)), np.linalg.eigvalsh(a), atol=1e-12 * max(1, np.abs(values).max()))
    for x in rng.normal(size=5) * 5:
        assert whitening.sturm_count(d, off, np.array([x]))[0] == (np.linalg.eigvalsh(a) < x).sum()


def _whole(rows, k=4):
    """The contract in plain numpy over (vec_id, vector) rows that are kept."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], object)
    u = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(u), u.sum(axis=0)
    y = (n * u - s).astype(float) / n
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    keep = [i for i in range(len(e) - 1, -1, -1) if e[i] > len(e) * whitening.EPS * np.trace(cov)][:k]
    z = ((n * x - s).astype(float) / n) @ vec[:, keep] / np.sqrt(e[keep])
    return n, [int(v) for v in ((n * x - s) ** 2).sum(axis=1)], z, e[keep] / np.trace(cov)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_whitening_against_numpy(spark, shift):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + shift
    rows = [(i, [float(c) for c in base[i % 300]]) for i in range(400)] + [(i, [float(c) for c in base[0]]) for i in range(900, 1100)]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [1.0, 2.0]), (None, [float(c) for c in base[1]])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("x", "component", "n", "row")})
    got = whitening.whiten(df.repartition(5)).collect()
    kept = [*rows, bad[-1]]
    n, deviation, z, explained = _whole(kept)
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and all(r.identity_error < 1e-8 for r in got)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    signs = [np.sign(by[0][j + 1].whitened * z[0, j]) for j in range(4)]
    for (i, _), dev, want in zip(kept, deviation, z, strict=True):
        for j in range(4):
            r = by[i][j + 1]
            assert r.deviation == dev and math.isclose(r.whitened, signs[j] * want[j], abs_tol=1e-7) and math.isclose(r.explained, explained[j], rel_tol=1e-6)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows, n in (([], 0), ([(1, [0.5, 0.25])], 0), ([(1, [0.5, 0.25]), (2, [0.5, 0.25])], 0), ([(1, [0.5, 0.25]), (2, [1.5, 0.25])], 2), ([(1, None)], 0)):
        got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == n and all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 for r in got)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in huge] == [None, None] and sorted(round(r.whitened, 9) for r in huge) == [-1, 1]


def test_whitening_query(spark):
    got = queries.QUERIES["op12_whitening"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, SF, "embeddings").collect()]
    n, deviation, z, explained = _whole(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-4
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]] and math.isclose(abs(r.whitened), abs(z[at[r.vec_id], r.component - 1]), abs_tol=1e-9) and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)


# --- collocations


def brute(rows, least=30, share=80, top=2000, most=4):
    counts, n, first = defaultdict(Counter), Counter(), {}
    for d, t, lang in rows:
        lang = "und" if lang is None else lang
        low = (t or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, most + 1):
                for i in range(len(w) - s + 1):
                    p = tuple(w[i : i + s])
                    counts[lang][p] += 1
                    if d is not None:
                        first[lang, p] = min(d, first.get((lang, p), d))
    out = []
    for lang, c in counts.items():
        f = {p: x for p, x in c.items() if x >= least}
        gone = {q for p, x in f.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * x >= share * f[q := p[i : i + s]]}
        ranked = []
        for p, a in f.items():
            if len(p) > 1 and p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], first.get((lang, p))))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s, d) for i, (s, a, p, l, r, d) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out, key=str)


def test_collocations_against_counting(spark):
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "city", "é", "x\x1cy", "a-b", "😀", "w"]
    rows = [(i, "".join(rng.choice([*words, "new york city", "in the city of"]) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "?! "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for i in range(500)]
    df = docs_of(spark, [*rows, *ODD]).repartition(6)
    for least, top in ((30, 2000), (5, 7)):
        got = sorted((tuple(r) for r in collocations.collocations(df, least=least, top=top).collect()), key=str)
        assert got == brute([*rows, *ODD], least, 80, top)
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(docs_of(spark)).where("lang = 'de'").count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    rows = [(i, f"{'ab cd' if i % 2 else 'ef gh'} z{i}", "en") for i in range(100)]
    plain = collocations.Words.keys

    def few(self, n):  # all n-grams of a slice share four fingerprints
        at, key = plain(self, n)
        return at, key & np.uint64(0xC000000000000000)

    monkeypatch.setattr(collocations.Words, "keys", few)
    w = collocations.Words(np.frombuffer(b"ab cd ef gh ab cd", np.uint8), np.array([0]), np.array([1], np.uint64))
    at, key = w.keys(2)
    first, count, low = collocations._verified(w, at, key, 2, w.names().indices.to_numpy(), np.array([7]))
    found = {tuple(w.names().take(pa.array([i, i + 1])).to_pylist()): c for i, c in zip(first.tolist(), count.tolist(), strict=True)}
    assert set(low.tolist()) == {7} and found == {("ab", "cd"): 2, ("cd", "ef"): 1, ("ef", "gh"): 1, ("gh", "ab"): 1}
    monkeypatch.undo()
    assert sorted((r.phrase, r.a) for r in collocations.collocations(docs_of(spark, rows)).collect()) == [("ab cd", 50), ("ef gh", 50)]


def test_long_texts_are_cut_behind_separators(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 64)
    text = "".join(f"alpha beta gamma {'.' if i % 3 else ' delta '}" for i in range(200))
    rows = [(1, text, "en"), (2, "no separator " * 50, "en")]
    assert sorted((tuple(r) for r in collocations.collocations(docs_of(spark, rows)).collect()), key=str) == brute(rows)


def test_words_and_bitmaps(spark):
    texts = ["Ab  cd.ef", "", "x", " \t", "é ü z"]
    data = [t.lower().encode() for t in texts]
    w = collocations.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])[:-1], np.arange(5, dtype=np.uint64))
    assert w.names().to_pylist() == ["ab", "cd", "ef", "x", "é ü", "z"] and w.text.tolist() == [0, 0, 0, 2, 4, 4]
    assert w.keys(2)[0].tolist() == [0, 4]
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    bits = collocations.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert collocations.passes(bits, keys.view(np.uint64)).all()
    assert collocations.passes(bits, np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)).mean() < 0.2
    assert not collocations.passes(collocations.bitmap(spark.createDataFrame([], "key long")), keys.view(np.uint64)).any()
