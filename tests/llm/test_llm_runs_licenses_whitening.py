"""Periodic runs, licence scans and whitening against brute force, on random and on awkward rows."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import awkward, docs, sentences
from pyspark.sql import functions as F

from ratingspark.llm import licenses, periodic, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- periodic runs

def brute_runs(words, least=12):
    """(start, length, period) of all runs: every period's maximal stretches, each with its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.choice([0, 1, 12, 60, 250]))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                p = rng.randint(1, 1 + (len(words) - a) // 2)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts += [words] * rng.choice([1, 1, 2])
        least = rng.choice([2, 12])
        runs, starts = periodic.runs_of(texts, least)
        for words, at in zip(texts, starts.tolist(), strict=True):
            mine = sorted((s - at, e - s, q) for s, e, q in runs.tolist() if at <= s < at + len(words))
            assert mine == brute_runs(words, least)


def test_extensions_equal_a_scan():
    """Both directions on a string whose parse has long blocks (powers of two) beside a structured part."""
    rng = np.random.default_rng(3)
    part = [0] * 64 + [1] + [0] * 63 + [2, 3] * 40 + list(rng.integers(0, 3, 200))
    s = np.array([100, *part, 101, *part[17:], 102])
    grammar = periodic.Grammar(s)
    x = rng.integers(1, len(part), 500)
    y = np.minimum(x + rng.integers(1, len(s) - len(part) - 1, 500), len(s) - 2)
    x, y = x[s[y] < 100], y[s[y] < 100]
    ahead, back = grammar.extend(x, y, True), grammar.extend(x, y, False)
    for i, j, a, b in zip(x.tolist(), y.tolist(), ahead.tolist(), back.tolist(), strict=True):
        n = next(k for k in range(len(s)) if s[i + k] != s[j + k])
        m = next(k for k in range(len(s)) if s[i - k] != s[j - k])
        assert (a, b) == (i + n, i - m)


def test_a_text_of_one_word_and_pieces_of_candidates(monkeypatch):
    whole = periodic.runs_of([["a"] * 5000, ["b", "c"] * 700])[0].tolist()
    assert whole == [[1, 5001, 1], [5002, 6402, 2]]
    monkeypatch.setattr(periodic, "PIECE", 300)
    assert periodic.runs_of([["a"] * 5000, ["b", "c"] * 700])[0].tolist() == whole


def expected_periodic(doc_id, text):
    words = plant(doc_id, text)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_periodic_rows_awkward(spark, monkeypatch):
    rows = awkward(8) + [(100, "x " * 40), (101, " ".join(["la", "la", "le"] * 30) + " end"), (102, "ab " * 6 + "c " * 12)]
    rows += [(i, s) for i, s in enumerate(sentences(9, 40, 90), 200)]
    monkeypatch.setattr(periodic, "CHUNK", 500)  # several chunks in a batch
    table = docs(spark, rows)
    found = periodic.digests(periodic.find_runs(table.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))))
    mine = sorted(map(tuple, found.drop("n_words").collect()), key=repr)
    assert mine == sorted((expected_periodic(d, t) for d, t, *_ in rows), key=repr)
    assert periodic.digests(periodic.find_runs(table.limit(0))).count() == 0


def test_periodic_query_on_the_table(spark, sf_small):
    table = {(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect() if len(r.text) < 6000}
    mine = {r.doc_id: tuple(r) for r in queries.REGISTRY["op11_periodic"](spark, sf_small).drop("n_words").collect()}
    assert len(mine) >= len(table)
    for doc_id, text in table:
        assert mine[doc_id] == expected_periodic(doc_id, text)


# ---------------------------------------------------------------- licence scans

BETWEEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def expected_base(text):
    words = BETWEEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def license_cases():
    apache = "Licensed under the Apache License, Version 2.0"
    bsd = next(t.text for t in licenses.TEMPLATES if t.label == "bsd")
    w = bsd.split()
    s = sentences(4, 6)
    return [(100, "CC-BY cc by\nCC\tBY, all RIGHTS reserved.", "cc-by,reserved"), (101, f"{s[0]} {apache}. {s[1]}", "apache-2.0"),
            (102, s[2] + " GNU General-Public_License " + s[3], "gpl"), (103, bsd.upper(), "bsd"),
            (104, " ".join(w[:9] + ["really"] + w[9:]), "bsd"),  # a word put in: two neighbouring diagonals
            (105, " ".join(w[:9] + ["or"] + w[10:]), "bsd"),  # a word changed: one diagonal, 19 of 20 words
            (106, " ".join(w[:5]) + " " + s[4] + " " + " ".join(w[8:12]), ""), (107, " ".join(reversed(w)), ""),
            (108, "cc by " * 50, "cc-by"), (109, "all rights ccé by reserved", ""), (110, "license, version 2.0 " * 3, "")]


def test_license_rows(spark):
    cases = license_cases()
    rows = awkward(3) + [(d, t) for d, t, _ in cases] + [(None, "cc by"), (None, "cc by"), (None, "no licence"), (7, "CC BY")]
    mine = licenses.scan(docs(spark, rows)).collect()
    base = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in mine), key=repr)
    assert base == sorted(((d, *expected_base(t)) for d, t, *_ in rows), key=repr)
    labels = {r.doc_id: r.labels for r in mine}
    assert {d: labels[d] for d, _, _ in cases} == {d: x for d, _, x in cases}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in mine)
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_spans_cover_an_edited_notice(spark):
    notice = next(t for t in licenses.TEMPLATES if t.label == "isc")
    w = BETWEEN.findall(notice.text.lower())
    edited = " ".join(["so", "it", "is", *w[:8], "new", "words", *w[8:]])
    (r,) = licenses.spans(docs(spark, [(1, edited)])).filter("label = 'isc'").collect()
    assert (r.start, r.end, r.coverage) == (3, 3 + len(w) + 2, 1.0)


def test_many_templates_are_not_broadcast(spark, monkeypatch):
    rows = awkward(5) + [(d, t) for d, t, _ in license_cases()]
    want = sorted(map(repr, licenses.scan(docs(spark, rows)).collect()))
    monkeypatch.setattr(licenses, "BROADCAST", 10)
    assert sorted(map(repr, licenses.scan(docs(spark, rows)).collect())) == want


def test_licenses_run_no_python(spark):
    plan = licenses.spans(docs(spark, awkward(1)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- whitening

def vectors(spark, rows):
    """(vec_id, embedding) with other columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "vec_id long, embedding array<float>, key string, x long, s long")


def exact_cov(x):
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x]
    d = len(sums)
    return n, y, np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(120, 10)) @ rng.normal(size=(10, 10)) + 50
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(data.astype(np.float32))]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 9 + [None]), (903, [1.0] * 9 + [float("nan")]),
             (904, [float("-inf")] * 10), (905, [1.0] * 3), (906, [3e38] * 10)]
    fine = [r for r in rows if r[0] is None or r[0] < 900]
    x = [[int(np.floor(1024 * v)) + 100_000 for v in r] for _, r in fine]
    n, y, cov = exact_cov(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    out = whitening.whiten(vectors(spark, rows), 8, 1024, 100_000).toPandas()
    assert len(out) == 8 * len(fine) and set(out.n) == {n}
    want = sorted((repr(r[0]), sum(v * v for v in row)) for r, row in zip(fine, y, strict=True))
    one = out[out.component == 1]
    assert sorted((repr(None if np.isnan(k) else int(k)), int(d)) for k, d in zip(one.vec_id, one.deviation, strict=True)) == want
    z = np.array(y) / n @ axes / np.sqrt(values)
    for c in range(8):
        mine = out[out.component == c + 1].sort_values(["vec_id", "whitened"])
        theirs = min((np.abs(np.sort(mine.whitened) - np.sort(s * z[:, c])).max() for s in (1, -1)))
        assert theirs < 1e-9
        assert np.allclose(mine.explained, values[c] / np.trace(cov), rtol=1e-10)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9


def test_covariance_is_the_nearest_double():
    rng = np.random.default_rng(7)
    x = rng.integers(-3000, 3000, size=(50, 6)) + 10**9
    n, _, cov = exact_cov(x.tolist())
    sums = [int(s) for s in x.sum(axis=0)]
    floors = [s // n for s in sums]
    rests = [s - n * m for s, m in zip(sums, floors, strict=True)]
    assert (whitening.covariance(n, rests, whitening.squares(whitening._centred(x, floors))) == cov).all()


def test_squares_beyond_64_bits():
    y = np.array([[2**40, -(2**41)], [3, 2**39]])
    plain = [[int(v) for v in r] for r in y]
    want = [sum(r[0] ** 2 for r in plain), sum(r[1] ** 2 for r in plain), sum((r[0] + r[1]) ** 2 for r in plain)]
    assert whitening.squares(y) == want
    far = [(i, [float(v) for v in r]) for i, r in enumerate([[1e15, 1.0], [-1e15, 2.0], [5.0, 9.0]])]
    assert whitening._centred(np.array([[2**61 + 5, 1]]), [-(2**61), 0]).tolist() == [[2**62 + 5, 1]] and far


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    (one,) = whitening.whiten(vectors(spark, [(1, [2.0])])).collect()
    assert (one.n, one.component, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 1, 0, None, None, None)
    flat = whitening.whiten(vectors(spark, [(i, [float(i % 3), 7.0]) for i in range(9)])).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all()
    assert flat.identity_error.max() < 1e-12


def test_whitening_query_on_the_table(spark, sf_small):
    out = queries.REGISTRY["op13_whitening"](spark, sf_small).toPandas()
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(8)).max() < 1e-9
    assert out.deviation.dtype == np.int64 and (out.groupby("component").explained.first().diff()[1:] <= 0).all()
