"""op3, op5, op6, op7: models and tokens against the library, by held-out accuracy, sums to one and exact counts."""
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward, docs, sentences
from pyspark.sql.types import LongType, StructField, StructType

from ratingspark.llm import bpe, brown, compression, urls
from ratingspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, awkward())


# --- op7 ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(tokenizer_path()))


def check_text(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_tokens_equal_the_library(encoder, library):
    rng = random.Random(2)
    alphabet = "abcdefe  \n\t'sdTLL123 éß<|endoftext|>!?%汉字🙂\u0301\u00a0\u2028\x1c\x85"
    for _ in range(1500):
        check_text(encoder, library, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))))
    for text in ("", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ab" * 2000, "the" * 300 + "ing" * 300, "x" * 5000):
        check_text(encoder, library, text)


def test_short_and_long_merges_agree(encoder):
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("theingro") for _ in range(rng.randint(1, 200))).encode()
        parts = [encoder.byte_id[b] for b in word]
        assert encoder.merge_short(list(parts)) == encoder.merge_long(list(parts))


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    check_text(bpe.Encoder(bpe.load(tokenizer_path())), library, " ".join(sentences(4, 3)))


def test_round_trip_rows(odd, library):
    path = tokenizer_path()
    expected = Counter()
    for d, t, *_ in awkward():
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[(d, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(odd, path).collect()) == expected
    back = bpe.decode(bpe.encode(odd, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t, *_ in awkward())
    assert bpe.round_trip(odd.limit(0), path).count() == 0


# --- op6 ---------------------------------------------------------------------------------------------------------

def labelled(spark, n=400):
    texts = sentences(11, n, 80)
    rows, labels = [], []
    for i, t in enumerate(texts):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + random.Random(i).choice(["###", "$$$", "***"]) for w in t.split()) if bad else t))
        labels.append((i, 0 if bad else 1, 0))
    return rows, spark.createDataFrame([*labels, (5000, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_texts(spark):
    rows, labels = labelled(spark)
    got = {r.doc_id: r for r in compression.score(docs(spark, rows), labels).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all(got[i].held_out == (i in held) for i, _ in rows)
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_labels_of_the_held_out_fold_are_not_learned_from(spark):
    from pyspark.sql import functions as F

    rows, labels = labelled(spark)
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, compression.score(docs(spark, rows), x).collect())) for x in (labels, other))
    assert one == two


def test_classifier_on_awkward_rows(spark, odd):
    _, labels = labelled(spark)
    assert compression.score(odd, labels).count() == len(awkward())  # no labelled text of class 0: nothing to learn
    assert {r.score for r in compression.score(odd, labels.limit(0)).collect()} == {0.5}
    rows, labels = labelled(spark)
    shifted = [(i + 1000, t) for i, t in rows] + awkward()
    got = compression.score(docs(spark, shifted), labels.selectExpr("doc_id + 1000 as doc_id", "quality")).collect()
    assert len(got) == len(shifted)
    empty = {r.score for r in got if r.doc_id in (4, 5)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    assert compression.score(odd.limit(0), labels).count() == 0


def test_accepted_keeps_rows_whole(spark):
    rows, labels = labelled(spark)
    table = docs(spark, rows)
    kept = compression.accepted(table, labels).collect()
    good = {r.doc_id for r in compression.score(table, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept} == good and 280 < len(kept) < 320
    assert {tuple(r) for r in kept} <= {tuple(r) for r in table.collect()}


# --- op5 ---------------------------------------------------------------------------------------------------------

def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_scores_and_counts(spark, monkeypatch):
    rng = random.Random(5)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    pairs = awkward()
    for i in range(600):  # a- and b-words in turn: a class bigram knows the next class
        pairs.append((100 + i, " ".join(rng.choice(a if k % 2 else b) for k in range(30)) + (" rare%d" % i if i % 7 == 0 else "")))
    monkeypatch.setattr(brown, "HEAD", 60)  # most words take the way through the join
    monkeypatch.setattr(brown, "UNITS", 50)
    rows = brown.score(docs(spark, pairs)).collect()
    learned = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    count = Counter(t for d, x, *_ in pairs if learned(d) for t in tokens(x))
    total, types = sum(count.values()), len(count)
    expected = Counter()
    for d, x, *_ in pairs:
        t = tokens(x)
        base = sum(np.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        expected[(d, not learned(d), len(t), sum(count[w] > 0 for w in t), total, round(float(base), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
    held = [r for r in rows if r.held_out and (r.doc_id or 0) >= 100]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert gain > 0.25  # about log10(2) for each word but the first
    head_only = {r.doc_id: r.score for r in rows if r.doc_id is not None and r.doc_id >= 100}
    monkeypatch.setattr(brown, "HEAD", 10_000)  # nothing joins: the same scores
    again = {r.doc_id: r.score for r in brown.score(docs(spark, pairs)).collect()}
    worst = max(abs(again[d] - s) for d, s in head_only.items())
    assert worst < 2.0  # other ties among units only


def test_next_token_probabilities_sum_to_one(spark):
    table = docs(spark, [(i, t) for i, t in enumerate(sentences(6, 60))]).select("text")
    counts = brown.word_counts(table).cache()
    m = brown.train(table, counts)
    known = 1 - 0.5 / m.denominator
    label = m.label[m.units.head_unit]
    for c in range(brown.CLASSES):
        words = 10 ** (m.head_log + m.step[c, label]) * known
        end = 10 ** (np.log10(m.end_count) + m.step[c, 0]) * known
        dead = [k for k in range(1, brown.CLASSES) if k not in set(label)]  # classes without a word keep their smoothed share
        lost = sum(10 ** m.step[c, k] for k in dead) * known
        assert words.sum() + end + lost + 0.5 / m.denominator == pytest.approx(1, abs=1e-9)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(1)
    truth = np.array([0] + [1 + i % 3 for i in range(60)])
    pairs = np.zeros((61, 61), int)
    for _ in range(20_000):
        a = rng.integers(1, 61)
        b = rng.choice(np.flatnonzero(truth == truth[a] % 3 + 1))
        pairs[a, b] += 1
    got = brown.exchange(pairs, classes=4)
    assert len(set(zip(truth.tolist(), got.tolist(), strict=True))) == 4


def test_words_beyond_the_seeds_are_clustered_by_their_neighbours(spark, monkeypatch):
    rng = random.Random(8)
    a, b = [f"a{i:03d}" for i in range(600)], [f"b{i:03d}" for i in range(600)]  # each ending holds one of either kind
    lines = [" ".join(rng.choice(a if k % 2 else b) for k in range(40)) for _ in range(600)]
    monkeypatch.setattr(brown, "HEAD", 700)  # the others have their class by key
    table = docs(spark, list(enumerate(lines))).select("text")
    m = brown.train(table, brown.word_counts(table).cache())
    assert len(m.units.head_unit) <= 700
    kinds = [m.label[m.units.of([w.encode() for w in names])[1]].tolist() for names in (a, b)]
    both = np.array([np.bincount(k, minlength=m.label.max() + 1) for k in kinds])
    assert both.max(0).sum() > 0.97 * both.sum()


def test_weighed_moves_are_exact():
    rng = np.random.default_rng(3)
    units, classes = 30, 6
    pairs = rng.poisson(rng.choice([0, 0.5, 30], (units, units)))
    label = np.concatenate([[0], rng.integers(1, classes, units - 1)])
    counted = lambda label: np.eye(classes)[label].T @ pairs @ np.eye(classes)[label]
    row, at, times = [], [], []
    for u in range(1, units):
        line, back = pairs[u].copy(), pairs[:, u].copy()
        line[u] = back[u] = 0
        found = np.concatenate([np.bincount(label, line, classes), np.bincount(label, back, classes), [pairs[u, u]]])
        for k in np.flatnonzero(found):
            row, at, times = [*row, u - 1], [*at, k], [*times, found[k]]
    got = brown.Gains(counted(label)).best(np.array(row), np.array(at), np.array(times, float), label[1:])[0]
    for u in range(1, units):
        worth = []
        for c in range(1, classes):
            trial = label.copy()
            trial[u] = c
            worth.append(brown.likelihood(counted(trial)))
        assert worth[got[u - 1] - 1] == pytest.approx(max(worth), abs=1e-6)


def test_nothing_learned_or_nothing_to_score(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    row = brown.score(docs(spark, [(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert brown.score(docs(spark, [(1, "a")]).limit(0)).count() == 0


# --- op3 ---------------------------------------------------------------------------------------------------------

def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = lambda s, marks: s[:min([s.index(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host):], "?#")


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "x://org", "x://org/", "http://notexample.org/en/1", "ftp://b.com/fr/", "http://c.com/de/#z",
        "http://com?/fr/", "nothing", None, "", "://", "a://b://c/d", "http://www.cheappills.net/x", "http://www.cheap-pills.net/x",
        "http://quiet-garden.net/a", "http://É.org:80/es/", "http://user@example.org/es/", "HTTP://EXAMPLE.ORG/ES/"]


def pages(spark, urls):
    rows = [(i, u, f"<html><title>quiet garden of cheap pills {i}</title></html>" if i % 2 else None, "x", "y") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, tokens string")


def test_rules_hosts_and_paths(spark):
    rows = urls.judge(pages(spark, URLS)).orderBy("page_id").collect()
    for u, r in zip(URLS, rows, strict=True):
        host, path = brute_url(u)
        assert (r.host, r.path) == (host, path)
        fits = [x for x in urls.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        assert r.rule == (best and best.host + best.path)
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best.verdict)
    assert urls.judge(pages(spark, URLS).limit(0)).count() == 0


def test_segmented_names_are_judged_by_their_words(spark):
    many = [f"http://www.cheap-pills{i}.net/p" for i in range(6)] + [f"http://www.cheap-pills.net/p{i}" for i in range(20)]
    many += [f"http://www.quiet-garden.net/p{i}" for i in range(60)] + ["http://www.cheappills.net/p1", "http://www.quietgarden.net/p1"]
    rows = urls.judge(pages(spark, many)).orderBy("page_id").collect()
    assert rows[-2].tokens[1:3] == ["cheap", "pills"] and rows[-2].verdict == "block"
    assert rows[-1].tokens[1:3] == ["quiet", "garden"] and rows[-1].verdict == "allow"


def test_viterbi_is_the_best_split():
    counts = {"a": 50, "ab": 30, "abc": 4, "b": 9, "bc": 20, "c": 7, "cab": 11}
    s = urls.Segmenter(counts)

    def cost(w):
        return s.cost.get(w, math.log(s.total) + len(w) * math.log(10))

    def splits(x):
        return [[]] if not x else [[x[:i], *r] for i in range(1, len(x) + 1) for r in splits(x[i:])]

    rng = random.Random(1)
    for _ in range(200):
        name = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 9)))
        assert sum(map(cost, s(name))) == pytest.approx(min(sum(map(cost, x)) for x in splits(name)))


def test_every_counted_word_is_used_in_segmentation(spark, monkeypatch):
    monkeypatch.setattr(urls, "VOCABULARY", 30)
    many = [f"http://www.x{'abcdefghijklmnopqrstuvwxyz'[i % 26]}-site.net/word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    many += ["http://www.maple-kettle.net/p", "http://www.maplekettle.org/p"]
    row = urls.judge(pages(spark, many)).filter("host = 'www.maplekettle.org'").first()
    assert row.tokens == ["www", "maple", "kettle", "/p"]


def test_words_of_any_length_are_counted(spark):
    word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    many = [f"http://www.x-{word}.net/p{i}" for i in range(5)] + [f"http://www.garden-q.net/{word}"] * 3
    row = urls.judge(pages(spark, [*many, f"http://www.garden{word}q.org/p"])).filter("host like '%.org'").first()
    assert row.tokens == ["www", "garden", word, "q", "/p"]


def test_naive_bayes_by_hand(spark):
    """Log odds of every row from its own tokens and labels, on long urls, repeated rows and urls without a host too."""
    many = [*URLS, *URLS, "http://" + "cheap" * 4000 + "." + "quiet" * 3000 + ".net/" + "p/" * 20_000, "http://a.net/" + "z" * 100_000]
    many += ["http://free-bets.net/p/1"] * 5 + ["http://quiet-garden.net/p/1"] * 9
    rows = urls.judge(pages(spark, many)).collect()
    assert len(rows) == len(many)
    bad = [bool(set(urls.SEEDS) & {*re.split("[^0-9a-z]+", r.host), *r.tokens}) for r in rows]
    n = {b: Counter(t for r, x in zip(rows, bad, strict=True) if x == b for t in r.tokens) for b in (True, False)}
    size = len(n[True] | n[False]) + 1
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    for r in rows:
        odds = prior + sum(math.log((n[True][t] + 1) / (n[True].total() + size)) - math.log((n[False][t] + 1) / (n[False].total() + size))
                           for t in r.tokens)
        assert r.log_odds == pytest.approx(odds, rel=1e-9, abs=1e-9)
        assert r.rule is not None or r.verdict == ("block" if r.log_odds > 0 else "allow")
    same = [{(r.host, r.path, r.rule, r.verdict, round(r.log_odds, 9)) for r in rows if r.page_id % len(URLS) == i and r.page_id < 2 * len(URLS)}
            for i in range(len(URLS))]
    assert all(len({x[:2] for x in s}) == 1 for s in same)


def test_no_class_count_is_cut(spark, monkeypatch):
    many = [f"http://www.cheap-pills{i}.net/p/only{i % 7}" for i in range(20)]
    many += [f"http://www.quiet-garden{i}.net/p/other{i % 9}/p" for i in range(60)] + [None, "http://www.only3.net/only3/only3"]
    whole = [r.log_odds for r in urls.judge(pages(spark, many)).orderBy("page_id").collect()]
    monkeypatch.setattr(urls, "VOCABULARY", 4)
    again = [r.log_odds for r in urls.judge(pages(spark, many)).orderBy("page_id").collect()]
    assert again == pytest.approx(whole, abs=1e-9) and len(set(whole)) > 10


def test_concatenated_seed_hosts_are_examples_of_block(spark):
    many = ["http://www.cheappills.net/p"] * 40 + ["http://www.cheap-pills.net/p"] * 10 + ["http://www.quiet-garden.net/p"] * 70
    rows = urls.judge(pages(spark, many)).collect()
    assert {(r.host, r.verdict) for r in rows} == {("www.cheappills.net", "block"), ("www.cheap-pills.net", "block"),
                                                   ("www.quiet-garden.net", "allow")}


def test_letters_beside_digits_are_segmented(spark):
    many = ["http://www.cheap-pills.net/p"] * 10 + ["http://www.quiet-garden.net/p"] * 20 + ["http://www.cheappills24.net/p"]
    row = urls.judge(pages(spark, many)).filter("host = 'www.cheappills24.net'").first()
    assert row.tokens == ["www", "cheap", "pills", "24", "/p"] and row.verdict == "block"


def test_brown_units_of_a_batch_equal_those_word_by_word():
    """Every text's units and the words outside the head with their places, by plain Python; keys are made once a batch."""
    rng = np.random.default_rng(3)
    names = [f"W{i}\u00c9" for i in range(60)]
    texts = [None, "", " \t ", "\x0bA  b\fa \u0085x\x1c ", *(" ".join(rng.choice(names, n)) for n in (1, 5, 300, 40))]
    plain = [(t or "").encode().lower().split() for t in texts]
    flat, sizes = brown.all_words(pa.array(["cut", *texts]).slice(1))
    assert flat.to_pylist() == [w for t in plain for w in t] and sizes.tolist() == [len(t) for t in plain]
    head = [(f"w{i}\u00c9".encode().lower(), 90 - 2 * i) for i in range(45)]  # the last ones have the class of their ending
    known = [w.encode().lower() for w in names[45:55]]
    units = brown.Units(head, 20).with_keys(np.sort(np.array([brown.word_key(w) for w in known], np.int64)))

    def unit(w):
        at = dict((h, i) for i, (h, _) in enumerate(head)).get(w)
        if at is not None and head[at][1] >= brown.LEAST:
            return 1 + at
        if w in known:
            return 1 + len(head) + units.keys.tolist().index(brown.word_key(w))
        return units.first_ending + units.ending(w)

    got, tails = units.of_all(flat, sizes)
    assert got.tolist() == [unit(w) for t in plain for w in t]
    for t, tail in zip(plain, tails.to_pylist(), strict=True):
        out = list(dict.fromkeys(w for w in t if unit(w) > len(head)))
        assert tail == [{"word": w, "at": [i for i, x in enumerate(t) if x == w]} for w in out]


class Inside:
    """Stands in for a DataFrame: keeps the function given to mapInArrow, to be called here on batches of the test's."""

    def __init__(self, shared=None):
        self.value, self.sparkSession, self.sparkContext = shared, self, self
        self.schema = StructType([StructField("id", LongType())])

    def __getattr__(self, name):
        return lambda *args, **kwargs: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_brown_takes_large_batches_in_pieces(spark, monkeypatch):
    """One batch of all rows: no step holds all of it at a time, and the sums are those of the whole."""
    rng = np.random.default_rng(4)
    names = np.array([f"w{i}" for i in range(400)])
    texts = [None, "", *(" ".join(rng.choice(names, 60)) for _ in range(300))]
    batch = pa.RecordBatch.from_pydict({"id": np.arange(len(texts)), "text": texts})
    units = brown.Units([(n.encode(), 900 - i) for i, n in enumerate(names[:300])], 20)
    flat, sizes = brown.all_words(batch.column(1))
    unit, tails = units.of_all(flat, sizes)
    seen = []
    real = brown.all_words
    monkeypatch.setattr(brown, "all_words", lambda x: seen.append(x.nbytes) or real(x))
    monkeypatch.setattr(brown, "PIECE", 2000, raising=False)
    monkeypatch.setattr(brown, "WORDS", 700, raising=False)

    got = Counter()
    brown.word_counts(counter := Inside())
    for b in counter.run(iter([batch.select(["text"])])):
        for r in b.to_pylist():
            got[r["word"]] += r["n"]
    assert got == Counter(flat.to_pylist())
    brown.encoded(coder := Inside(), Inside(units))
    lines = pa.Table.from_batches(coder.run(iter([batch])))
    assert max(seen) < 10 * 2000 and len(seen) > 20
    assert lines.column("id").to_pylist() == list(range(len(texts))) and lines.column("tail").to_pylist() == tails.to_pylist()
    line = np.frombuffer(b"".join(lines.column("line").to_pylist()), "<i4")
    assert line[line > 0].tolist() == unit.tolist() and (line == 0).sum() == len(texts)


def test_brown_sums_of_a_large_batch_stay_small():
    """16 million units in one batch: the arrays of a step are under two copies of the batch, and the sums are right."""
    import tracemalloc

    rng = np.random.default_rng(6)
    line = rng.integers(1, 1000, 1 << 24).astype("<i4")
    line[1023::1024] = 0  # lines of 1023 words
    offsets = pa.py_buffer(np.arange(0, 4 * len(line) + 1, 4096, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(line) // 1024, [None, offsets, pa.py_buffer(line)])], ["line"])
    label, group = rng.integers(1, 20, 1000).astype(np.uint16), rng.integers(0, 4, 1000).astype(np.uint8)
    label[0], group[0] = 0, 4
    width = 41
    brown.neighbours(step := Inside(), Inside((label, group)), 1, 20)
    tracemalloc.start()
    found = list(step.run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 128e6

    got = np.zeros(1000 * width, np.int64)
    for b in found:
        for u, bag in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
            at, n = np.frombuffer(bag, "<i4").reshape(-1, 2).T
            got[u * width + at] += n
    before, after = np.append(0, line[:-1]), line
    same = before == after
    left, right = group[before] == 1, (group[after] == 1) & ~same
    key = np.concatenate([before[left] * width + np.where(same[left], 40, label[after[left]]), after[right] * width + 20 + label[before[right]]])
    assert (got == np.bincount(key, minlength=len(got))).all()


def test_brown_moves_of_units_that_span_batches(monkeypatch):
    """Rows sorted by unit, cut anywhere into batches: each unit is weighed once, with all its neighbours."""
    rng = np.random.default_rng(9)
    units, classes = 40, 6
    n = rng.integers(50, 90, (classes, classes))
    label = rng.integers(1, classes, units).astype(np.uint16)
    bags = [(u, np.stack([np.sort(rng.choice(2 * classes, 5, replace=False)), rng.integers(1, 9, 5)], axis=1).astype("<i4").tobytes())
            for u in range(units) for _ in range(30 if u in (0, 7, 39) else rng.integers(1, 4))]
    rows = pa.RecordBatch.from_arrays([pa.array([u for u, _ in bags], pa.int32()), pa.array([b for _, b in bags], pa.binary())], ["unit", "bag"])

    def moved(cuts):
        brown.moves(step := Inside(), Inside((label, None)), n)
        return [r for b in step.run(rows.slice(lo, hi - lo) for lo, hi in zip([0, *cuts], [*cuts, len(bags)], strict=True)) for r in b.to_pylist()]

    whole = moved([])
    assert whole and moved(range(1, len(bags))) == whole and moved([5, 17, 31, 60]) == whole
    monkeypatch.setattr(brown, "PIECE", 100, raising=False)
    assert moved([]) == whole
