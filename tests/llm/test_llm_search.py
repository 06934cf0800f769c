"""op2 and op4: near duplicates and repeated byte strings against brute force."""
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from llm_cases import awkward, docs, sentences

from ratingspark.llm import components, repeats, simhash


def brute_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_pairs(prints, bits):
    a = np.array(prints, np.uint64)
    return [(i, int(j) + i + 1) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= bits)]


def test_components_of_near_copies(spark):
    rng = random.Random(4)
    pairs = awkward()
    for i, t in enumerate(sentences(9, 20, 300)):
        for k in range(6):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            pairs.append((100 + 10 * i + k, " ".join(words)))
    rows = simhash.near_duplicates(docs(spark, pairs)).collect()
    prints = [brute_print(t) for _, t, *_ in pairs]
    label = roots(len(pairs), near_pairs(prints, 4))
    best = {}
    for (d, *_), r in zip(pairs, label, strict=True):
        if d is not None:
            best[r] = min(d, best.get(r, d))
    expected = Counter((d, f"{p:016x}", best.get(r)) for (d, *_), p, r in zip(pairs, prints, label, strict=True))
    assert Counter(tuple(r) for r in rows) == expected
    assert len({r for r in label}) < len(pairs) - 40


def test_trees_lose_no_link(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, 1500, np.uint64)
    near = rng.choice(base, 1500)
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    dense = np.full(1500, base[0])  # one large group of near copies
    for _ in range(5):
        dense = dense ^ (np.uint64(1) << rng.integers(0, 64, len(dense)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, dense]))
    whole = simhash.Forest(len(fps))
    a, b = zip(*near_pairs(fps, 4), strict=True)
    whole.link(np.array(a), np.array(b))
    monkeypatch.setattr(simhash, "SHARD", 300)
    found, leaves = simhash.Forest(len(fps)), 0
    for t, mask in enumerate(simhash._parts(3)):
        tree = simhash.grow(rng.permutation(fps)[:1000], len(fps), mask, 1, 4, t)
        for _, where in simhash.route(tree, fps):
            leaves += 1
            first = simhash.link_near(fps[where], 4, mask, 1)
            found.link(where, where[first])
    assert leaves > 20
    assert (found.label == whole.label).all()


def test_near_dedup_keeps_one_of_each(spark):
    odd = docs(spark, awkward())
    rows = simhash.deduplicate(odd).collect()
    named = [r.doc_id for r in rows if r.doc_id is not None]
    parts = {r.component_id for r in simhash.near_duplicates(odd.filter("doc_id is not null")).collect()}
    assert sorted(named) == sorted(parts)
    assert sum(r.doc_id is None for r in rows) == 1  # the two rows without an id are copies of one text
    assert simhash.deduplicate(odd).columns == odd.columns
    assert simhash.deduplicate(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_contraction_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(80)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.label for r in rows}
    assert len(rows) == len(label) == 61 + 81 + 2
    assert len({label[i] for i in range(61)}) == len({label[i] for i in range(100, 181)}) == 1
    assert len(set(label.values())) == 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(texts, length):
    n = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i:i + length]] > 1:
                m[i:i + length] = True
        masks.append(m)
    return masks


def expected_rows(pairs, length=400):
    texts = [(t or "").encode() for _, t, *_ in pairs]
    out = Counter()
    for (d, *_), t, m in zip(pairs, texts, brute_removed(texts, length), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        runs = int((np.diff(np.concatenate([[0], m.astype(np.int8)])) == 1).sum())
        out[(d, len(t), int(m.sum()), runs, sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("piece", [1 << 20, 600])
def test_repeats(spark, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(8)
    passages = [" ".join(sentences(20 + i, 3, 45)) for i in range(4)]
    pairs = awkward() + [(30, passages[0]), (31, "a" + passages[0] + "b"), (32, passages[0][5:] + passages[0][:-7])]
    for i in range(25):
        parts = [rng.choice([p, p[rng.randrange(200):], p[:-rng.randrange(1, 200)]]) for p in rng.choices(passages, k=rng.randint(1, 3))]
        pairs.append((40 + i, "".join(x + " ".join(sentences(99 + i, 1, rng.randrange(9))) for x in parts)))
    df = repeats.remove_repeats(docs(spark, pairs))
    rows = df.collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected_rows(pairs)
    assert all(sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in rows)


@pytest.mark.parametrize("length", [400, 1600])
def test_thue_morse_words_are_not_repeats(spark, length):
    """Such words of 1,024 letters and their complements agree in every polynomial modulo 2^64."""
    rng = random.Random(5)
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    head, tail = (" ".join(sentences(60 + i, 2, 60)) for i in range(2))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    pairs = [(i, head[-300:] + t + tail[:276]) for i, t in enumerate(texts)]
    pairs += [(10 + i, "".join(rng.choice("xyz") for _ in range(700)) + t) for i, t in enumerate(texts)]
    got = repeats.remove_repeats(docs(spark, pairs), length).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected_rows(pairs, length)


def test_substring_hashes_are_polynomials_modulo_a_prime():
    data = np.random.default_rng(1).integers(0, 256, 3000, np.uint8)
    roll, prime = repeats.Rolling(data), (1 << 31) - 1
    start, end = np.array([0, 7, 2000, 2999, 5]), np.array([3000, 407, 3000, 3000, 5])
    for j, x in enumerate(roll.points):
        expected = [sum((int(data[i]) + 1) * pow(x, i - a, prime) for i in range(a, b)) % prime
                    for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        assert roll._at(j, start, end).tolist() == expected


def test_one_interval_of_many_hulls(spark):
    """Every window holds one interval's bytes and differs beyond them: no task may add up or hand out all its hulls."""
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).cast("long").alias("core"),
                                      F.xxhash64("id").alias("hull1"), F.lit(0).cast("long").alias("hull2"),
                                      F.when(F.col("id") % 100 == 0, 2).otherwise(1).cast("long").alias("same"), F.col("id").alias("witness"))
    found = repeats._with_totals(rows)
    assert {(r.core, r.open, r.n) for r in found.groupBy("core", "open").agg(F.count("*").alias("n")).filter("core = 7").collect()} == {(7, 29_700, 30_000)}
    assert found.filter("core <> 7").agg(F.min("same"), F.max("open"), F.count("*")).first() == (2, 0, 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 15_000


def test_anchors_of_one_interval_are_not_shuffled(spark):
    """A third of the anchors share an interval, as where one passage is in a third of the documents."""
    from pyspark.sql import functions as F

    from ratingspark.llm.common import stored

    rows = stored(spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.floor(F.col("id") / 2) + 10).cast("long").alias("core"),
                                             F.when(F.col("id") % 7 == 0, 2).otherwise(1).alias("weight")), "anchors")
    found = repeats._shared(rows)
    n = Counter()
    for r in rows.collect():
        n[r.core] += r.weight
    assert sorted(map(tuple, found.select("id", "core", "weight").collect())) == sorted(tuple(r) for r in rows.collect() if n[r.core] > 1)
    assert "BroadcastHashJoin [core" in found._jdf.queryExecution().toString()
    assert repeats._shared(rows.limit(0)).count() == 0


def test_no_table_stays_in_the_catalog(spark):
    got = repeats.remove_repeats(docs(spark, [(1, "x" * 500), (2, "y" * 10)]))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 500, 2: 0}


def test_repeats_of_empty_and_short_tables(spark):
    assert repeats.remove_repeats(docs(spark, [(1, "x")]).limit(0)).count() == 0
    pairs = [(1, None), (2, ""), (3, "x" * 399), (3, "x" * 399)]
    assert Counter(tuple(r)[:5] for r in repeats.remove_repeats(docs(spark, pairs)).collect()) == expected_rows(pairs)


def test_anchor_offsets_cover_every_window_once():
    data = np.frombuffer((" ".join(sentences(3, 40)) + "z" * 900).encode(), np.uint8)
    a, low, high, _ = repeats.anchors(data, 400)
    starts = np.concatenate([np.arange(x - h, x - lo + 1) for x, lo, h in zip(a, low, high, strict=True)])
    assert (np.sort(starts) == np.arange(len(data) - 399)).all()
