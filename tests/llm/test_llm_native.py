"""op1, op8, op9, op10: DataFrame operators against plain Python on awkward rows."""
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from llm_cases import awkward, docs

from ratingspark.llm import exact_dedup, mix, quality_rules, shards

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, awkward())


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [(1, "x")]).limit(0)


def plan_has_no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_counts(odd):
    df = quality_rules.judge(odd)
    plan_has_no_python(df)
    rows = df.collect()
    texts = [t for _, t, *_ in awkward()]
    expected = Counter()
    for (d, t, *_) in awkward():
        w = WORDS(t or "")
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        n, inside = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                inside.update(range(i, i + 8))
        lines = [x for x in (t or "").split("\n") if WORDS(x)]
        expected[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside),
                  len(w) < 20 or 100 * len(inside) > 30 * len(w))] += 1
    assert len(rows) == len(texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == expected
    assert not any(r.kept for r in rows if r.base_failed)
    assert any(r.kept for r in rows)


def test_quality_windows_overlap_and_touch(spark):
    w = [f"w{i}" for i in range(30)]
    cases = [" ".join(w + w), " ".join(w[:9] + w[:9] + w), " ".join(["a"] * 8), " ".join(["a"] * 9), " ".join(w[:8] + ["x"] + w[:8])]
    rows = quality_rules.judge(docs(spark, enumerate(cases))).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [60, 48 - 21, 0, 9, 16]


def test_thresholds_are_one_projection(spark):
    text = "the cat and the dog walked to the house of a friend who was not at home on that very day in spring"
    spoilt = {"symbols": text + " # # # # # #", "shouts": text.replace(" ", "!! "), "lines": "\n".join(["the end of it and so on"] * 9)}
    rows = quality_rules.judge(docs(spark, [(0, text), *((i + 1, t) for i, t in enumerate(spoilt.values()))])).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False, False, False]


def test_quality_of_empty_table(none):
    assert quality_rules.judge(none).count() == 0


def test_shards(odd, none):
    df = shards.assign(odd, 4)
    plan_has_no_python(df)
    rows = df.collect()
    pairs = awkward()
    sizes = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in pairs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == sizes
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(-1 if r.doc_id is None else r.doc_id) for r in in_order] == sorted(-1 if d is None else d for d, *_ in pairs)
    largest, total = max(r.size for r in rows), sum(r.size for r in rows)
    assert all(abs(sum(r.size for r in rows if r.shard <= s) - total * (s + 1) / 4) <= largest / 2 for s in range(4))
    assert shards.assign(none, 4).count() == 0


def test_exact_groups(odd, none):
    for keep, best in (("max", max), ("min", min)):
        df = exact_dedup.assign(odd, keep=keep)
        plan_has_no_python(df)
        groups = defaultdict(list)
        for d, t, *_ in awkward():
            groups[low(t)].append(d)
        expected = Counter()
        for t, ids in groups.items():
            known = [d for d in ids if d is not None]
            stays = best(known) if known else None
            for d in ids:
                expected[(d, stays, len(ids), d == stays, sha256(t.encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in df.collect()) == expected
    assert exact_dedup.assign(none).count() == 0


def test_exact_dedup_keeps_rows_whole(odd, none):
    rows = exact_dedup.deduplicate(odd).collect()
    texts = [low(r.text) for r in rows]
    assert len(texts) == len(set(texts)) == len({low(t) for _, t, *_ in awkward()})
    source = {tuple(r) for r in odd.collect()}
    assert all(tuple(r) in source for r in rows) and exact_dedup.deduplicate(odd).columns == odd.columns
    assert next(r.doc_id for r in rows if low(r.text) == low(awkward()[0][1])) == 0
    assert exact_dedup.deduplicate(none).count() == 0


def filled(sizes, weights, epochs=3):
    """Targets by repeated filling: cap what is above, share the rest again."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(capped.values())) / max(1e-9, sum(weights[s] for s in free))
        above = [s for s in free if level * weights[s] >= epochs * sizes[s]]
        if not above:
            return capped | {s: level * weights[s] for s in free}
        capped |= {s: epochs * sizes[s] for s in above}


def test_mix_targets_and_takes(odd, none):
    df = mix.mix(odd)
    plan_has_no_python(df)
    rows = df.collect()
    size = Counter()
    for d, t, *s in awkward():
        size[(s or ["src0"])[0]] += len(WORDS(t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = filled(size, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert len(rows) == len(awkward())
    for s in order:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(target[s]) for r in own)
        assert sum(r.taken for r in own) == round(target[s])
        assert all(0 <= r.taken <= 3 * r.size and len(r.positions) == r.passes for r in own)
    assert [tuple(r) for r in mix.mix(odd).collect()] == [tuple(r) for r in rows]
    assert mix.mix(none).count() == 0


def test_mix_positions_follow_the_curves(spark):
    table = docs(spark, [(i, "a b c d e", f"s{i % 3}") for i in range(900)])
    rows = mix.mix(table).collect()
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first) and all(0 <= p <= 1 for r in rows for p in r.positions)
    early = {s: [p for r in rows if r.source == s for p in r.positions] for s in ("s0", "s1", "s2")}
    share = {s: sum(p < 0.5 for p in v) / len(v) for s, v in early.items()}
    assert share["s0"] == pytest.approx(0.625, abs=0.02)  # integral of 1.5 - t up to 0.5
    assert share["s1"] == pytest.approx(0.375, abs=0.02)
    assert share["s2"] == pytest.approx(0.5, abs=0.02)


def test_mix_cuts_hot_cells(spark, monkeypatch):
    """A third of the rows without an id, a third repeats of one row: cells stay small, and the result is that of one cell."""
    pairs = [(i, f"w{i} " * (i % 7)) for i in range(400)] + [(None, f"n{i} " * (i % 5 + 1)) for i in range(400)] + [(7, "again and again")] * 400
    table = docs(spark, pairs).repartition(6)
    whole = Counter(tuple(map(str, r)) for r in mix.mix(table).collect())
    rows = mix._rows(table, "doc_id", "text", "source", 11)
    assert rows.groupBy(*mix.CELLS).count().count() == len({r.bucket for r in rows.select("bucket").distinct().collect()})
    monkeypatch.setattr(mix, "CELL", 20)
    monkeypatch.setattr(mix, "HOT", 60)
    rows = mix._rows(table, "doc_id", "text", "source", 11)
    assert rows.groupBy(*mix.CELLS).count().agg({"count": "max"}).first()[0] <= 100
    df = mix.mix(table)
    plan_has_no_python(df)
    assert Counter(tuple(map(str, r)) for r in df.collect()) == whole
    seen = mix.ordered(table).count()
    monkeypatch.setattr(mix, "CELL", 10**6)
    assert mix.ordered(table).count() == seen


def test_mix_in_order_keeps_whole_documents(odd, none):
    rows = mix.ordered(odd).collect()
    passes = {(r.doc_id): r.passes for r in mix.mix(odd, whole=True).collect() if r.doc_id not in (None, 3)}
    seen = Counter(r.doc_id for r in rows)
    assert all(seen[d] == n for d, n in passes.items())
    source = {tuple(r) for r in odd.collect()}
    assert all(tuple(r) in source for r in rows) and mix.ordered(odd).columns == odd.columns
    assert mix.ordered(none).count() == 0
