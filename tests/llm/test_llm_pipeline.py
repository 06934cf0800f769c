"""The pipeline's stages one after another on the smallest tables, each held against what its operator says."""
from collections import Counter

import corpus_pipeline
import pytest

from llm_cases import awkward, docs, sentences

from ratingspark.llm import bpe, compression, exact_dedup, mix, simhash
from ratingspark.llm.common import stored, table
from ratingspark.llm.queries import REGISTRY, SQL, tokenizer_path


@pytest.fixture(scope="module")
def steps(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_small), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf_small, steps):
    docs, good, distinct, near, mixed, tokens = steps
    assert all(x.columns == docs.columns for x in (good, distinct, near, mixed))
    scores = compression.score(docs, table(spark, sf_small, "labels"))
    assert ids(good) == ids(scores.filter("predicted = 1"))
    assert ids(distinct) == ids(exact_dedup.assign(good).filter("kept"))
    parts = simhash.near_duplicates(distinct)
    assert ids(near) == ids(parts.filter("doc_id = component_id"))
    plan = mix.mix(near, whole=True).filter("passes > 0").collect()
    assert ids(mixed) == Counter({r.doc_id: r.passes for r in plan})
    expected = Counter(tuple(r) for r in bpe.round_trip(mixed, tokenizer_path()).collect())
    assert Counter(tuple(r) for r in tokens.collect()) == expected


def test_run_gives_the_last_stage(spark, sf_small, steps):
    rows = corpus_pipeline.run(spark, sf_small)
    assert Counter(tuple(r) for r in rows.collect()) == Counter(tuple(r) for r in steps[-1].collect())


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in REGISTRY) == list(range(1, 14))
    assert set(SQL) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_small, name):
    import os

    import duckdb
    from check_oracle import digest

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_small, t)}.parquet')")
    df = REGISTRY[name](spark, sf_small)
    res = con.execute(SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, res.fetchall())[0]


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_copies_go_and_unique_texts_stay(spark):
    """Two texts under one id, of which one is a near copy of another document; near copies without an id."""
    a, z, n, m = sentences(1, 4, 400)
    rows = [(1, a), (2, a + " x"), (2, z), (None, n), (None, n + " y"), (None, m), (7, m + " z"), (8, None), (9, ""), (None, "")]
    kept = texts_of(simhash.deduplicate(docs(spark, rows + rows[:3])))
    texts = {t for _, t in kept}
    assert (1, a) in kept and (2, z) in kept and (2, a + " x") not in kept
    assert len(texts & {n, n + " y"}) == 1 and (7, m + " z") in kept and m not in texts
    assert [d for d, t in kept if not t] == [8] and len(kept) == 5


def test_positions_of_a_mix(spark, sf_small):
    docs_ = table(spark, sf_small, "documents")
    plain = [r.doc_id for r in mix.ordered(docs_).collect()]
    rows = mix.ordered(docs_, with_position=True).collect()
    assert [r.doc_id for r in rows] == plain and [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)
    seen = Counter((r.doc_id, r.mix_pass) for r in rows)
    assert max(seen.values()) == 1 and all(0 <= r.mix_pass < 3 for r in rows)


@pytest.mark.parametrize("rows", ["awkward", "empty"])
def test_stages_on_awkward_tables(spark, sf_small, rows):
    """Nulls, empty and white texts, repeated ids and rows, one long text, and columns named like the operators' own."""
    pairs = awkward(5) + [(100 + i, s) for i, s in enumerate(sentences(9, 60, 80))] + [(100, sentences(9, 1, 80)[0])]
    given = docs(spark, pairs).limit(10**6 if rows == "awkward" else 0)
    step = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, step, sf_small), f"awkward-{name}")
        assert out.columns == given.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in step.collect()}  # rows stay whole
        before, after = texts_of(step), texts_of(out)
        if name == "exact_dedup":
            norm = lambda t: exact_lower(t)
            assert {norm(t) for _, t in before} == {norm(t) for _, t in after} and len({norm(t) for _, t in after}) == len(after)
        if name == "near_dedup":
            prints = Counter(simhash.fingerprint(t) for _, t in after)
            assert all(bin(a ^ b).count("1") > 4 for a in prints for b in prints if a != b) and max(prints.values(), default=1) == 1
        step = out
    said = corpus_pipeline.STAGES[-1][1](spark, step, sf_small).collect()
    assert Counter(r.doc_id for r in said) == ids(step)
    if rows == "empty":
        assert not said


def exact_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
