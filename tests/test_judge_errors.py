"""A scorer that fails: which rows are given up, what the others get, and how many calls it takes."""
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratingspark.operators import enrich as EN


def _asked(lengths):
    return pd.DataFrame({"rubric": "clarity", "system_prompt": "s", "user_prompt": ["x" * n for n in lengths]})


@pytest.mark.parametrize("seed", range(5))
def test_bad_rows_are_singled_out_with_few_calls(seed):
    rng = random.Random(seed)
    for n in (1, 2, 7, 64, 300):
        lengths = [rng.randint(1, 400) for _ in range(n)]
        calls = []
        scorer = EN.failing_scorer_factory(13, calls.append)
        said, errors = EN.guarded(scorer, _asked(lengths), retries=2)
        bad = sum(x % 13 == 0 for x in lengths)
        assert [e is not None for e in errors] == [x % 13 == 0 for x in lengths]
        assert all((s is None) == (e is not None) for s, e in zip(said, errors, strict=True))
        plain = EN.length_scorer_factory()(_asked(lengths))
        assert [s for s in said if s] == [p for p, x in zip(plain, lengths, strict=True) if x % 13]
        assert len(calls) <= 1 + bad * (2 * math.ceil(math.log2(max(2, n))) + 2)
        assert len(calls) == 1 or bad
    assert EN.guarded(scorer, _asked([])) == ([], [])


def test_a_passing_fault_is_retried_and_a_short_answer_is_a_fault():
    faults = iter([True, True, True, False, False, False, False, False])

    def flaky(pdf):
        if next(faults, False):
            raise OSError("busy")
        return ["[[4]]"] * len(pdf)

    assert EN.guarded(flaky, _asked([5]), retries=3) == (["[[4]]"], [None])
    assert EN.guarded(lambda pdf: ["[[1]]"] * max(0, 2 - len(pdf) + 1), _asked([1, 2, 3]), retries=0)[1][0] == "2 answers to 1 requests"


def _docs(spark, n=200):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id as int) % 57)").alias("transcript")).repartition(3)


def test_the_job_counts_its_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        return EN.failing_scorer_factory(13, lambda n: calls.add(1))

    out = EN.judge_documents(_docs(spark), factory, on_error="capture", retries=1, batch_size=50).collect()
    bad = sum(r[f"{x}_score_error"] is not None for r in out for x in EN.RUBRICS)
    batches = 3 * 2 * 3  # rubrics x at most 2 batches a task x tasks
    assert len(out) == 200 and 0 < bad < 100
    assert calls.value <= batches + bad * (2 * math.ceil(math.log2(50)) + 1)
    for r in out:
        for x in EN.RUBRICS:
            e = r[f"{x}_score_error"]
            assert (r[f"{x}_score"] is None) == (e is not None) and (e is None or r[f"{x}_score_rationale"] == f"ERROR: {e}")


def test_policies(spark):
    with pytest.raises(Exception, match="cannot rate"):
        EN.judge_documents(_docs(spark), EN.failing_scorer_factory).collect()
    empty = EN.judge_documents(_docs(spark), EN.failing_scorer_factory, on_error="empty").where("clarity_score_error is not null")
    assert empty.count() and {r.clarity_score_rationale for r in empty.collect()} == {""}
    with pytest.raises(ValueError):
        EN.judge_documents(_docs(spark), EN.failing_scorer_factory, on_error="ignore")


def test_long_requests(spark):
    req = spark.createDataFrame([(i, "clarity", "s", "x" * i) for i in range(1, 60)], "link int, rubric string, system_prompt string, user_prompt string")
    out = {r.link: r for r in EN.judge_apply(req, EN.failing_scorer_factory, on_error="capture").collect()}
    assert {i for i, r in out.items() if r.error} == {13, 26, 39, 52} == {i for i, r in out.items() if r.score is None}
    assert EN.judge_apply(req.where("user_prompt = 'x'"), EN.failing_scorer_factory).columns == ["link", "rubric", "rationale", "score"]
