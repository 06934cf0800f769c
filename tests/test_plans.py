"""Plan shape checks: the properties that matter at scale, read from the physical plans."""
import re

import pytest

from ratingspark.plans.queries import REGISTRY

QUERIES = dict(REGISTRY)
SKIP = {"pca", "svm_rater", "svm_test", "svm_cv", "svm_test_qwk", "svm_cv_qwk", "svm_words_cv", "stream_resume"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cartesian_or_nested_loop_join(spark, sf_small, name):
    plan = _plan(QUERIES[name](spark, sf_small))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_per_group_limit_is_applied_before_the_shuffle(spark, sf_small):
    plan = _plan(QUERIES["top_n_per_group"](spark, sf_small))
    lines = plan.splitlines()
    ex = next(i for i, l in enumerate(lines) if "Exchange" in l)
    assert any("WindowGroupLimit" in l and "Partial" in l for l in lines[ex:])


def test_qwk_shuffles_only_partial_counts(spark, sf_small):
    plan = _plan(QUERIES["qwk"](spark, sf_small))
    assert "partial_count" in plan
    lines = plan.splitlines()
    for i, l in enumerate(lines):
        if "Exchange hashpartitioning(rubric" in l and "y_true" in l and "y_pred" in l:
            assert "HashAggregate" in lines[i + 1]  # combined map-side before the exchange


def _count(df, pattern: str) -> int:
    return len(re.findall(pattern, _plan(df)))


@pytest.mark.parametrize("name", ["qwk", "qwk_macro", "judge_agreement"])
def test_kappa_reads_its_rows_once(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert _count(df, r"FileScan parquet") == 1
    assert "Join" not in _plan(df)
    assert _count(df, r"MapInArrow") == (name == "judge_agreement")


def test_judging_documents_shuffles_nothing(spark, sf_small):
    assert _count(QUERIES["judge_apply"](spark, sf_small), r"Exchange") == 0


def test_draws_are_not_shuffled(spark, sf_small):
    plan = _plan(QUERIES["baseline_sampled"](spark, sf_small))
    assert "doc_id" not in "".join(l for l in plan.splitlines() if "Exchange hashpartitioning" in l and "rubric" not in l)
    assert not re.search(r"Generate explode\(sequence", plan)


def test_terms_take_one_exchange(spark, sf_small):
    assert _count(QUERIES["top_terms"](spark, sf_small), r"Exchange hashpartitioning") == 1
    tfidf = [l for l in _plan(QUERIES["tfidf"](spark, sf_small)).splitlines() if "Exchange hashpartitioning" in l]
    assert sum("doc_id" in l for l in tfidf) == 1 and sum("term" in l.split("hashpartitioning")[1] for l in tfidf) == 1


def test_parquet_scans_are_pruned(spark, sf_small):
    plan = _plan(QUERIES["host_filter"](spark, sf_small))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan or "struct<page_id:bigint,url:string>" in plan
    assert "html" not in plan.split("ReadSchema")[1].split("\n")[0]
