"""Every registered query against its SQL twin on the smallest tables (the driver does this at sf0.01)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SLOW = {"svm_cv"}
# QWK of raters on 100 components: no SQL; tests/test_linear.py holds the same fits against dense ones.
NO_SQL = {"svm_test_qwk", "svm_cv_qwk"}


def _load():
    from ratingspark.plans.oracle_queries import SQL
    from ratingspark.plans.queries import REGISTRY
    return dict(REGISTRY), dict(SQL)


QUERIES, SQLS = _load()


@pytest.fixture(scope="module")
def duck(sf_small):
    import duckdb
    from check_oracle import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in SQLS and k not in SLOW))
def test_query_matches_oracle(spark, sf_small, duck, name):
    from check_oracle import digest
    df = QUERIES[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQLS[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) == set(SQLS) | NO_SQL


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["rubric", "n", "qwk", "qwk_fixed"]
    assert df.count() == 3


def test_the_numbers_agree_with_the_checks(spark, sf_small):
    """The QWK of the text raters, and what the boolean queries say of them."""
    for name, key in (("svm_test", "qwk"), ("svm_cv", "qwk_held_out")):
        numbers = {r["rubric"]: r[key] for r in QUERIES[f"{name}_qwk"](spark, sf_small).collect()}
        checks = {r["rubric"]: r["learned"] for r in QUERIES[name](spark, sf_small).collect()}
        assert set(numbers) == set(checks) and all(-1 <= q <= 1 and (q > (0.2 if name == "svm_test" else 0.1)) == checks[r] for r, q in numbers.items())
