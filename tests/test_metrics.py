import numpy as np
import pytest

from ratingspark.operators import metrics as M


def qwk_np(a, b):
    """Position-weighted quadratic kappa from its textbook definition."""
    labels = sorted(set(a) | set(b))
    pos = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    o = np.zeros((k, k))
    for x, y in zip(a, b):
        o[pos[x], pos[y]] += 1
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)], dtype=float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    den = (w * e).sum()
    return float("nan") if den == 0 else 1 - (w * o).sum() / den


def _qwk(spark, a, b, space="observed"):
    df = spark.createDataFrame([("r", int(x), int(y)) for x, y in zip(a, b)], "rubric string, y_true int, y_pred int")
    return M.qwk(df, ("rubric",), label_space=space).first()["qwk"]


@pytest.mark.parametrize("a,b,obs,fixed", [
    ([1, 2, 5, 5], [1, 5, 5, 2], 0.636364, 0.294118),
    ([1, 2, 3], [2, 2, 2], 0.0, 0.0),
    ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], 1.0, 1.0),
])
def test_qwk_golden(spark, a, b, obs, fixed):
    assert round(_qwk(spark, a, b), 6) == obs
    assert round(_qwk(spark, a, b, "fixed"), 6) == fixed


def test_qwk_constant_both_sides_is_null(spark):
    assert _qwk(spark, [3, 3], [3, 3]) is None


def test_qwk_matches_numpy_and_is_symmetric(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(1, 6, 300)
    b = np.clip(a + rng.integers(-1, 2, 300), 1, 5)
    got = _qwk(spark, a, b)
    assert abs(got - qwk_np(list(a), list(b))) < 1e-12
    assert abs(got - _qwk(spark, b, a)) < 1e-12


def test_best_run_earliest_on_ties_and_positive_only(spark):
    rows = [("x", 1, 0.2), ("x", 2, 0.5), ("x", 3, 0.5), ("y", 1, -0.1), ("y", 2, 0.0)]
    df = spark.createDataFrame(rows, "run string, epoch int, qwk double")
    got = {r["run"]: (r["epoch"], r["qwk"]) for r in M.best_run(df).collect()}
    assert got == {"x": (2, 0.5)}


def test_model_compare_gain(spark):
    df = spark.createDataFrame([("a", 0.72), ("b", 0.49), ("c", 0.0)], "model string, qwk double")
    got = {r["model"]: r["gain"] for r in M.model_compare(df).collect()}
    assert got["c"] is None and got["b"] is None
    assert abs(got["a"] - (0.72 / 0.49 - 1)) < 1e-12
