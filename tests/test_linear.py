"""The raters against dense numpy versions: counts, feature spaces of folds, solver and whole predictions."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingspark.functions.arrays import value_counts
from ratingspark.operators import linear as L
from ratingspark.operators import raters as RT


def dense_svm(x, y, c=1.0):
    """Minimum of |w|^2 / 2 + c * sum(max(0, 1 - y (w . x))^2) with a constant column, by Newton steps on the whole matrix."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def value(w):
        return w @ w / 2 + c * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(200):
        r = 1 - y * (x @ w)
        a = x[r > 0]
        g = w - 2 * c * a.T @ (y * r)[r > 0]
        if np.abs(g).max() < 1e-11:
            break
        d = -np.linalg.solve(np.eye(len(w)) + 2 * c * a.T @ a, g)
        t = 1.0
        while value(w + t * d) > value(w) and t > 1e-9:
            t /= 2
        w = w + t * d
    return w


def dense_space(counts, k, pca_k):
    """(terms, projection) of the library definitions on a list of Counters."""
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    terms = sorted(total, key=lambda t: (-total[t], t))[:k]
    idf = np.array([np.log((1 + len(counts)) / (1 + df[t])) + 1 for t in terms])

    def tfidf(cs):
        x = np.array([[c[t] for t in terms] for c in cs], float).reshape(len(cs), len(terms)) * idf
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1)

    x = tfidf(counts)
    mean = x.mean(axis=0)
    _, values, axes = np.linalg.svd(x - mean, full_matrices=False)
    return terms, lambda cs: (tfidf(cs) - mean) @ axes[:pca_k].T, values**2 / (len(counts) - 1)


def tokens(text):
    return Counter(re.findall(r"\w{2,}", (text or "").lower()))


def test_value_counts(spark):
    rng = random.Random(1)
    rows = [(i, None if i == 3 else [rng.choice("abcdé") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(40)]
    got = spark.createDataFrame(rows, "id int, v array<string>").select("id", value_counts("v").alias("c")).collect()
    for (_, v), r in zip(sorted(rows), sorted(got), strict=True):
        assert (r.c is None) == (v is None) and [tuple(x) for x in r.c or []] == sorted(Counter(v or []).items())


def _columns(seed, n=400, d=6, labels=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 1, 5, 0.1, 1, 1]
    y = np.clip(np.round(x[:, 0] + 0.3 * x[:, 2] + 3 + rng.normal(size=n) * 0.5), 1, labels).astype(int)
    return x, y


@pytest.mark.parametrize("c", [1.0, 30.0])
def test_solver_equals_a_dense_solver(spark, c):
    x, y = _columns(4)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(7)
    problems = [L.Problem(0, "y", k) for k in sorted(set(y.tolist()))]

    def views(b):
        f = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
        yield L.View(0, f, np.ones(len(f), bool), {"y": L.target_values(b.column(1))})

    found = L.solve(rows, views, problems, {0: x.shape[1]}, c)
    for p in problems:
        assert np.abs(found[p] - dense_svm(x, np.where(y == p.label, 1.0, -1.0), c)).max() < 1e-7


def test_a_step_that_overshoots_is_halved(spark, monkeypatch):
    """Few rows far apart at a large cost, where a whole Newton step can raise the value."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(14, 3)) * 10.0 ** rng.integers(-2, 3, size=(14, 1))
    y = np.where(rng.random(14) < 0.5, 1, 2)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y int")

    def views(b):
        f = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
        yield L.View(0, f, np.ones(len(f), bool), {"y": L.target_values(b.column(1))})

    p = L.Problem(0, "y", 1)
    w = L.solve(rows, views, [p], {0: 3}, 1e4)[p]
    want = dense_svm(x, np.where(y == 1, 1.0, -1.0), 1e4)
    assert np.abs(w - want).max() <= 1e-4 * np.abs(want).max()


def _texts(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(60)]
    rows = []
    for i in range(n):
        lean = rng.randint(1, 5)
        t = [rng.choice(words[:12 * lean]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(t), lean if i % 11 else None, rng.randint(1, 3), i % 4))
    return rows + [(n, None, 2, 1, 0), (n + 1, "", 3, 2, 1), (n + 2, "Only oddities", 1, 1, None)]


SCHEMA = "doc_id int, text string, a_score int, b_score int, fold int"


def test_spaces_of_folds_equal_refits(spark):
    df = spark.createDataFrame(_texts(2), SCHEMA)
    rows = RT.counted(df, ["doc_id"], "fold")
    _, _, spaces = RT.fit_spaces(rows, [0, 1, 2, 3, None], 30, 8)
    for f, space in zip([0, 1, 2, 3, None], spaces, strict=True):
        part = df if f is None else df.where(F.coalesce("fold", F.lit(-1)) != f)
        again = RT.fit_features(part, max_features=30, pca_k=8)
        counts = [tokens(r.text) for r in part.collect()]
        terms, project, values = dense_space(counts, 30, 8)
        assert space.n == again.n == len(counts) and space.terms == again.terms == terms
        for one, other in ((space, again),):
            assert np.abs(one.idf - other.idf).max() < 1e-12 and np.abs(one.mean - other.mean).max() < 1e-12
            assert np.abs(one.axes - other.axes).max() < 1e-9 and np.abs(one.variances - other.variances).max() < 1e-12
        mine = space.project(np.array([[c[t] for t in terms] for c in counts], float))
        assert np.abs(np.abs(mine) - np.abs(project(counts))).max() < 1e-8
        m = min(len(values), 20)
        assert np.abs(space.variances[:m] - values[:m]).max() < 1e-12


def test_cross_predictions_equal_dense_ones(spark):
    data = _texts(5)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {(r.doc_id, r.rubric, r.fold): (r.side, r.y_true, r.y_pred)
           for r in RT.cross_predict(df, "doc_id", "fold", 4, ("a", "b"), max_features=30, pca_k=6).collect()}
    assert len(got) == len(data) * 2 * 4
    counts = [tokens(r[1]) for r in data]
    for f in range(4):
        train = [i for i, r in enumerate(data) if r[4] != f]
        _, project, _ = dense_space([counts[i] for i in train], 30, 6)
        z = project(counts)
        for name, col in (("a", 2), ("b", 3)):
            use = [i for i in train if data[i][col] is not None]
            y = np.array([data[i][col] for i in use])
            labels = sorted(set(y.tolist()))
            w = [dense_svm(z[use], np.where(y == c, 1.0, -1.0)) for c in labels]
            margins = np.hstack([z, np.ones((len(z), 1))]) @ np.array(w).T
            for i, r in enumerate(data):
                two = np.sort(margins[i])[-2:]
                want = labels[int(margins[i].argmax())]
                side, true, said = got[r[0], name, f]
                assert side == ("test" if r[4] == f else "train") and true == r[col]
                assert said == want or two[1] - two[0] < 1e-7


def test_raters_on_columns_equal_dense_ones(spark):
    x, y = _columns(9, n=150)
    df = spark.createDataFrame([(i, *map(float, v), int(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))],
                               "id int, " + ", ".join(f"c{j} double" for j in range(6)) + ", q_score int, fold int")
    got = {(r.id, r.fold): r.y_pred for r in RT.rate_columns(df, "id", [f"c{j}" for j in range(6)], "fold", 3, ("q",)).collect()}
    fold = np.arange(150) % 3
    for f in range(3):
        labels = sorted(set(y[fold != f].tolist()))
        w = np.array([dense_svm(x[fold != f], np.where(y[fold != f] == c, 1.0, -1.0)) for c in labels])
        said = np.array(labels)[(np.hstack([x, np.ones((150, 1))]) @ w.T).argmax(axis=1)]
        assert [got[i, f] for i in range(150)] == said.tolist()


def test_awkward_training_sets(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert RT.cross_predict(empty, "doc_id", "fold", 2, ("a",)).count() == 0
    none = spark.createDataFrame([(1, "some words", None, 1, 0), (2, "other words", None, 1, 1)], SCHEMA)
    said = RT.cross_predict(none, "doc_id", "fold", 2, ("a", "b")).collect()
    assert {(r.rubric, r.y_pred) for r in said} == {("a", None), ("b", 1)}
    blank = spark.createDataFrame([(1, None, 1, 1, 0), (2, "", 2, 1, 1), (3, " ", 2, 1, 0)], SCHEMA)
    assert RT.cross_predict(blank, "doc_id", "fold", 2, ("a",)).count() == 6


def test_predictions_with_and_without_spark_vectors_agree(spark):
    df = spark.createDataFrame(_texts(7), SCHEMA)
    space = RT.fit_features(df, max_features=40, pca_k=7)
    feats = RT.featurize(space, df)
    rater = RT.fit_rater(feats, "a_score")
    one = {r.doc_id: r.y_pred for r in RT.predict(rater, feats, "a_score").collect()}
    two = {r.doc_id: r.y_pred for r in RT.fit_predict(df, df.limit(0), "doc_id", ("a",), with_train=True, max_features=40, pca_k=7).collect()}
    assert one == two


def test_a_hessian_changes_by_the_rows_that_moved():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), np.where(rng.random((200, 3)) < 0.5, 1.0, -1.0)
    last = rng.normal(size=(4, 3))
    now = last + [[0.1, 0, 1]] * np.ones((4, 1))

    def half(w, j):
        a = x[1 - y[:, j] * (x @ w[:, j]) > 0]
        return a.T @ a

    value, gradient, changes = L._terms(x, y, now, last, np.zeros(3, bool))
    assert [j for j, _ in changes] == [0, 2]  # the second stayed where it was: nothing is added up for it
    for j, change in changes:
        assert np.abs(change - half(now, j) + half(last, j)).max() < 1e-10
    for j in range(3):
        r = np.maximum(0, 1 - y[:, j] * (x @ now[:, j]))
        assert abs(value[j] - r @ r) < 1e-10 and np.abs(gradient[j] + 2 * x.T @ (y[:, j] * r)).max() < 1e-10
    zero = np.zeros((4, 3))
    anew = L._terms(x, y, now, zero, np.ones(3, bool))[2]
    assert all(np.abs(change - half(now, j)).max() < 1e-10 for j, change in anew) and len(anew) == 3


def test_term_counts_are_added_up_once_for_all_models(spark, monkeypatch):
    made = []
    stored = RT._stored
    monkeypatch.setattr(RT, "_stored", lambda df, name: made.append(name) or stored(df, name))
    df = spark.createDataFrame(_texts(3), SCHEMA)
    models = RT.vocabularies(RT.counted(df, ["doc_id"], "fold"), [0, 1, None], 30)
    assert made == ["term_counts", "term_stats"]  # the models read the stored sums
    for f, (n, terms, _) in zip([0, 1, None], models, strict=True):
        counts = [tokens(r[1]) for r in _texts(3) if f is None or r[4] != f]
        assert n == len(counts) and terms == dense_space(counts, 30, 2)[0]
