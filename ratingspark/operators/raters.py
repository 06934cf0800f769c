"""Classical raters on TF-IDF features (F2-F5): term counts -> TF-IDF -> PCA -> one-vs-rest linear SVM per rubric.

The texts are read once. Their term counts (:func:`counted`) are written to the checkpoint folder, and everything after that
reads those. A model is fitted on all rows but one fold (or on all rows), and all models are fitted together:

* one aggregate by term gives the counts and document frequencies of every fold, a model's are the total minus its
  fold's; its ``max_features`` most frequent terms and their idf follow;
* one pass over the rows adds up, for every model, the vector sum and the Gram matrix of its TF-IDF rows. The rows are
  sparse and stay so: centring is the rank-one correction ``G - s s^T / n`` of the sum;
* the driver's eigenvectors of that matrix (``max_features`` squared) are the principal axes;
* the SVMs (:mod:`ratingspark.operators.linear`) of all models, rubrics and classes take their Newton steps together,
  one job a step, in the space of the principal components.

The rows of a block are laid out over the vocabulary inside a task only. The models are parameters, bounded by ``max_features``
and ``pca_k``; nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.functions.arrays import value_counts
from ratingspark.functions.text import tokens
from ratingspark.operators import features as FE
from ratingspark.operators import linear as L
from ratingspark.operators import metrics as M
from ratingspark.schemas import RUBRICS
from ratingspark.session import scratch_path

PCA_K = 100
FOLD = "_fold"


class Space(NamedTuple):
    """A fitted feature space: rows fitted on, terms by column, their idf, the rows' mean, principal axes (columns) and all
    eigenvalues of the covariance (divisor n - 1), largest first."""

    n: int
    terms: list[str]
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """TF-IDF rows of unit length from raw counts over ``terms``; a row without terms is zero."""
        x = counts * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(norm > 0, norm, 1.0)[:, None]

    def project(self, counts: np.ndarray) -> np.ndarray:
        return (self.weights(counts) - self.mean) @ self.axes


class Rater(NamedTuple):
    """Weights by class of one target's one-vs-rest SVM."""

    weights: dict[int, np.ndarray]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the checkpoint folder and read back; a lost executor re-reads it instead of the texts."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, columns: list, fold=None, text_col: str = "text") -> DataFrame:
    """The columns, ``_fold`` (-1 where there is none) and ``_counts``, the term counts of the text, stored."""
    counts = value_counts(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    fold = F.lit(-1) if fold is None else F.coalesce(F.col(fold).cast("int"), F.lit(-1))
    return _stored(df.select(*columns, fold.alias(FOLD), counts.alias("_counts")), "term_counts")


def vocabularies(rows: DataFrame, left_out: list[int | None], k: int) -> list[tuple[int, list[str], np.ndarray]]:
    """For every model (all rows, or all but the fold left out): rows, its ``k`` most frequent terms (ties by term), and
    their idf. One stored aggregate serves all models: their counts are totals minus the fold's."""
    of = {f: F.col(FOLD) == f for f in left_out if f is not None}
    per_fold = [x for f, here in of.items() for x in (F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"n_{f}"),
                                                      F.count_if(here).alias(f"df_{f}"))]
    stats = _stored(rows.select(FOLD, F.inline("_counts")).groupBy("value")
                    .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"), *per_fold), "term_stats")

    def minus(name: str, f: int | None):
        return F.col(name) if f is None else F.col(name) - F.col(f"{name}_{f}")

    tops = [stats.select(F.lit(m).alias("m"), "value", minus("n", f).alias("n"), minus("df", f).alias("df")).filter("n > 0")
            .orderBy(F.desc("n"), "value").limit(k) for m, f in enumerate(left_out)]
    found = reduce(DataFrame.unionByName, tops).collect()  # models x k: parameters
    sizes = {r[FOLD]: r["count"] for r in rows.groupBy(FOLD).count().collect()}
    total = sum(sizes.values())
    out = []
    for m, f in enumerate(left_out):
        mine = sorted((r for r in found if r["m"] == m), key=lambda r: (-r["n"], r["value"]))
        n = total - (0 if f is None else sizes.get(f, 0))
        out.append((n, [r["value"] for r in mine], np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in mine])))
    return out


def indexed(rows: DataFrame, terms: list[str]) -> DataFrame:
    """``rows`` with ``_counts`` replaced by ``_at`` (places in ``terms``) and ``_n``; other terms are gone. Stored."""
    kept = [f for f in rows.schema.fields if f.name != "_counts"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("_at", T.ArrayType(T.IntegerType())), T.StructField("_n", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for b in batches:
            lists = b.column(len(names))
            flat = lists.flatten()
            at = pc.index_in(flat.field(0), value_set=known)
            here = at.is_valid().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            upto = np.append(0, np.cumsum(here))
            offsets = pa.array(upto[np.append(0, np.cumsum(sizes))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.ListArray.from_arrays(offsets, at.drop_null().cast(pa.int32())),
                 pa.ListArray.from_arrays(offsets, flat.field(1).filter(pa.array(here)).cast(pa.int32()))], schema.names)

    found = rows.select(*names, "_counts").mapInArrow(run, schema)
    # The solver reads these rows in every step: few files would leave cores idle. ``rows`` is a plain scan, so counting is free.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return _stored(found.repartition(cores) if rows.rdd.getNumPartitions() < cores else found, "term_rows")


def _blocks(at: pa.Array, n: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, raw counts over ``width`` terms) of the rows of a batch, ``BLOCK`` rows at a time."""
    for lo in range(0, len(at), L.BLOCK):
        a = at.slice(lo, L.BLOCK)
        counts = np.zeros((len(a), width))
        row = np.repeat(np.arange(len(a)), pc.list_value_length(a).to_numpy())
        counts[row, a.flatten().to_numpy()] = n.slice(lo, L.BLOCK).flatten().to_numpy()
        yield lo, counts


def fit_spaces(rows: DataFrame, left_out: list[int | None], max_features: int = FE.MAX_FEATURES,
               pca_k: int = PCA_K) -> tuple[DataFrame, list[str], list[Space]]:
    """The feature space of every model, the union of their terms, and the rows indexed by that union."""
    models = vocabularies(rows, left_out, max_features)
    union = sorted({t for _, terms, _ in models for t in terms})
    place = {t: i for i, t in enumerate(union)}
    sparse = indexed(rows, union)
    bare = [Space(n, terms, idf, np.zeros(len(terms)), np.zeros((len(terms), 0)), np.zeros(0)) for n, terms, idf in models]
    columns = [np.array([place[t] for t in terms], np.int64) for _, terms, _ in models]

    def parts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        fold = b.column(0).to_numpy()
        for lo, counts in _blocks(b.column(1), b.column(2), len(union)):
            for m, f in enumerate(left_out):
                if not len(columns[m]):
                    continue
                mine = counts if f is None else counts[fold[lo:lo + len(counts)] != f]
                x = bare[m].weights(mine[:, columns[m]])
                yield m, np.concatenate([x.sum(axis=0), (x.T @ x)[np.triu_indices(x.shape[1])]])

    added = L.summed(sparse.select(FOLD, "_at", "_n"), parts)
    spaces = []
    for m, s in enumerate(bare):
        d = len(s.terms)
        v = added.get(m, np.zeros(d + d * (d + 1) // 2))
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = v[d:]
        gram = gram + np.triu(gram, 1).T
        total, n = v[:d], max(1, s.n)
        cov = (gram - np.outer(total, total) / n) / max(1, n - 1)
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1][:, :min(pca_k, d)]
        if d:  # one sign, whatever the solver returns
            axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        spaces.append(s._replace(mean=total / n, axes=axes, variances=values))
    return sparse, union, spaces


def _views(spaces: list[Space], left_out: list[int | None], union: list[str], targets: list[str]) -> L.Views:
    """Batches (fold, _at, _n, targets...) as every model sees them. A model's idf is part of its axes here, laid out over the union of
    terms: one product projects a block for all models (as :meth:`Space.project` does), and one gives the rows' lengths."""
    place = {t: i for i, t in enumerate(union)}
    ends = np.append(0, np.cumsum([s.axes.shape[1] for s in spaces]))
    axes, squares = np.zeros((len(union), ends[-1])), np.zeros((len(union), len(spaces)))
    for m, s in enumerate(spaces):
        at = [place[t] for t in s.terms]
        axes[at, ends[m]:ends[m + 1]], squares[at, m] = s.idf[:, None] * s.axes, s.idf**2
    shifts = [s.mean @ s.axes for s in spaces]

    def views(b: pa.RecordBatch) -> Iterator[L.View]:
        fold = b.column(0).to_numpy()
        known = {t: L.target_values(b.column(3 + i)) for i, t in enumerate(targets)}
        for lo, counts in _blocks(b.column(1), b.column(2), len(union)):
            cut = slice(lo, lo + len(counts))
            projected, norms = counts @ axes, np.sqrt(counts**2 @ squares)
            norms[norms == 0] = 1.0
            for m, f in enumerate(left_out):
                trained = np.ones(len(counts), bool) if f is None else fold[cut] != f
                features = projected[:, ends[m]:ends[m + 1]] / norms[:, m:m + 1] - shifts[m]
                yield L.View(m, features, trained, {t: v[cut] for t, v in known.items()})

    return views


def _said(table: DataFrame, views: L.Views, dims: dict[int, int], key: str, targets: list[str], names: list[str],
          left_out: list[int | None], **solver) -> DataFrame:
    """Fits every problem of ``table`` (``_fold``, what the views read, targets, ``_key``) and predicts every row with every model."""
    problems = L.classes(table, targets, FOLD, left_out)
    weights = L.solve(table.drop("_key"), views, problems, dims, **solver)
    raters = {(m, t): {p.label: w for p, w in weights.items() if (p.model, p.target) == (m, t)} for m in dims for t in targets}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = dict.fromkeys(dims, 0)
            keys = b.columns[-1]
            for v in views(b):
                n, lo = len(v.features), done[v.model]
                done[v.model] += n
                for name, t in zip(names, targets, strict=True):
                    mine = raters[v.model, t]
                    said = pa.array(L.choose(v.features, mine), pa.int32()) if mine else pa.nulls(n, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(lo, n), pa.array([name] * n), pa.array([v.model] * n, pa.int32()),
                         pa.array(np.where(v.trained, "train", "test")), pa.array(v.targets[t], pa.float64(), from_pandas=True).cast(pa.int32()), said],
                        ["key", "rubric", "model", "side", "y_true", "y_pred"])

    kind = table.schema["_key"].dataType.simpleString()
    return table.mapInArrow(run, f"key {kind}, rubric string, model int, side string, y_true int, y_pred int").withColumnRenamed("key", key)


def rate(rows: DataFrame, key: str, targets: list[str], names: list[str], left_out: list[int | None], max_features: int = FE.MAX_FEATURES,
         pca_k: int = PCA_K, **solver) -> DataFrame:
    """Fits all models on ``rows`` (of :func:`counted`) and predicts every row with each: ``key, rubric, model, side, y_true,
    y_pred``; ``side`` is 'train' for the rows fitted on, 'test' for the fold left out. A rubric's NULL labels are not
    fitted on; a model without any label of a rubric predicts NULL."""
    sparse, union, spaces = fit_spaces(rows, left_out, max_features, pca_k)
    return _said(sparse.select(FOLD, "_at", "_n", *targets, F.col(key).alias("_key")), _views(spaces, left_out, union, targets),
                 {m: s.axes.shape[1] for m, s in enumerate(spaces)}, key, targets, names, left_out, **solver)


def rate_columns(df: DataFrame, key: str, columns: list[str], fold_col: str, n_folds: int, rubrics=RUBRICS, label_fmt: str = "{}_score",
                 **solver) -> DataFrame:
    """The same raters on numeric columns instead of texts, cross-validated: ``key, rubric, fold, side, y_true, y_pred``."""
    targets = [f"_y{i}" for i in range(len(rubrics))]
    table = _stored(df.select(F.coalesce(F.col(fold_col).cast("int"), F.lit(-1)).alias(FOLD),
                              F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), *_labelled(rubrics, label_fmt),
                              F.col(key).alias("_key")), "rater_rows")

    def views(b: pa.RecordBatch) -> Iterator[L.View]:
        fold, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, len(columns))
        known = {t: L.target_values(b.column(2 + i)) for i, t in enumerate(targets)}
        for m in range(n_folds):
            yield L.View(m, x, fold != m, known)

    return _said(table, views, dict.fromkeys(range(n_folds), len(columns)), key, targets, list(rubrics), list(range(n_folds)),
                 **solver).withColumnRenamed("model", fold_col)


def _labelled(rubrics, label_fmt: str) -> list:
    return [F.col(label_fmt.format(r)).cast("int").alias(f"_y{i}") for i, r in enumerate(rubrics)]


def fit_predict(train: DataFrame, test: DataFrame, key: str, rubrics=RUBRICS, text_col: str = "text",
                label_fmt: str = "{}_score", with_train: bool = False, max_features: int = FE.MAX_FEATURES, pca_k: int = PCA_K,
                **solver) -> DataFrame:
    """Long predictions ``key, rubric, y_true, y_pred`` for ``test``; features and raters fitted on ``train`` only.

    With ``with_train`` the training rows are predicted too, and ``side`` ('train' or 'test') tells them apart.
    """
    sides = [df.select(F.col(key), F.col(text_col).alias("_text"), *_labelled(rubrics, label_fmt), F.lit(i).alias("_side"))
             for i, df in enumerate((train, test))]
    targets = [f"_y{i}" for i in range(len(rubrics))]
    rows = counted(reduce(DataFrame.unionByName, sides), [key, *targets], "_side", "_text")
    out = rate(rows, key, targets, list(rubrics), [1], max_features, pca_k, **solver)
    return out.drop("model") if with_train else out.filter("side = 'test'").drop("side", "model")


def cross_predict(train: DataFrame, key: str, fold_col: str = "fold", n_folds: int = 5, rubrics=RUBRICS, text_col: str = "text",
                  label_fmt: str = "{}_score", max_features: int = FE.MAX_FEATURES, pca_k: int = PCA_K, **solver) -> DataFrame:
    """Predictions of all rows by the models of all folds, each fitted on the other folds: ``key, rubric, fold, side, y_true, y_pred``."""
    targets = [f"_y{i}" for i in range(len(rubrics))]
    rows = counted(train.select(F.col(key), F.col(fold_col).alias("_of"), F.col(text_col).alias("_text"), *_labelled(rubrics, label_fmt)),
                   [key, *targets], "_of", "_text")
    return rate(rows, key, targets, list(rubrics), list(range(n_folds)), max_features, pca_k, **solver).withColumnRenamed("model", fold_col)


def cross_validate(train: DataFrame, key: str, fold_col: str = "fold", n_folds: int = 5, rubrics=RUBRICS, text_col: str = "text",
                   label_fmt: str = "{}_score", **fit) -> tuple[DataFrame, DataFrame]:
    """Per fold 0..n_folds-1: features and raters fitted on the other folds predict the fold and the rows fitted on.

    Returns, for each ``side`` ('train' or 'test', the held-out fold), the per-rubric mean QWK over folds, and its
    mean over rubrics. All folds are fitted together; the caller says how many there are, so none are looked up.
    """
    preds = cross_predict(train, key, fold_col, n_folds, rubrics, text_col, label_fmt, **fit)
    return M.qwk_cv(preds, fold_col, "rubric", by=("side",))


# ---------------------------------------------------------------- one space, one rater

def fit_features(train: DataFrame, text_col: str = "text", max_features: int = FE.MAX_FEATURES, pca_k: int = PCA_K) -> Space:
    """Vocabulary, idf, mean and principal axes of ``train``."""
    return fit_spaces(counted(train, [], None, text_col), [None], max_features, pca_k)[2][0]


def featurize(space: Space, df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``features``, the principal components of its texts."""
    counts = value_counts(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    schema = T.StructType([*df.schema.fields, T.StructField("_x", T.ArrayType(T.DoubleType()))])
    width = len(space.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(space.terms, pa.string())
        for b in batches:
            flat = b.columns[-1].flatten()
            at = pc.index_in(flat.field(0), value_set=known)
            here = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.columns[-1]).to_numpy())[here]
            place, n = at.drop_null().to_numpy(), flat.field(1).to_numpy()[here]
            for lo in range(0, b.num_rows, L.BLOCK):
                size = min(L.BLOCK, b.num_rows - lo)
                mine = (row >= lo) & (row < lo + size)
                raw = np.zeros((size, width))
                raw[row[mine] - lo, place[mine]] = n[mine]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, size) for c in b.columns[:-1]),
                                                  pa.array(list(space.project(raw)), pa.list_(pa.float64()))], schema.names)

    return df.withColumn("_counts", counts).mapInArrow(run, schema).withColumn("features", array_to_vector("_x")).drop("_x")


def fit_rater(train_feats: DataFrame, label_col: str, reg: float | None = None, max_iter: int = 60, tol: float = 1e-9) -> Rater:
    """One-vs-rest SVM on the vector column ``features``. ``reg=None`` is C = 1; otherwise the penalty of a mean loss."""
    rows = train_feats.select(vector_to_array("features").alias("x"), F.col(label_col).cast("int").alias("y"), F.lit(-1).alias(FOLD))
    rows = _stored(rows.filter("y is not null"), "rater_rows")
    problems = L.classes(rows, ["y"], FOLD, [None])
    head = rows.select(F.size("x").alias("d")).first()
    if head is None:
        return Rater({})
    c = 1.0 if reg is None else 1.0 / (reg * rows.count())

    def views(b: pa.RecordBatch) -> Iterator[L.View]:
        x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
        yield L.View(0, x, np.ones(len(x), bool), {"y": L.target_values(b.column(1))})

    weights = L.solve(rows.select("x", "y"), views, problems, {0: head["d"]}, c, tol, max_iter)
    return Rater({p.label: w for p, w in weights.items()})


def predict(rater: Rater, feats: DataFrame, label_col: str, pred_col: str = "y_pred") -> DataFrame:
    """``feats`` with the class of the largest margin; NULL if the rater knows no class."""
    if not rater.weights:
        return feats.withColumn(pred_col, F.lit(None).cast("int"))
    x = vector_to_array("features")

    def margin(w: np.ndarray):
        return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b), F.lit(float(w[-1])), lambda s, v: s + v)

    scored = F.array(*[F.struct(margin(w).alias("m"), F.lit(-c).alias("c")) for c, w in sorted(rater.weights.items())])
    return feats.withColumn(pred_col, (-F.array_max(scored)["c"]).cast("int"))
