"""Agreement metrics: confusion, quadratic weighted kappa, run selection, loss.

QWK is computed from the confusion counts, which are pre-aggregated map-side:
the only shuffle carries at most ``groups x labels^2`` rows, whatever the input
size or key skew. All sums are integers, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.functions.arrays import cross_entropy

_BIG = "decimal(38,0)"


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def confusion(df: DataFrame, group_cols=("rubric",), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts per (group, y_true, y_pred); rows with a NULL label are left out."""
    g = _as_list(group_cols)
    return (df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
            .groupBy(*g, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def _positions(cm: DataFrame, g: list[str]) -> DataFrame:
    """Label values of a confusion table replaced by their 1-based rank among the labels seen on either side (``a``, ``b``).

    Each row is taken apart into its two labels, ranked within its group, and put together again: no join, so
    nothing upstream is read twice. The table has at most ``groups x labels^2`` rows.
    """
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("y_true").alias("label")),
                    F.struct(F.lit("b").alias("side"), F.col("y_pred").alias("label")))
    w = Window.partitionBy(*g).orderBy("_s.label")
    ranked = cm.withColumn("_s", F.explode(sides)).withColumn("_pos", F.dense_rank().over(w))

    def side(name):
        return F.max(F.when(F.col("_s.side") == name, F.col("_pos"))).alias(name)

    return ranked.groupBy(*g, "y_true", "y_pred", "n").agg(side("a"), side("b"))


def _kappa(s: str):
    """QWK from the integer sums with suffix ``s``: 1 - n * sum of squared distances / its expectation."""
    num = (F.col("_n") * F.col(f"_d2{s}")).cast("double")
    den = (F.col("_n") * F.col(f"_sq{s}") - F.lit(2).cast(_BIG) * F.col(f"_sa{s}") * F.col(f"_sb{s}")).cast("double")
    return F.lit(1.0) - num / F.nullif(den, F.lit(0.0))


def _sums(a: str, b: str, s: str) -> list:
    n, a, b = F.col("n").cast("bigint"), F.col(a).cast("bigint"), F.col(b).cast("bigint")
    terms = {"_d2": n * (a - b) * (a - b), "_sq": n * (a * a + b * b), "_sa": n * a, "_sb": n * b}
    return [F.sum(x).cast(_BIG).alias(name + s) for name, x in terms.items()]


def qwk_from_confusion(cm: DataFrame, group_cols=("rubric",), label_space: str = "observed") -> DataFrame:
    """QWK per group from a confusion table (columns group..., y_true, y_pred, n).

    ``label_space='observed'`` weights by the position of a label among the labels
    seen on either side (parity with the common library definition);
    ``'fixed'`` weights by the label values themselves; ``'both'`` returns the first as
    ``qwk`` and the second as ``qwk_fixed``, from one aggregate.
    Both sides one constant: 0/0, returned as NULL.
    """
    g = _as_list(group_cols)
    sums = {"observed": [("a", "b", "", "qwk")], "fixed": [("y_true", "y_pred", "", "qwk")],
            "both": [("a", "b", "", "qwk"), ("y_true", "y_pred", "f", "qwk_fixed")]}.get(label_space)
    if sums is None:
        raise ValueError("label_space must be 'observed', 'fixed' or 'both'")
    t = cm if label_space == "fixed" else _positions(cm, g)
    s = t.groupBy(*g).agg(F.sum(F.col("n").cast("bigint")).cast(_BIG).alias("_n"),
                          *[x for a, b, suffix, _ in sums for x in _sums(a, b, suffix)])
    return s.select(*g, F.col("_n").cast("bigint").alias("n"), *[_kappa(suffix).alias(name) for _, _, suffix, name in sums])


def qwk(df: DataFrame, group_cols=("rubric",), y_true: str = "y_true", y_pred: str = "y_pred",
        label_space: str = "observed") -> DataFrame:
    """Quadratic weighted kappa per group; the rows are read once, for the confusion counts."""
    return qwk_from_confusion(confusion(df, group_cols, y_true, y_pred), group_cols, label_space)


def qwk_macro(per_group: DataFrame, by=(), qwk_col: str = "qwk") -> DataFrame:
    """Mean of QWK over rubrics (and any other groups not in ``by``)."""
    by = _as_list(by)
    return per_group.groupBy(*by).agg(F.avg(qwk_col).alias("qwk_macro"), F.count(F.lit(1)).alias("n_groups"))


def qwk_cv(df: DataFrame, fold_col: str = "fold", rubric_col: str = "rubric", y_true: str = "y_true",
           y_pred: str = "y_pred", by=()) -> tuple[DataFrame, DataFrame]:
    """QWK per (rubric, fold) -> mean per rubric -> mean over rubrics."""
    by = _as_list(by)
    per_fold = qwk(df, by + [rubric_col, fold_col], y_true, y_pred)
    per_rubric = per_fold.groupBy(*by, rubric_col).agg(F.avg("qwk").alias("qwk_mean"),
                                                      F.count(F.lit(1)).alias("n_folds"))
    macro = per_rubric.groupBy(*by).agg(F.avg("qwk_mean").alias("qwk_macro"))
    return per_rubric, macro


def align_predictions(truth: DataFrame, preds: DataFrame, keys=("key", "rubric")) -> DataFrame:
    """Row alignment of truth and prediction by key: an equi-join, never position."""
    return truth.join(preds, list(keys), "inner")


def best_run(metrics: DataFrame, group_cols=("run",), epoch_col: str = "epoch", qwk_col: str = "qwk") -> DataFrame:
    """Best epoch per run: highest QWK, earliest on ties, only if QWK > 0.

    A max over a struct is an ordinary aggregate, so it is combined map-side and
    a run with many epochs is never gathered in one task.
    """
    g = _as_list(group_cols)
    best = (metrics.where(F.col(qwk_col) > 0)
            .groupBy(*g)
            .agg(F.max(F.struct(F.col(qwk_col).alias("q"), (-F.col(epoch_col)).alias("ne"))).alias("_b")))
    return best.select(*g, (-F.col("_b.ne")).alias(epoch_col), F.col("_b.q").alias(qwk_col))


def model_compare(per_model: DataFrame, model_col: str = "model", qwk_col: str = "qwk") -> DataFrame:
    """Models ordered by QWK with the relative gain over the next weaker model.

    Input is one row per model (already aggregated), so the single ordered window
    runs over a table whose size is the number of models.
    """
    w = Window.orderBy(F.col(qwk_col).asc_nulls_first(), F.col(model_col))
    prev = F.lag(qwk_col).over(w)
    return per_model.select(model_col, qwk_col, (F.col(qwk_col) / F.nullif(prev, F.lit(0.0)) - 1).alias("gain"))


def multitask_loss(df: DataFrame, tasks, group_cols=()) -> DataFrame:
    """Weighted multi-task cross-entropy as an evaluation.

    ``tasks``: list of ``(name, scores_col, target_pos_col, weight)``; the target is
    the 1-based class position. Returns per group the mean cross-entropy of each
    task and the mean weighted total.
    """
    g = _as_list(group_cols)
    per_row = df.select(*g, *[cross_entropy(s, t).alias(f"ce_{name}") for name, s, t, _ in tasks])
    total = sum(F.col(f"ce_{name}") * F.lit(float(w)) for name, _, _, w in tasks)
    aggs = [F.avg(f"ce_{name}").alias(f"ce_{name}") for name, *_ in tasks]
    return per_row.withColumn("_tot", total).groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), *aggs, F.avg("_tot").alias("loss"))
