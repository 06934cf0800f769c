"""Baseline raters fitted on the training labels (A1-A3).

* ``label_shares``: class distribution per rubric, with each class's place in the order of labels.
* ``baseline_majority``: every test row gets the most frequent training class.
* ``baseline_sampled``: each test row draws ``n_draws`` labels from the training
  distribution and keeps the mode (ties to the smallest label); ``n_draws=1`` is
  a single random draw.

The draws are hashed uniforms of (seed, key, draw number), so results do not
depend on partitioning. A group's distribution is one row (an array with one entry
per label) that joins the test rows; the draws are made and counted inside the row (a Python helper, Spark deals the rows),
so they are never shuffled, whatever the sizes. How the one-row-per-group tables join is left to
the planner, which knows their measured size.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.functions.hashing import salted_text

TWO32 = 1 << 32


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def label_shares(train: DataFrame, group_cols=("rubric",), label_col: str = "label") -> DataFrame:
    """``group..., label, n, share, place`` with share = n / rows of the group and place = 1, 2, ... by label inside it."""
    g = _as_list(group_cols)
    counts = train.where(F.col(label_col).isNotNull()).groupBy(*g, F.col(label_col).alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    # One row per (group, label): both windows run over the small aggregate.
    w = Window.partitionBy(*g) if g else Window.partitionBy()
    return (counts.withColumn("share", F.col("n") / F.sum("n").over(w))
            .withColumn("place", F.row_number().over(w.orderBy("label"))))


def majority_class(train: DataFrame, group_cols=("rubric",), label_col: str = "label") -> DataFrame:
    """``group..., label``: most frequent class, smallest label on ties (an aggregate, no window)."""
    g = _as_list(group_cols)
    counts = train.where(F.col(label_col).isNotNull()).groupBy(*g, F.col(label_col).alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*g).agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("nl"))).alias("_b"))
    return best.select(*g, (-F.col("_b.nl")).cast("int").alias("label"))


def baseline_majority(train: DataFrame, test: DataFrame, group_cols=("rubric",), label_col: str = "label",
                      pred_col: str = "y_pred") -> DataFrame:
    """Test rows with the training majority class as prediction."""
    g = _as_list(group_cols)
    return test.join(majority_class(train, g, label_col).withColumnRenamed("label", pred_col), g, "left")


def _intervals(train: DataFrame, g: list[str], label_col: str) -> DataFrame:
    """Per group one array ``_law`` of (hi, neg), by label: a draw of the 32-bit uniforms picks label -neg of the first ``hi`` above it.

    With ``hi`` the label's cumulative count out of ``tot`` rows, a draw ``u`` lies below the label's bound when
    ``u * tot < hi * 2^32``, i.e. when ``u < ceil(hi * 2^32 / tot)``. The bounds are exact integers.
    """
    counts = train.where(F.col(label_col).isNotNull()).groupBy(*g, F.col(label_col).alias("_label")) \
        .agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g)
    bounds = counts.select(*g, "_label", F.sum("_c").over(w.orderBy("_label").rowsBetween(Window.unboundedPreceding, 0)).alias("_hi"),
                           F.sum("_c").over(w).alias("_tot"))
    cut = F.expr(f"CAST((CAST(_hi AS DECIMAL(38,0)) * {TWO32} + _tot - 1) div CAST(_tot AS DECIMAL(38,0)) AS BIGINT)")
    entry = F.struct(F.col("_hi").alias("at"), cut.alias("hi"), (-F.col("_label")).alias("neg"))
    return bounds.groupBy(*g).agg(F.sort_array(F.collect_list(entry)).alias("_law"))


def _counted(n: int) -> Callable:
    """UDF of (start of the digests' text, bounds): how many of ``n`` draws lie below each bound and not below the one before."""
    blocks = [b":%d" % b for b in range((n + 3) // 4)]

    @F.arrow_udf("array<int>")
    def counted(start: pa.Array, bounds: pa.Array) -> pa.Array:
        out = []
        for text, his in zip(start.to_pylist(), bounds.to_pylist(), strict=True):
            if his is None:
                out.append(None)
                continue
            digests = b"".join([md5(text + b, usedforsecurity=False).digest() for b in blocks])
            # What lies below each bound, less what lies below the one before.
            below = np.sort(np.frombuffer(digests, ">u4")[:n].astype(np.int64)).searchsorted(his)
            out.append(np.diff(below, prepend=0))
        return pa.array(out, pa.list_(pa.int32()))

    return counted


def baseline_sampled(train: DataFrame, test: DataFrame, key: str, n_draws: int = 1000, seed: int | str = 42,
                     group_cols=("rubric",), label_col: str = "label", pred_col: str = "y_pred") -> DataFrame:
    """Mode of ``n_draws`` draws from the training label distribution per test row.

    Each md5 digest of ``seed:key:group:block`` gives four 32-bit draws: draw 4*b + k is its hex digits 8k+1 to 8k+8.
    A row's draws are counted by label in one call; ties go to the smallest label. The rows are few and small beside
    what their draws cost, so they are dealt evenly over all cores first.
    """
    g = _as_list(group_cols)
    if not g:
        train, test, g = train.withColumn("_all", F.lit(0)), test.withColumn("_all", F.lit(0)), ["_all"]
    spark = test.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    start = salted_text(str(seed), key, *g).cast("binary")
    rows = test.join(_intervals(train, g, label_col), g, "left").repartition(tasks)
    counts = rows.withColumn("_k", _counted(int(n_draws))(start, F.col("_law")["hi"]))
    mode = F.array_max(F.zip_with("_k", "_law", lambda k, e: F.struct(k.alias("k"), e["neg"].alias("neg"))))
    out = counts.withColumn(pred_col, (-mode["neg"]).cast("int")).select(*test.columns, pred_col)
    return out.drop("_all") if "_all" in g else out
