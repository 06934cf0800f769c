"""Deterministic splits and folds (SP1-SP4) and the leak counter.

A row's side is a pure function of its key and the seed (a salted md5), so the
assignment needs no sort, does not move data, and is the same under any
partitioning or re-run. Keying on a group column (the document) keeps all rows
of one document on one side. Exact fold sizes, when wanted, come from a
distributed global rank (range partitioning, per-partition counts and offsets),
never from a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.functions.hashing import below, salted_md5, threshold_hex, unit_hash
from ratingspark.session import cut_lineage


def holdout_side(key, test_share: float = 0.2, seed: int | str = 42) -> Column:
    """``'test'`` for about ``test_share`` of keys, else ``'train'``."""
    return F.when(below(str(seed), key, test_share), F.lit("test")).otherwise(F.lit("train"))


def split_holdout(df: DataFrame, key: str, test_share: float = 0.2, seed: int | str = 42,
                  side_col: str = "split") -> DataFrame:
    return df.withColumn(side_col, holdout_side(key, test_share, seed))


def three_way_side(key, val_share: float = 0.15, test_share: float = 0.15, seed: int | str = 42) -> Column:
    """train / val / test from one hash and two thresholds (70/15/15 by default)."""
    h = F.substring(salted_md5(str(seed), key), 1, 8)
    return (F.when(h < F.lit(threshold_hex(test_share)), F.lit("test"))
            .when(h < F.lit(threshold_hex(test_share + val_share)), F.lit("val"))
            .otherwise(F.lit("train")))


def split_three_way(df: DataFrame, key: str, val_share: float = 0.15, test_share: float = 0.15,
                    seed: int | str = 42, side_col: str = "split") -> DataFrame:
    return df.withColumn(side_col, three_way_side(key, val_share, test_share, seed))


def leak_count(df: DataFrame, group_key: str, side_col: str = "split") -> DataFrame:
    """Groups (e.g. transcripts) whose rows landed on more than one side.

    One aggregate on the group key, combined map-side; no self-join.
    """
    per_group = df.groupBy(group_key).agg(F.countDistinct(side_col).alias("_sides"))
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"),
                         F.count_if(F.col("_sides") > 1).alias("n_leaked"))


def kfold_hash(df: DataFrame, key: str, k: int = 5, seed: int | str = 42, fold_col: str = "fold") -> DataFrame:
    """Fold 0..k-1 by hash bucket: no shuffle, sizes close to n/k."""
    return df.withColumn(fold_col, F.pmod(unit_hash(str(seed), key), F.lit(k)).cast("int"))


def global_rank(df: DataFrame, order_cols: list[str], rank_col: str = "_rank",
                num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """0-based rank of each row in the total order ``order_cols`` (must be unique), computed
    without gathering the table in one task.

    Only the order columns are ranked: they are range-partitioned (``spark.sql.shuffle.partitions`` unless given) and
    sorted within partitions, then written as a reliable checkpoint so both passes below see the same partitions. Each
    partition's row count (a table with one row per partition) gives the
    offsets; a row's rank is its partition offset plus its index inside the
    partition (the low 33 bits of ``monotonically_increasing_id``). The ranks then join the table by the order columns.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order_cols)
    ordered = cut_lineage(keys.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    mid = F.monotonically_increasing_id()
    tagged = ordered.select("*", F.shiftright(mid, 33).alias("_pid"),
                            mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("_idx"))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("_tot"))
    # One row per partition: bounded by the partition count chosen above.
    ranked = tagged.join(F.broadcast(offsets), "_pid").withColumn(rank_col, F.col("_off") + F.col("_idx"))
    if total_col:
        ranked = ranked.withColumnRenamed("_tot", total_col)
    ranked = ranked.drop("_pid", "_idx", "_off", "_tot")
    if set(df.columns) == set(order_cols):
        return ranked
    ranked = ranked.select(*[F.col(c).alias(f"_o{i}") if c in order_cols else F.col(c) for i, c in enumerate(ranked.columns)])
    same = [df[c].eqNullSafe(ranked[f"_o{i}"]) for i, c in enumerate(order_cols)]
    return df.join(ranked, same).drop(*[f"_o{i}" for i in range(len(order_cols))])


def kfold_exact(df: DataFrame, key: str, k: int = 5, seed: int | str = 42, fold_col: str = "fold",
                num_partitions: int | None = None) -> DataFrame:
    """Shuffled k-fold with exact sizes: the first ``n % k`` folds hold one row more.

    Rows are ordered by (salted hash, key); fold boundaries follow from the rank.
    """
    h = "_kf_h"
    base = df.withColumn(h, salted_md5(str(seed), key))
    ranked = global_rank(base, [h, key], "_r", num_partitions, total_col="_total")
    r = F.col("_r")
    n = F.col("_total")
    q = F.floor(n / k)
    rem = n % k
    big = rem * (q + 1)
    fold = F.when(r < big, F.floor(r / (q + 1))).otherwise(rem + F.floor((r - big) / F.greatest(q, F.lit(1))))
    return ranked.withColumn(fold_col, fold.cast("int")).drop(h, "_r", "_total")


def _ceil_share(share: float, n):
    return F.ceil(F.lit(float(share)) * n.cast("double"))


def split_holdout_exact(df: DataFrame, key: str, test_share: float = 0.2, seed: int | str = 42,
                        side_col: str = "split", num_partitions: int | None = None) -> DataFrame:
    """Holdout with exact sizes: ``ceil(test_share * n)`` test rows, the first in (salted hash, key) order."""
    h = "_sp_h"
    ranked = global_rank(df.withColumn(h, salted_md5(str(seed), key)), [h, key], "_r", num_partitions, "_n")
    side = F.when(F.col("_r") < _ceil_share(test_share, F.col("_n")), F.lit("test")).otherwise(F.lit("train"))
    return ranked.withColumn(side_col, side).drop(h, "_r", "_n")


def split_three_way_exact(df: DataFrame, key: str, held_share: float = 0.3, test_of_held: float = 0.5,
                          seed: int | str = 42, side_col: str = "split",
                          num_partitions: int | None = None) -> DataFrame:
    """Two nested exact splits: ``ceil(held_share * n)`` rows are held out, and ``ceil(test_of_held * held)``
    of those are test, the rest validation (70/15/15 by default)."""
    h = "_sp_h"
    ranked = global_rank(df.withColumn(h, salted_md5(str(seed), key)), [h, key], "_r", num_partitions, "_n")
    held = _ceil_share(held_share, F.col("_n"))
    n_test = F.ceil(F.lit(float(test_of_held)) * held.cast("double"))
    r = F.col("_r")
    side = F.when(r < n_test, F.lit("test")).when(r < held, F.lit("val")).otherwise(F.lit("train"))
    return ranked.withColumn(side_col, side).drop(h, "_r", "_n")
