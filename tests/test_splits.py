from pyspark.sql import functions as F

from ratingspark.operators import splits as S


def test_holdout_disjoint_covering_and_partition_free(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {(r.k, r.split) for r in S.split_holdout(df, "k").collect()}
    b = {(r.k, r.split) for r in S.split_holdout(df.repartition(7), "k").collect()}
    assert a == b and len(a) == 2000
    test_share = sum(1 for _, s in a if s == "test") / 2000
    assert 0.15 < test_share < 0.25


def test_three_way_proportions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    counts = {r.split: r["count"] for r in S.split_three_way(df, "k").groupBy("split").count().collect()}
    assert set(counts) == {"train", "val", "test"} and sum(counts.values()) == 5000
    assert 0.65 < counts["train"] / 5000 < 0.75


def test_kfold_exact_sizes(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    sizes = sorted((r.fold, r["count"]) for r in S.kfold_exact(df, "k", 5).groupBy("fold").count().collect())
    assert [n for _, n in sizes] == [2, 2, 1, 1, 1]


def test_kfold_exact_same_under_repartition(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a = {(r.k, r.fold) for r in S.kfold_exact(df, "k", 5, num_partitions=3).collect()}
    b = {(r.k, r.fold) for r in S.kfold_exact(df.repartition(11), "k", 5, num_partitions=6).collect()}
    assert a == b and len(a) == 1003


def test_grouped_split_has_no_leak(spark):
    df = spark.range(300).select(F.col("id").alias("doc"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("r"))
    by_doc = S.leak_count(S.split_holdout(df, "doc"), "doc").first()
    assert by_doc.n_leaked == 0 and by_doc.n_groups == 300
    rows = S.split_holdout(df.withColumn("row", F.concat_ws(":", "doc", "r")), "row")
    assert S.leak_count(rows, "doc").first().n_leaked > 0


def test_exact_splits_have_library_sizes(spark):
    import math
    for n in (7, 10, 1001):
        df = spark.range(n).withColumnRenamed("id", "k")
        c = {r.split: r["count"] for r in S.split_three_way_exact(df, "k").groupBy("split").count().collect()}
        held = math.ceil(0.3 * n)
        assert c.get("test", 0) == math.ceil(0.5 * held) and c.get("val", 0) == held - math.ceil(0.5 * held)
        assert sum(c.values()) == n
        h = {r.split: r["count"] for r in S.split_holdout_exact(df, "k", 0.2).groupBy("split").count().collect()}
        assert h["test"] == math.ceil(0.2 * n)
