import hashlib

from ratingspark.operators import baseline as BL


def _train(spark):
    rows = [("r", 1)] * 5 + [("r", 2)] * 5 + [("r", 3)] * 2 + [("s", 4)] * 3 + [("s", 5)]
    return spark.createDataFrame(rows, "rubric string, label int")


def _test(spark):
    return spark.createDataFrame([(k, r) for k in range(50) for r in ("r", "s")], "key long, rubric string")


def test_shares(spark):
    got = {(r.rubric, r.label): round(r.share, 6) for r in BL.label_shares(_train(spark)).collect()}
    assert got[("r", 1)] == round(5 / 12, 6) and got[("s", 5)] == 0.25


def test_majority_ties_to_smallest(spark):
    got = {r.rubric: r.label for r in BL.majority_class(_train(spark)).collect()}
    assert got == {"r": 1, "s": 4}


def test_sampled_single_draw_follows_distribution(spark):
    test = spark.createDataFrame([(k, "s") for k in range(4000)], "key long, rubric string")
    pred = BL.baseline_sampled(_train(spark), test, "key", n_draws=1)
    share5 = pred.where("y_pred = 5").count() / 4000
    assert 0.2 < share5 < 0.3
    assert {r[0] for r in pred.select("y_pred").distinct().collect()} == {4, 5}


def test_sampled_many_draws_is_the_mode(spark):
    pred = BL.baseline_sampled(_train(spark), _test(spark), "key", n_draws=1000)
    got = {r.rubric: {x[0] for x in pred.where(f"rubric = '{r.rubric}'").select("y_pred").distinct().collect()}
           for r in pred.select("rubric").distinct().collect()}
    assert got["s"] == {4}
    assert got["r"] <= {1, 2}


def test_sampled_is_deterministic(spark):
    a = BL.baseline_sampled(_train(spark), _test(spark), "key", n_draws=7).collect()
    b = BL.baseline_sampled(_train(spark), _test(spark).repartition(5), "key", n_draws=7).collect()
    assert sorted(a) == sorted(b)


def test_sampled_draws_equal_digests_read_by_hand_and_are_dealt_over_all_cores(spark):
    train = [("r", 3)] * 5 + [("r", 1)] * 5 + [("r", 2)] * 2 + [("s", 4)] * 3 + [("s", 5)] + [(None, 7)] + [("r", None)]
    test = [(k, g) for k in (None, 1, 2, 3, 3) for g in ("r", "s", "t", None)]
    df = spark.createDataFrame(test, "key long, rubric string").coalesce(1)
    out = BL.baseline_sampled(spark.createDataFrame(train, "rubric string, label int"), df, "key", n_draws=9)

    def expected(k, g):
        labels = sorted(y for r, y in train if r == g and y is not None and g is not None)
        if not labels:
            return None
        text = [f"42:{'' if k is None else k}:{g}:{b}" for b in range(3)]
        hexes = "".join(hashlib.md5(t.encode()).hexdigest() for t in text)
        drawn = [labels[int(hexes[8 * i:8 * i + 8], 16) * len(labels) >> 32] for i in range(9)]
        return min(set(drawn), key=lambda y: (-drawn.count(y), y))

    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=order) == sorted(((k, g, expected(k, g)) for k, g in test), key=order)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
