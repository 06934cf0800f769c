"""Response-only labels against token offsets of Python's scanner."""
import hashlib
import random

import regex
from pyspark.sql import functions as F

from ratingspark.functions import arrays as AR
from ratingspark.functions import text as tx


def test_token_ranges_equal_offsets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        t = "".join(rng.choice("ab1_é ,.Zß\n") for _ in range(rng.randint(0, 40)))
        a = rng.randint(1, len(t) + 1)
        rows.append((i, t, a, rng.randint(a, len(t) + 1)))
    rows.append((300, None, 1, 1))
    got = spark.createDataFrame(rows, "id int, t string, a int, b int").select("id", *tx.token_range("t", "a", "b")).collect()
    for (_, t, a, b), r in zip(rows, sorted(got), strict=True):
        if t is None:
            continue
        at = [m.start() + 1 for m in regex.finditer(tx.TOKEN_PATTERN, t.lower())]
        inside = [i for i, p in enumerate(at) if a <= p < b]
        assert r.n_tokens == len(inside) and (not inside or r.first_token == inside[0])


def test_labels(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 1, 2), ([5], 1, 0), ([], 0, 0), ([1, 2, 3], 2, 9)], "ids array<int>, f int, n int")
    got = df.select(AR.response_labels("ids", "f", "n").alias("w"), AR.response_labels("ids", "f", "n", 3).alias("c")).collect()
    assert [r.w for r in got] == [[-100, 6, 7, -100], [-100], [], [-100, -100, 3]]
    assert [r.c for r in got] == [[-100, 6, 7], [-100] * 3, [-100] * 3, [-100, -100, 3]]
    none = df.select(AR.response_labels(F.lit(None).cast("array<int>"), "f", "n").alias("w")).first()
    assert none.w is None


def test_a_text_falls_into_two_parts_whose_tokens_are_its_tokens(spark):
    rows = [(t, p) for t in ("", "ab", "Ab, cd_1 é ßx\nΣΑΣ y", "a-bc", "αβγ δε") for p in range(-1, len(t) + 3)]
    df = spark.createDataFrame(rows, "t string, p int").select("t", "p", F.lower("t").alias("l"), tx.token_bound(F.lower("t"), "p").alias("at"))
    for r in df.select("*", tx.tokens("t").alias("all"), tx.tokens_of_lower(F.substring("l", F.lit(1), F.col("at"))).alias("head"),
                       tx.tokens_of_lower(F.substring("l", F.col("at") + 1, F.length("l"))).alias("rest")).collect():
        at = [m.start() + 1 for m in regex.finditer(tx.TOKEN_PATTERN, r.l)]
        assert r.head + r.rest == r.all and len(r.head) == sum(a < r.p for a in at)


def test_ids_hash_each_word_and_labels_need_no_lambda(spark):
    from ratingspark.plans.queries import token_ids

    rows = [(["ab", "é", "ab"],), ([],), (None,), (["zz"],)]
    df = spark.createDataFrame(rows, "t array<string>").coalesce(1).select(token_ids("t").alias("i"))
    want = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) + 1
    assert [r.i for r in df.collect()] == [None if t is None else [want(w) for w in t] for (t,) in rows]
    labels = spark.createDataFrame([([5, 6, 7], -1, 3), ([5, 6], 7, 2), ([5], None, 1), ([5], 0, None)], "ids array<int>, f int, n int").select(
        AR.response_labels("ids", "f", "n").alias("w"))
    assert [r.w for r in labels.collect()] == [[5, 6, -100], [-100, -100], [-100], [-100]]
    assert "lambda" not in labels._jdf.queryExecution().executedPlan().toString()
