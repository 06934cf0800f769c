"""Hot keys: one group holding about a third of all rows must give the same answer as brute force."""
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ratingspark.operators import curate as C
from ratingspark.operators import metrics as M


def _events(spark, n=3000):
    # user 0 holds a third of the rows
    rows = [(i, 0 if i % 3 == 0 else i % 50 + 1, (i * 7919) % 1000) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts long"), rows


def test_top_n_with_hot_group(spark):
    df, rows = _events(spark)
    got = sorted((r.user_id, r.event_id) for r in C.top_n_per_group(df.repartition(6), ["user_id"], ["ts", "event_id"], 20)
                 .collect())
    by = defaultdict(list)
    for e, u, ts in rows:
        by[u].append((ts, e))
    want = sorted((u, e) for u, lst in by.items() for _, e in sorted(lst)[:20])
    assert got == want


def test_dedup_and_resume_with_hot_link(spark):
    rows = [("t", "hot")] * 1000 + [("t", f"l{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "title string, link string").repartition(5)
    assert C.dedup_pairs(df).count() == 201
    done = spark.createDataFrame([("l1",), ("l2",)], "link string")
    out = C.resume(df, done, "link")
    assert out.count() == 199 and out.where("link = 'hot'").count() == 1


def test_qwk_with_hot_rubric(spark):
    rows = [("hot", i % 5 + 1, (i * 3) % 5 + 1) for i in range(3000)] + [("cold", 1, 1), ("cold", 2, 2)]
    df = spark.createDataFrame(rows, "rubric string, y_true int, y_pred int").repartition(7)
    got = {r.rubric: r.n for r in M.qwk(df).collect()}
    assert got == {"hot": 3000, "cold": 2}
    cm = Counter((r[0], r[1], r[2]) for r in rows)
    assert M.confusion(df).agg(F.sum("n")).first()[0] == sum(cm.values())


def test_large_limit_cuts_hot_groups_in_parts(spark):
    df, rows = _events(spark, 9000)
    got = C.top_n_per_group(df.repartition(6), ["user_id"], ["ts", "event_id"], 1500).collect()
    by = defaultdict(list)
    for e, u, ts in rows:
        by[u].append((ts, e))
    assert sorted((r.user_id, r.event_id) for r in got) == sorted((u, e) for u, v in by.items() for _, e in sorted(v)[:1500])


def test_repeated_keys_keep_the_same_row(spark):
    rows = [("k", f"text {i}") for i in range(50)] + [("l", None), ("l", "x")]
    df = spark.createDataFrame(rows, "link string, transcript string")
    done = spark.createDataFrame([("m",)], "link string")
    want = {("k", "text 0"), ("l", None)}
    for n in (1, 7):
        assert {tuple(r) for r in C.resume(df.repartition(n), done, "link").collect()} == want


def test_media_match_with_an_id_in_every_name(spark):
    from ratingspark.operators.media import match_media

    names = spark.createDataFrame([(f"clip_1_{i}",) for i in range(2000)], "name string")
    ids = spark.createDataFrame([("1",), ("1999",), ("nowhere",)], "id string")
    got = {r.id: r.name for r in match_media(ids, names).collect()}
    assert got == {"1": "clip_1_0", "1999": "clip_1_1999", "nowhere": None}
