from pyspark.sql import functions as F

from ratingspark.functions import text as tx

# Golden rows (FIXTURES.md §3).
SCORE_ROWS = [
    ("a [[4]] b [[2]]", 4), ("none", 3), ("[[ 5 ]]", 3), ("[[10]]", 10), ("[[007]]", 7),
    ("[[x]] [[3]]", 3), ("", 3), (None, 3), ("[[99999999999]]", 3), ("[[٤]]", 3),
]

URL_ROWS = [
    ("https://www.youtube.com/watch?v=abc&pp=ygU", "https://www.youtube.com/watch?v=abc"),
    ("https://www.youtube.com/watch?pp=1&v=abc", "https://www.youtube.com/watch?v=abc"),
    ("https://y.com/shorts/abc?feature=x", "https://y.com/shorts/abc"),
    ("https://y.com/watch?v=&pp=1", "https://y.com/watch"),
    ("https://y.com/w?v=a&v=b&c=1", "https://y.com/w?v=a&v=b"),
    ("https://y.com/w?pv=1&v=2#frag", "https://y.com/w?v=2#frag"),
    ("https://y.com/w#top", "https://y.com/w#top"),
    ("https://y.com/w?x=1;v=3", "https://y.com/w"),
]


def test_extract_score_golden(spark):
    df = spark.createDataFrame(SCORE_ROWS, "t string, want int")
    got = df.select("want", tx.extract_score("t").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got), got


def test_extract_score_strict_gives_null(spark):
    df = spark.createDataFrame([("none",), ("[[2]]",)], "t string")
    got = [r[0] for r in df.select(tx.extract_score("t", strict=True)).collect()]
    assert got == [None, 2]


def test_clean_url_golden(spark):
    df = spark.createDataFrame(URL_ROWS, "u string, want string")
    got = df.select("want", tx.clean_url("u", "v").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got), got


def test_sanitize_and_hosts(spark):
    df = spark.createDataFrame([("a b/c-d_e.mp4",)], "n string")
    assert df.select(tx.sanitize_name("n")).first()[0] == "a_b_c-d_e_mp4"
    df = spark.createDataFrame([("https://youtu.be/x",), ("https://vimeo.com/1",), (None,)], "u string")
    assert [r[0] for r in df.select(tx.host_matches("u")).collect()] == [True, False, False]


def test_tokens_unicode(spark):
    df = spark.createDataFrame([("Déjà vu, I a été über_cool 42x",)], "t string")
    assert df.select(tx.tokens("t")).first()[0] == ["déjà", "vu", "été", "über_cool", "42x"]


def test_preview_strips_and_cuts(spark):
    df = spark.createDataFrame([("   hello world\n ",)], "t string")
    assert df.select(tx.preview("t", 5)).first()[0] == "hello"
    assert df.select(F.length(tx.preview("t"))).first()[0] == 11
