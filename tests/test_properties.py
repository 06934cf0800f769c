"""Randomised parity of the text expressions with plain Python on the same inputs (one Spark job per check)."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ratingspark.functions import text as tx

MARKER_TEXT = st.text(alphabet="[]0123456789 ab", max_size=30)
WORDY_TEXT = st.text(alphabet="abcXYZ019_ éüßçñ,.;-'\n\t日本語", max_size=60)


def py_extract_score(s):
    m = re.search(r"\[\[([0-9]+)\]\]", s)
    if not m:
        return 3
    v = int(m.group(1))
    return v if v < 2 ** 31 else 3


def py_tokens(s):
    return re.findall(r"(?u)\b\w\w+\b", s.lower())


@settings(max_examples=5, deadline=None)
@given(st.lists(MARKER_TEXT, min_size=50, max_size=50))
def test_extract_score_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", tx.extract_score("t").alias("s")).collect()}
    assert got == {i: py_extract_score(t) for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(WORDY_TEXT, min_size=50, max_size=50))
def test_tokens_match_python_word_pattern(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.k) for r in df.select("i", tx.tokens("t").alias("k")).collect()}
    assert got == {i: py_tokens(t) for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab-_/. é?#&=v1", max_size=20), min_size=50, max_size=50))
def test_sanitize_matches_python(spark, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", tx.sanitize_name("t").alias("s")).collect()}
    assert got == {i: re.sub(r"[^a-zA-Z0-9_\-]", "_", t) for i, t in enumerate(names)}
