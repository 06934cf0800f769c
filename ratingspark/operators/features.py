"""Text features: term counts, top-k vocabulary and TF-IDF.

TF-IDF follows the common library defaults: raw term counts, smoothed
``idf = ln((1 + n) / (1 + df)) + 1``, rows scaled to unit L2 norm, vocabulary
limited to the ``k`` most frequent terms of the fitting set (ties by term).

Everything is a DataFrame in long form ``(doc, term, value)``. Corpus and document frequency come from one aggregate
by term, combined map-side; the vocabulary is a top-k of it. The fitted model (vocabulary + idf) has at most ``k`` rows
and is broadcast up to ``MAX_MODEL`` rows; only tokens of the vocabulary are shuffled, once, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.functions.text import tokens

MAX_FEATURES = 500
#: Models of up to this many terms are broadcast (terms are words: a few MB).
MAX_MODEL = 100_000


def doc_terms(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``key, term, tf``: count of each token in each document."""
    toks = df.select(key, F.explode(tokens(text_col)).alias("term"))
    return toks.groupBy(key, "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))


def term_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n, df``: corpus frequency and number of documents of each term, in one pass and one exchange.

    A row's tokens are counted as they are, its distinct ones once more as documents.
    """
    both = F.concat(F.transform("_t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("df"))),
                    F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("df"))))
    rows = df.select(tokens(text_col).alias("_t")).select(F.inline(both))
    return rows.groupBy("term").agg(F.sum("n").cast("bigint").alias("n"), F.sum("df").cast("bigint").alias("df"))


def top_terms(df: DataFrame, k: int = MAX_FEATURES, text_col: str = "text") -> DataFrame:
    """``term, n``: the ``k`` terms with the highest corpus frequency; ties broken by term."""
    freq = df.select(F.explode(tokens(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return freq.orderBy(F.col("n").desc(), F.col("term").asc()).limit(k)


def fit_tfidf(df: DataFrame, k: int = MAX_FEATURES, text_col: str = "text") -> DataFrame:
    """Fitted model ``idx, term, idf`` (at most ``k`` rows) of the documents ``df``.

    ``idx`` is the 0-based column of the term: vocabulary order (frequency desc, term). Documents without any token
    count for idf too.
    """
    vocab = term_stats(df, text_col).orderBy(F.col("n").desc(), F.col("term").asc()).limit(k)
    n_docs = df.count()  # reads no text
    # ``vocab`` has at most ``k`` rows: one ordered window over it is cheap.
    w = Window.orderBy(F.col("n").desc(), F.col("term").asc())
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return vocab.select((F.row_number().over(w) - 1).cast("int").alias("idx"), "term", idf.alias("idf"))


def transform_tfidf(df: DataFrame, model: DataFrame, key: str, text_col: str = "text", k: int = MAX_FEATURES) -> DataFrame:
    """``key, idx, term, weight``: L2-normalised tf * idf over a model of at most ``k`` rows.

    Tokens outside the vocabulary are dropped before the exchange by key, which serves the counts and the norm.
    """
    small = F.broadcast(model) if k <= MAX_MODEL else model
    toks = df.select(key, F.explode(tokens(text_col)).alias("term")).join(small, "term").repartition(key)
    counts = toks.groupBy(key, "idx", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))
    return counts.select(key, "idx", "term", (raw / norm).alias("weight"))
