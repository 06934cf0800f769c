"""Reference-shaped tables derived from the driver's parquet tables (FIXTURES.md §2).

All derivations are per-row column expressions over whole tables: they grow with
the data and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.functions.text import ERROR_PREFIX
from ratingspark.schemas import RUBRICS
from ratingspark.session import table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _rubric_hash(rubric: str) -> Column:
    return F.md5(F.concat(F.lit(f"{rubric}:"), F.col("doc_id").cast("string")))


def derived_score(rubric: str) -> Column:
    h = _rubric_hash(rubric)
    return (F.lit(1) + F.ascii(F.substring(h, 1, 1)) % 5).cast("int")


def derived_pred(rubric: str) -> Column:
    h = _rubric_hash(rubric)
    s = derived_score(rubric)
    return F.greatest(F.lit(1), F.least(F.lit(5), s + F.ascii(F.substring(h, 2, 1)) % 3 - 1)).cast("int")


def derived_rationale(rubric: str, text: Column | None = None) -> Column:
    """A rationale whose marker exercises the parser: none, two, out of range, normal."""
    text = F.col("text") if text is None else text
    quote = F.concat(F.lit("Quote: "), text)
    s = derived_score(rubric).cast("string")
    p = derived_pred(rubric).cast("string")
    m = F.col("doc_id") % 10
    return (F.when(m == 0, quote)
            .when(m == 1, F.concat(quote, F.lit(" [["), s, F.lit("]] then [["), p, F.lit("]]")))
            .when(m == 2, F.concat(quote, F.lit(" [[10]]")))
            .otherwise(F.concat(quote, F.lit(" [["), s, F.lit("]]"))))


def title_col() -> Column:
    return F.concat(F.col("source"), F.lit(" "), F.col("lang"))


def transcripts(spark: SparkSession, sf_dir: str, with_errors: bool = True) -> DataFrame:
    """Title, link, transcript (+ doc_id key). Every 17th row is a failed transcript."""
    d = read(spark, sf_dir, "documents")
    tr = F.col("text")
    if with_errors:
        tr = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit(ERROR_PREFIX), F.col("doc_id").cast("string"))).otherwise(tr)
    return d.select("doc_id", title_col().alias("title"), F.col("doc_id").cast("string").alias("link"),
                    tr.alias("transcript"))


def rated_wide(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Transcripts + three (score, rationale) pairs, canonical names; ``carry``: further columns of the documents."""
    d = read(spark, sf_dir, "documents")
    cols = [F.col("doc_id"), *carry, title_col().alias("title"), F.col("doc_id").cast("string").alias("link"),
            F.col("text").alias("transcript")]
    for r in RUBRICS:
        cols += [derived_score(r).alias(f"{r}_score"), derived_rationale(r).alias(f"{r}_score_rationale")]
    return d.select(*cols)


def rated_with_second_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 plus a second rater's ``<rubric>_pred`` next to each score (same rows, no join)."""
    d = read(spark, sf_dir, "documents")
    cols = [F.col("doc_id"), title_col().alias("title"), F.col("doc_id").cast("string").alias("link"),
            F.col("text").alias("transcript")]
    for r in RUBRICS:
        cols += [derived_score(r).alias(f"{r}_score"), derived_rationale(r).alias(f"{r}_score_rationale"),
                 derived_pred(r).alias(f"{r}_pred")]
    return d.select(*cols)


def second_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of a second rater: doc_id, rubric, y_pred."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    stacked = ", ".join(f"'{r}', pred_{i}" for i, r in enumerate(RUBRICS))
    return (d.select("doc_id", *[derived_pred(r).alias(f"pred_{i}") for i, r in enumerate(RUBRICS)])
            .selectExpr("doc_id", f"stack({len(RUBRICS)}, {stacked}) as (rubric, y_pred)"))
