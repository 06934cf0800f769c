from ratingspark import fixtures as fx
from ratingspark.operators import reshape as R
from ratingspark.schemas import RUBRICS


def test_unpivot_triples_rows(spark, sf_small):
    wide = fx.rated_wide(spark, sf_small)
    n = wide.count()
    long = R.unpivot_ratings(wide, keep=("doc_id",))
    assert long.count() == 3 * n
    assert {r[0] for r in long.select("rationale_type").distinct().collect()} == {f"{r}_score" for r in RUBRICS}


def test_nest_then_flatten_is_identity(spark, sf_small):
    wide = fx.rated_wide(spark, sf_small).withColumnRenamed("doc_id", "id")
    cols = ["id", "transcript"] + [c for r in RUBRICS for c in (f"{r}_score", f"{r}_score_rationale")]
    back = R.flatten_nested(R.nest_ratings(wide, id_col="id")).select(*cols)
    assert back.exceptAll(wide.select(*cols)).count() == 0
    assert wide.select(*cols).exceptAll(back).count() == 0


def test_normalize_accepts_writer_spelling(spark):
    df = spark.createDataFrame([("l", 3, "because")], "link string, clarity_score int, clarity_rationale string")
    out = R.normalize_rated(df, ("clarity",))
    assert "clarity_score_rationale" in out.columns and "clarity_rationale" not in out.columns


def test_wide_from_long_roundtrip(spark, sf_small):
    wide = fx.rated_wide(spark, sf_small)
    long = R.unpivot_ratings(wide, keep=("doc_id",)).withColumn("rubric", R.rubric_of())
    back = R.wide_from_long(long, "doc_id")
    cols = back.columns
    assert back.exceptAll(wide.select(*cols)).count() == 0
