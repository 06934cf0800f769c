from pyspark.sql import functions as F

from ratingspark.operators import metrics as M
from ratingspark.operators import raters as RT
from ratingspark.operators import splits as S

WORDS = {1: "awful dreadful", 2: "weak poor", 3: "middling average", 4: "solid good", 5: "brilliant superb"}


def _corpus(spark, n=300, labels=(1, 2, 3, 4, 5)):
    rows = []
    for i in range(n):
        lab = labels[i % len(labels)]
        rows.append((i, f"the pitch was {WORDS[lab]} and the team spoke {i % 7} times", lab))
    return spark.createDataFrame(rows, "doc_id long, text string, clarity_score int")


def test_rater_beats_majority_on_separable_rows(spark):
    df = S.split_holdout(_corpus(spark), "doc_id", 0.3)
    pred = RT.fit_predict(df.where("split = 'train'"), df.where("split = 'test'"), "doc_id", rubrics=("clarity",),
                          max_iter=30)
    q = M.qwk(pred).first()["qwk"]
    assert q > 0.8


def test_missing_class_does_not_fail(spark):
    df = _corpus(spark, 120, labels=(1, 2, 4, 5))
    pred = RT.fit_predict(df, df, "doc_id", rubrics=("clarity",), max_iter=20)
    assert {r[0] for r in pred.select("y_pred").distinct().collect()} <= {1, 2, 4, 5}
    assert pred.where(F.col("y_pred").isNull()).count() == 0


def test_cross_validate_refits_per_fold(spark):
    df = S.kfold_hash(_corpus(spark, 200), "doc_id", 3)
    per_rubric, macro = RT.cross_validate(df, "doc_id", n_folds=3, rubrics=("clarity",), max_iter=20)
    by = {r.side: r for r in per_rubric.collect()}
    assert by["test"].n_folds == by["train"].n_folds == 3 and by["test"].qwk_mean > 0.5
    assert by["train"].qwk_mean >= by["test"].qwk_mean
    assert {r.side for r in macro.collect()} == {"train", "test"}


def test_c_equal_one_learns(spark):
    feats = RT.featurize(RT.fit_features(_corpus(spark)), _corpus(spark))
    rater = RT.fit_rater(feats, "clarity_score", reg=None)
    pred = RT.predict(rater, feats, "clarity_score")
    assert pred.where("cast(clarity_score as int) = y_pred").count() > 270


def test_projection_is_centred_and_keeps_the_variance(spark):
    from pyspark.ml.functions import vector_to_array

    rows = RT.featurize(RT.fit_features(_corpus(spark), max_features=12, pca_k=12), _corpus(spark))
    x = [r.x for r in rows.select(vector_to_array("features").alias("x")).collect()]
    means = [sum(c) / len(x) for c in zip(*x)]
    assert max(map(abs, means)) < 1e-9
