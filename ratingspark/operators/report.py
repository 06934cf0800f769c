"""Per-pitch rating report and verdict.

The (rubric, score) -> sentence table is built from a rule and is a handful of
rows, so it is applied as a ``CASE`` expression per row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.functions.text import extract_score
from ratingspark.operators.reshape import normalize_rated
from ratingspark.schemas import RUBRICS

# Our own wording. Scores 2..5 have their own level; anything else reads as level 1.
LEVELS = {5: "excellent", 4: "good", 3: "adequate", 2: "weak", 1: "poor"}
PASS_TEXT = "Promising pitch"
FAIL_TEXT = "Needs more work"
# Fixed value: a mean of the rubric scores at or above 3.5 passes, checked as 2 * sum >= 7 * n.
PASS_MEAN_TIMES_2 = 7


def category(rubric: str) -> str:
    return rubric.replace("_", " ").title()


def sentence(rubric: str, score: int) -> str:
    return f"{category(rubric)} is {LEVELS[score]} ({score} of 5)."


def description(rubric: str, score: Column) -> Column:
    """Fixed sentence for the score; scores outside 2..5 (and NULL) get the level-1 sentence."""
    expr = F.when(score == 5, F.lit(sentence(rubric, 5)))
    for s in (4, 3, 2):
        expr = expr.when(score == s, F.lit(sentence(rubric, s)))
    return expr.otherwise(F.lit(sentence(rubric, 1)))


def rating_report(wide: DataFrame, key: str = "link", rubrics=RUBRICS, text_col: str = "transcript") -> DataFrame:
    """Three rows per pitch with a non-empty transcript: ``key, Category, Score (1-5), Description``."""
    df = normalize_rated(wide, rubrics).where(F.length(F.col(text_col)) > 0)
    rows = F.array(*[
        F.struct(F.lit(category(r)).alias("Category"), F.col(f"{r}_score").alias("Score (1-5)"),
                 description(r, F.col(f"{r}_score")).alias("Description"))
        for r in rubrics
    ])
    return df.select(key, F.inline(rows))


def explanation(wide: DataFrame, key: str = "link", rubrics=RUBRICS) -> DataFrame:
    """One text block per pitch: each rubric's sentence and rationale, in rubric order."""
    df = normalize_rated(wide, rubrics)
    blocks = [F.concat_ws("\n", description(r, F.col(f"{r}_score")), F.col(f"{r}_score_rationale")) for r in rubrics]
    return df.select(key, F.concat_ws("\n\n", *blocks).alias("explanation"))


def verdict(wide: DataFrame, key: str = "link", rubrics=RUBRICS) -> DataFrame:
    """``overall`` = mean score; ``passed`` when the mean is at least 3.5 (integer test, no float edge). All three are
    NULL while a score is missing."""
    wide = normalize_rated(wide, rubrics)
    total = sum((F.col(f"{r}_score") for r in rubrics), F.lit(0))
    n = len(rubrics)
    passed = total * 2 >= F.lit(PASS_MEAN_TIMES_2 * n)
    return wide.select(key, (total / F.lit(float(n))).alias("overall"), passed.alias("passed"),
                       F.when(passed, F.lit(PASS_TEXT)).when(~passed, F.lit(FAIL_TEXT)).alias("verdict"))


def score_audit(long: DataFrame, rubric_col: str = "rubric", rationale_col: str = "rationale", low: int = 1, high: int = 5) -> DataFrame:
    """The parser's silent default made visible: rationales per rubric with a score, without one, and out of range."""
    score = extract_score(rationale_col, strict=True)
    return long.groupBy(rubric_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(score.isNotNull()).alias("n_parsed"), F.count_if(score.isNull()).alias("n_defaulted"),
        F.count_if(~score.between(low, high)).alias("n_out_of_range"))
