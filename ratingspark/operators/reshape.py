"""Wide / long / nested / pair reshaping of rated tables.

All operators are narrow (per-row) transformations: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.schemas import RUBRICS

# Rationale columns as written by the judging stage of older runs.
_ALT_RATIONALE = {r: f"{r}_rationale" for r in RUBRICS}


def normalize_rated(df: DataFrame, rubrics=RUBRICS) -> DataFrame:
    """Accept both rationale spellings; emit canonical ``<rubric>_score_rationale``."""
    cols = set(df.columns)
    out = df
    for r in rubrics:
        canon = f"{r}_score_rationale"
        alt = _ALT_RATIONALE.get(r, f"{r}_rationale")
        if canon not in cols and alt in cols:
            out = out.withColumnRenamed(alt, canon)
        elif canon in cols and alt in cols:
            out = out.withColumn(canon, F.coalesce(F.col(canon), F.col(alt))).drop(alt)
    return out


def unpivot_ratings(df: DataFrame, rubrics=RUBRICS, keep=("title", "link", "transcript"),
                    extra=()) -> DataFrame:
    """Wide -> long: one (rationale_type, rationale, score) row per rubric.

    The pairs are stacked together, so a row keeps its own rationale and score.
    ``extra`` suffixes (e.g. ``"pred"``) stack ``<rubric>_<suffix>`` columns alongside.
    """
    df = normalize_rated(df, rubrics)
    tuples = ", ".join(
        ", ".join([f"'{r}_score'", f"`{r}_score_rationale`", f"`{r}_score`"] + [f"`{r}_{x}`" for x in extra])
        for r in rubrics)
    names = ", ".join(["rationale_type", "rationale", "score"] + list(extra))
    if missing := [c for c in keep if c not in df.columns]:
        raise ValueError(f"no such columns to keep: {missing}")
    keep_cols = [f"`{c}`" for c in keep]
    return df.selectExpr(*keep_cols, f"stack({len(rubrics)}, {tuples}) as ({names})")


def rubric_of(rationale_type_col: str = "rationale_type"):
    """``clarity_score`` -> ``clarity``."""
    return F.regexp_replace(F.col(rationale_type_col), r"_score$", "")


def nest_ratings(df: DataFrame, id_col: str = "doc_id", rubrics=RUBRICS) -> DataFrame:
    """Wide -> ``id, transcript, rationales{rubric{rationale, score}}``."""
    df = normalize_rated(df, rubrics)
    rationales = F.struct(*[
        F.struct(F.col(f"{r}_score_rationale").alias("rationale"), F.col(f"{r}_score").alias("score")).alias(r)
        for r in rubrics
    ])
    return df.select(F.col(id_col).cast("bigint").alias("id"), "transcript", rationales.alias("rationales"))


def flatten_nested(df: DataFrame, rubrics=RUBRICS) -> DataFrame:
    """Nested -> wide, the inverse of :func:`nest_ratings`."""
    cols = [F.col("id"), F.col("transcript")]
    for r in rubrics:
        cols += [F.col(f"rationales.{r}.score").alias(f"{r}_score"),
                 F.col(f"rationales.{r}.rationale").alias(f"{r}_score_rationale")]
    return df.select(*cols)


def flatten_struct(df: DataFrame, struct_col: str) -> DataFrame:
    """``json_normalize`` of one record column: its fields become top-level columns."""
    others = [c for c in df.columns if c != struct_col]
    return df.select(*others, f"{struct_col}.*")


def wide_from_long(df: DataFrame, key: str, rubrics=RUBRICS, rubric_col: str = "rubric",
                   score_col: str = "score", rationale_col: str = "rationale") -> DataFrame:
    """Long -> wide. One shuffle on ``key`` (grouped pivot with a fixed value list).

    Of repeated (key, rubric) rows the one with the largest score stays, with its own rationale (largest on ties).
    """
    pair = F.struct(F.col(score_col).alias("score"), F.col(rationale_col).alias("rationale"))
    best = df.groupBy(key).agg(*[F.max(F.when(F.col(rubric_col) == r, pair)).alias(f"_{r}") for r in rubrics])
    return best.select(key, *[c for r in rubrics for c in (F.col(f"_{r}.score").alias(f"{r}_score"),
                                                           F.col(f"_{r}.rationale").alias(f"{r}_score_rationale"))])


# Wording of the sequence-to-sequence pairs (our own short test wording).
SEQ2SEQ_INPUT_PREFIX = "Rate this pitch transcript: "


def seq2seq_pairs(df: DataFrame, rubrics=RUBRICS, input_prefix: str = SEQ2SEQ_INPUT_PREFIX,
                  keep=()) -> DataFrame:
    """Wide -> ``input_text, target_text``; the target lists every rubric's analysis in order."""
    df = normalize_rated(df, rubrics)
    parts = [
        F.concat(F.lit(f"{r}: "), F.coalesce(F.col(f"{r}_score_rationale"), F.lit("")),
                 F.lit(" (score "), F.coalesce(F.col(f"{r}_score").cast("string"), F.lit("")), F.lit(")"))
        for r in rubrics
    ]
    return df.select(*keep, F.concat(F.lit(input_prefix), F.coalesce(F.col("transcript"), F.lit("")))
                     .alias("input_text"), F.concat_ws("\n", *parts).alias("target_text"))
