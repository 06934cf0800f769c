"""Fixed schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The three rubric names, in this order everywhere.
RUBRICS = ("clarity", "team_market_fit", "traction_validation")

# Canonical column names of the wide rated table.
SCORE_COLS = tuple(f"{r}_score" for r in RUBRICS)
RATIONALE_COLS = tuple(f"{r}_score_rationale" for r in RUBRICS)

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
D = T.DoubleType()

SEARCH_HITS = T.StructType([T.StructField("title", S), T.StructField("link", S)])

TRANSCRIPTS = T.StructType(SEARCH_HITS.fields + [T.StructField("transcript", S)])

RATED_WIDE = T.StructType(
    TRANSCRIPTS.fields
    + [f for r in RUBRICS for f in (T.StructField(f"{r}_score", I), T.StructField(f"{r}_score_rationale", S))]
)

RATED_LONG = T.StructType(TRANSCRIPTS.fields + [
    T.StructField("rationale_type", S),
    T.StructField("rationale", S),
    T.StructField("score", I),
])

MESSAGE = T.StructType([T.StructField("role", S), T.StructField("content", S)])
CHAT = T.ArrayType(MESSAGE)

RUBRIC_ENTRY = T.StructType([T.StructField("rationale", S), T.StructField("score", I)])
NESTED = T.StructType([
    T.StructField("id", L),
    T.StructField("transcript", S),
    T.StructField("rationales", T.StructType([T.StructField(r, RUBRIC_ENTRY) for r in RUBRICS])),
])

SEQ2SEQ = T.StructType([T.StructField("input_text", S), T.StructField("target_text", S)])

PREDICTIONS = T.StructType([
    T.StructField("key", S),
    T.StructField("rubric", S),
    T.StructField("fold", I),
    T.StructField("y_true", I),
    T.StructField("y_pred", I),
])

METRICS = T.StructType([
    T.StructField("model", S),
    T.StructField("split", S),
    T.StructField("epoch", I),
    T.StructField("fold", I),
    T.StructField("rubric", S),
    T.StructField("qwk", D),
])

REPORT = T.StructType([
    T.StructField("Category", S),
    T.StructField("Score (1-5)", I),
    T.StructField("Description", S),
])

RUBRIC_TABLE = T.StructType([
    T.StructField("rubric", S),
    T.StructField("system_prompt", S),
    T.StructField("user_prefix", S),
])
