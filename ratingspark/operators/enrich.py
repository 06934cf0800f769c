"""Enrichment through a user-supplied model call (M1-M5).

The model call (a judge that writes a rationale, a transcriber, a distilled
rater) is the only Python on the data path. It runs inside ``mapInArrow``: the
columns that a row merely carries stay Arrow columns and come out bit for bit as
they went in; only the model's inputs become Python values (NULL as ``None``,
integers as ``int``). The model is built once per task by a user factory, and
everything around it (score parsing, reshaping, error filtering) stays in JVM
column expressions.

Parallelism is the number of partitions of the request table; pass
``num_partitions`` to spread expensive calls evenly (a round-robin shuffle of
the requests, which are small next to the model's work). ``batch_size`` bounds
the rows handed to the model at once, ``args`` are extra arguments of the factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.functions.text import ERROR_PREFIX, extract_score
from ratingspark.operators.prompts import default_rubric_rows
from ratingspark.operators.reshape import wide_from_long
from ratingspark.schemas import RUBRICS

ON_ERROR = ("capture", "empty", "raise")


def _spread(df: DataFrame, num_partitions: int | None) -> DataFrame:
    return df.repartition(num_partitions) if num_partitions else df


def _pieces(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, size or max(1, b.num_rows)):
            yield b.slice(start, size) if size else b


def enrich(df: DataFrame, fn_factory: Callable[..., Callable], input_cols, output_col: str,
           on_error: str = "capture", num_partitions: int | None = None, batch_size: int | None = None,
           args: Mapping | None = None) -> DataFrame:
    """Apply a per-item model call to ``input_cols``; adds ``output_col`` and ``error``.

    ``fn_factory(**args)`` is called once per task and returns ``fn(*values) -> str``
    (NULLs arrive as ``None``).
    On failure: ``capture`` keeps the row with ``output = "ERROR: <message>"``;
    ``empty`` keeps it with an empty output; ``raise`` fails the job. ``error``
    holds the message (NULL on success).
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    fields = [f for f in df.schema.fields if f.name not in (output_col, "error")]
    schema = T.StructType(fields + [T.StructField(output_col, T.StringType()),
                                    T.StructField("error", T.StringType())])
    names = [f.name for f in fields]
    inputs = [input_cols] if isinstance(input_cols, str) else list(input_cols)
    extra = dict(args or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = fn_factory(**extra)
        for b in _pieces(batches, batch_size):
            outs, errs = [], []
            for vals in zip(*[b.column(c).to_pylist() for c in inputs]):
                try:
                    outs.append(fn(*vals))
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - the policy decides
                    if on_error == "raise":
                        raise
                    msg = str(e)
                    outs.append(ERROR_PREFIX + msg if on_error == "capture" else "")
                    errs.append(msg)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(outs, pa.string()),
                                              pa.array(errs, pa.string())], [*names, output_col, "error"])

    return _spread(df, num_partitions).mapInArrow(run, schema)


def guarded(score_batch: Callable[[pd.DataFrame], list], asked: pd.DataFrame, retries: int = 1) -> tuple[list, list]:
    """Rationales of the rows of ``asked`` and, for rows that could not be judged, the error (else None).

    A batch that fails (by an exception, or by an answer of another length) is cut in halves until the bad row stands
    alone; that one is asked ``retries`` times more, then given up. b bad rows of n cost at most about ``2 b log2(n)`` calls more, and ``b * retries``
    retries. Rows of a half that succeeds are not asked again.
    """
    def ask(rows: pd.DataFrame) -> list:
        said = list(score_batch(rows))
        if len(said) != len(rows):
            raise ValueError(f"{len(said)} answers to {len(rows)} requests")
        return said

    said: list = [None] * len(asked)
    errors: list = [None] * len(asked)
    todo = [(0, len(asked), 0)] if len(asked) else []
    while todo:
        lo, hi, tried = todo.pop()
        try:
            said[lo:hi] = ask(asked.iloc[lo:hi].reset_index(drop=True))
        except Exception as e:  # noqa: BLE001 - whatever the scorer raises is the row's error
            if hi - lo > 1:
                middle = (lo + hi) // 2
                todo += [(middle, hi, 0), (lo, middle, 0)]
            elif tried < retries:
                todo.append((lo, hi, tried + 1))
            else:
                errors[lo] = str(e)
    return said, errors


def _judge(score_batch, asked: pd.DataFrame, on_error: str, retries: int) -> tuple[pa.Array, pa.Array]:
    if on_error == "raise":
        said = list(score_batch(asked))
        return pa.array(said, pa.string()), pa.nulls(len(said), pa.string())
    said, errors = guarded(score_batch, asked, retries)
    put = (lambda e: ERROR_PREFIX + e) if on_error == "capture" else (lambda e: "")
    return pa.array([s if e is None else put(e) for s, e in zip(said, errors)], pa.string()), pa.array(errors, pa.string())


def _score_unless(error: str, rationale: str, strict: bool):
    return F.when(F.col(error).isNull(), extract_score(rationale, strict=strict))


def judge_apply(requests: DataFrame, scorer_factory: Callable[..., Callable[[pd.DataFrame], list]],
                key_cols=("link",), rubric_col: str = "rubric", num_partitions: int | None = None,
                strict: bool = False, batch_size: int | None = None, args: Mapping | None = None, on_error: str = "raise",
                retries: int = 1) -> DataFrame:
    """One judging pass over long request rows, one row per (key, rubric).

    ``requests`` carries the key columns, ``rubric_col``, ``system_prompt`` and
    ``user_prompt``. ``scorer_factory(**args)`` (once per task) returns
    ``score_batch(pdf) -> list[str]`` giving one rationale per request row.
    The score is parsed from the rationale in the JVM (first ``[[n]]``; default 3
    unless ``strict``). Returns ``keys..., rubric, rationale, score``.
    For several rubrics of one text, :func:`judge_documents` sends the text once.

    ``on_error``: ``raise`` lets a scorer's exception fail the job; ``capture`` and ``empty`` find the rows that cause it
    (:func:`guarded`), keep them with ``ERROR: <message>`` or an empty rationale and no score, and add ``error``.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    keep = list(key_cols) + [rubric_col]
    src = requests.select(*keep, "system_prompt", "user_prompt")
    schema = T.StructType([f for f in src.schema.fields if f.name in keep]
                          + [T.StructField("rationale", T.StringType()), T.StructField("error", T.StringType())])
    extra = dict(args or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_batch = scorer_factory(**extra)
        for b in _pieces(batches, batch_size):
            asked = pd.DataFrame({c: b.column(c).to_pylist() for c in (rubric_col, "system_prompt", "user_prompt")})
            said = _judge(score_batch, asked.rename(columns={rubric_col: "rubric"}), on_error, retries)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *said], schema.names)

    judged = _spread(src, num_partitions).mapInArrow(run, schema)
    return judged.select(*keep, "rationale", _score_unless("error", "rationale", strict).alias("score"),
                         *(["error"] if on_error != "raise" else []))


def judge_documents(docs: DataFrame, scorer_factory: Callable[..., Callable[[pd.DataFrame], list]], text_col: str = "transcript",
                    keep=("doc_id",), rubric_rows=None, num_partitions: int | None = None, strict: bool = False,
                    batch_size: int | None = None, args: Mapping | None = None, on_error: str = "raise", retries: int = 1) -> DataFrame:
    """Every rubric of every document judged in one pass, one wide row per document.

    A document's text goes to Python once; its prompts are put together there from ``rubric_rows`` (rubric, system
    prompt, user prefix), and the wide row with ``<rubric>_score_rationale`` and the parsed ``<rubric>_score`` comes out of
    the same map: nothing is shuffled. The scorer is as in :func:`judge_apply`; it gets a batch per rubric. So is
    ``on_error``, which adds ``<rubric>_score_error``.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    rows = [tuple(r) for r in (rubric_rows or default_rubric_rows())]
    keep = list(keep)
    src = docs.select(*keep, F.col(text_col).alias("_judged_text"))
    schema = T.StructType([f for f in src.schema.fields if f.name in keep]
                          + [T.StructField(f"{r}_score_{what}", T.StringType()) for r, _, _ in rows for what in ("rationale", "error")])
    extra = dict(args or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_batch = scorer_factory(**extra)
        for b in _pieces(batches, batch_size):
            texts = [t or "" for t in b.column("_judged_text").to_pylist()]
            said = [a for r, system, prefix in rows for a in _judge(score_batch, pd.DataFrame({
                "rubric": r, "system_prompt": system, "user_prompt": [prefix + t for t in texts]}), on_error, retries)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *said], schema.names)

    judged = _spread(src, num_partitions).mapInArrow(run, schema)
    return judged.select(*keep, *[c for r, _, _ in rows for c in (
        _score_unless(f"{r}_score_error", f"{r}_score_rationale", strict).alias(f"{r}_score"), F.col(f"{r}_score_rationale"),
        *([F.col(f"{r}_score_error")] if on_error != "raise" else []))])


def judged_wide(judged: DataFrame, key: str, rubrics=RUBRICS, rubric_col: str = "rubric") -> DataFrame:
    """Long judgements -> one row per key with ``<rubric>_score`` and ``<rubric>_score_rationale``."""
    return wide_from_long(judged, key, rubrics, rubric_col, "score", "rationale")


# ---------------------------------------------------------------- offline test models

def length_scorer_factory():
    """Deterministic offline judge: the score is 1 + (characters of the transcript part) mod 5."""
    def score_batch(pdf: pd.DataFrame) -> list[str]:
        out = []
        for rubric, user in zip(pdf["rubric"], pdf["user_prompt"]):
            n = len(user or "")
            out.append(f"Assessed {rubric} over {n} characters. [[{1 + n % 5}]]")
        return out
    return score_batch


def word_scorer_factory(marker: str = "and", per: int = 10):
    """A second offline judge, in the distilled rater's role: its score grows with the share of one word among all
    (one point per ``per`` occurrences in a thousand words, 1 to 5)."""
    def score_batch(pdf: pd.DataFrame) -> list[str]:
        out = []
        for user in pdf["user_prompt"]:
            words = (user or "").split(" ")
            share = 1000 * words.count(marker) // len(words)
            out.append(f"{share} in a thousand words are '{marker}'. [[{1 + min(4, share // per)}]]")
        return out
    return score_batch


def failing_scorer_factory(fail_every: int = 13, on_call: Callable[[int], None] = lambda n: None):
    """The length judge, except that a batch holding a prompt whose length is divisible by ``fail_every`` fails as a whole.
    ``on_call`` is told the size of every batch."""
    score = length_scorer_factory()

    def score_batch(pdf: pd.DataFrame) -> list[str]:
        on_call(len(pdf))
        for user in pdf["user_prompt"]:
            if len(user) % fail_every == 0:
                raise ValueError(f"cannot rate {len(user)} characters")
        return score(pdf)
    return score_batch


def failing_transcriber_factory(fail_every: int = 17):
    """Offline transcriber ``fn(key, text)``: ``"<n> chars: <text>"``; fails when
    ``key % fail_every == 0``."""
    def transcribe(key, text):
        if key is not None and int(key) % fail_every == 0:
            raise ValueError(f"cannot transcribe {int(key)}")
        text = text or ""
        return f"{len(text)} chars: {text}"
    return transcribe
