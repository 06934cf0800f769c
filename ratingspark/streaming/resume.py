"""Incremental, restartable enrichment of newly arrived rows (ST1).

``readStream`` (file source, explicit schema) -> ``foreachBatch``: drop keys already in the sink (anti-join), keep one
row of each other key, enrich, append to the parquet sink. ``trigger(availableNow=True)`` processes what
is there and stops, so the same job serves as a scheduled batch.

No streaming ``dropDuplicates`` state is kept (it would grow without bound); the
sink itself (:mod:`ratingspark.streaming.sink`) is the record of finished keys. A batch reads the keys of only those parts of the sink
that its key index does not rule out. Appends are atomic, so a crash in the middle of one leaves nothing to see, and a crash between the append and the
checkpoint commit replays the batch, and the anti-join makes the replay write
nothing new. Every appended row carries the time of its attempt; :func:`latest` gives one row per key, so retries of
failed keys never show twice. Read a sink with it, or with ``sink.committed``: the folder may hold parts that no append committed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.operators.curate import first_by_key
from ratingspark.streaming import sink as S

ATTEMPT = "_attempt"


def new_rows(batch: DataFrame, sink: str, key: str, retry_errors: bool = False,
             error_col: str | None = None, upto: int | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``sink`` (as of version ``upto``); of rows that repeat a key, the least one."""
    log = S.Log(batch.sparkSession, sink)
    parts = log.parts(upto=upto)
    if parts:
        there = log.read(parts[:1]).columns
        if missing := {key, *([error_col] if error_col and retry_errors else [])} - set(there):
            raise ValueError(f"the sink {sink} has no column {sorted(missing)}")
    done = S.finished(log, parts, batch.select(key), key, error_col if retry_errors else None)
    todo = batch if done is None else batch.join(done, key, "left_anti").select(*batch.columns)
    return first_by_key(todo, key)


def append(rows: DataFrame, sink: str, key: str, since: int | None = None, error_col: str | None = None) -> S.Part | None:
    """Appends ``rows`` with the time of this attempt, in one atomic step (see :func:`ratingspark.streaming.sink.append`)."""
    return S.append(rows.withColumn(ATTEMPT, F.lit(time.time_ns())), sink, key, since, error_col)


def latest(spark: SparkSession, sink: str, key: str, error_col: str = "error") -> DataFrame:
    """One row per key of the sink: the last attempt without an error, else the last one."""
    rows = S.committed(spark, sink)
    if rows is None:
        raise ValueError(f"nothing has been appended to {sink}")
    data = [c for c in rows.columns if c not in (S.PART, ATTEMPT)]
    fine = F.col(error_col).isNull() if error_col in data else F.lit(True)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*data), F.struct(fine, ATTEMPT)).alias("_row"))
    return best.select("_row.*")


def run_incremental(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                    key: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                    source_options: dict | None = None, max_files_per_trigger: int | None = None,
                    fail_after_append: bool = False, retry_errors: bool = False,
                    error_col: str = "error") -> int:
    """Process every file now in ``source`` once; returns the number of micro-batches run.

    ``transform(new_rows) -> rows to append`` is the enrichment (e.g. a model call); its rows keep the key.
    ``fail_after_append`` simulates a crash right after the sink append (tests).
    With ``retry_errors``, keys whose sink rows all carry an ``error_col`` value are
    processed again (by default a failed row counts as done); read the sink with :func:`latest`.
    """
    reader = spark.readStream.schema(schema).format(fmt).options(**(source_options or {}))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source)
    count = {"n": 0}

    def handle(batch: DataFrame, batch_id: int) -> None:
        count["n"] += 1
        seen = S.Log(spark, sink).version()
        append(transform(new_rows(batch, sink, key, retry_errors, error_col, seen)), sink, key, seen, error_col if retry_errors else None)
        if fail_after_append:
            raise RuntimeError(f"simulated crash after batch {batch_id}")

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return count["n"]
