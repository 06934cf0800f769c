"""Exact de-duplication by a 128-bit content hash, with bytes compared inside each hash group.

Rows are grouped by the hash *and* the normalised text, so two texts that share a hash stay apart: the aggregate's
hash map compares bytes after the hash. The partial aggregate runs before the shuffle, so a text copied a million
times leaves each task once. Rows then find their group by hash and digest; that join carries no text, and a hot
group is split by the adaptive skew join.

Defined results: a null text counts as the empty text; an empty table gives an empty table; rows with a null id
belong to their group but are kept only when the group has no other id; rows repeated with their id are all
reported, each with the group's ``keep_id``, and all of them count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import ascii_lower, one_row_each


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row per text that occurs more than once: ``content_hash``, ``text_sha256``, ``group_size``, ``keep_id``."""
    best = {"min": F.min, "max": F.max}[keep]
    same = (docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("content"))
            .withColumn("content_hash", F.unhex(F.md5("content")))
            .groupBy("content_hash", "content").agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id")))
    return (same.filter("group_size > 1")
            .select("content_hash", F.sha2("content", 256).alias("text_sha256"), "group_size", "keep_id"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: its id, the id that stays for its text, the group's size, whether it is the one
    that stays, and the SHA-256 of the normalised text. ``keep`` is ``min`` (smallest id) or ``max``."""
    content = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("id"), F.unhex(F.md5(content)).alias("content_hash"),
                       F.sha2(content, 256).alias("text_sha256"))
    found = rows.join(groups(docs, key, text, keep), ["content_hash", "text_sha256"], "left")
    keep_id = F.coalesce("keep_id", "id")
    return found.select(F.col("id").alias(key), keep_id.alias("keep_id"),
                        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                        keep_id.eqNullSafe(F.col("id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row per text, the one with the smallest (or largest) id; all columns kept.

    Rows that repeat both id and text are one row first. Texts are shuffled by id and hash, so no group of copies
    meets in one task.
    """
    content = normalised(F.col(text))
    names = [F.col(key).alias("id"), F.unhex(F.md5(content)).alias("content_hash"), F.sha2(content, 256).alias("text_sha256")]
    once = one_row_each(docs, *names)
    dropped = assign(docs, key, text, keep).filter(~F.col("kept")).select(
        F.col(key).alias("id"), F.col("text_sha256")).distinct()
    return once.join(dropped, once["id"].eqNullSafe(dropped["id"]) & (once["text_sha256"] == dropped["text_sha256"]),
                     "left_anti").select("row.*")
