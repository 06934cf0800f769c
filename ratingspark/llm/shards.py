"""Contiguous shards of nearly equal size, from global prefix sums of byte sizes.

The rows are laid out in one total order by range partitioning. Each partition's total (one row per partition) gives
its offset in the order; a running sum inside the partition does the rest, so no task sees more than its partition.
Shards are cut where the running sum passes equal targets; a row goes where its middle byte falls.

Defined results: a null text has no bytes (size 1); null ids come first; rows that repeat an id are ordered by
their text's hash, and full repeats are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import stored


def ordered_sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Narrow rows (id, size, text_crc32, part, place) in global order; written once, as several passes read them."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("tie"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie")
    return stored(spread.select("id", "size", "text_crc32", F.spark_partition_id().alias("part"),
                                F.monotonically_increasing_id().alias("place")), "shard-order")


def assign(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (bytes of the text plus 1), ``text_crc32``, shard and slot.

    Shards are runs of the global order (by id); ``slot`` counts 0, 1, 2, ... inside a shard in that order.
    """
    rows = ordered_sizes(docs, key, text)
    # One row per partition: the offsets of bytes and rows before it, and the grand total.
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
                           F.sum("part_size").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("place")
    placed = (rows.select("*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
                          (F.row_number().over(inside) - 1).alias("nth"))
              .join(F.broadcast(offsets), "part")
              .select("id", "size", "text_crc32", (F.col("rows_before") + F.col("nth")).alias("row"),
                      F.expr(f"(2 * (bytes_before + at) + size) * {n_shards} div (2 * total)").cast("int").alias("shard")))
    placed = stored(placed, "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    # ``first`` has at most ``n_shards`` rows.
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
