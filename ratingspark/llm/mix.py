"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, a polyline of (time, weight) knots. Its integral is the
source's weight; the integral up to a time is its token demand until then. Targets share the budget by weight, but no
source goes beyond ``max_epochs`` passes: the excess is reshared by weight among the others until none is above. A
document's n-th pass starts at some cumulated token of its source; inverting the demand there gives its training
position, and documents are range-sorted by it.

Cumulated tokens come from sums per (source, cell), where a cell is a range of the source's order: no task gathers a
source, however large. The order is a hash of the id, then one of the text; cells are as many as give ``CELL`` rows each.
A cell that still holds over a ``HOT``-th of all rows (rows without ids, a repeated id) is cut by the text's hash, and by the
stored part it lies in where the texts agree as well. The tables of sources and of cells are small (a cell is some hundred
rows) and joined as Spark sees fit by their measured size.

Defined results: a null text has no words; a null source is a source like any other, the last; a document without
words takes nothing; equal ids are told apart by a hash of their text, and full repeats take their turns in some
order; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import SPACE, stored

#: Rows that a cell is meant to hold, and the share of all rows, one in so many, beyond which a cell is cut again.
CELL, HOT = 512, 1000
#: What tells a cell from the others; cells of a source follow each other in this order.
CELLS = ["s", "bucket", "fine", "part"]
#: Curricula dealt to the sources in turn: fading out, growing, and level. Each integrates to 1.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))


def word_count(text: Column) -> Column:
    """Words of the text: where a word begins, a non-space follows the start or a space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def schedules(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), curves=CURVES) -> DataFrame:
    """``sources`` (source, source_size) with ``knots``: array of (at, weight), dealt by code-point order, null last.

    One row per source; the rank runs over that small table only.
    """
    # A string's bytes in UTF-8 order as its code points do.
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    shapes = F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("at"), F.lit(float(h)).alias("weight")) for t, h in c))
                       for c in curves))
    curve = F.element_at(shapes, (F.col("rank") % len(curves) + 1).cast("int"))
    return sources.withColumn("rank", rank).select(
        "source", "source_size",
        F.transform(curve, lambda k: F.struct(k["at"].alias("at"), (k["weight"] * weight).alias("weight"))).alias("knots"))


def _pieces(knots: Column) -> Column:
    """Segments of the polyline with the integral before each: (at, span, w0, w1, before, area)."""
    def step(acc, i):
        a, b = F.get(knots, i), F.get(knots, i + 1)
        span = b["at"] - a["at"]
        area = span * (a["weight"] + b["weight"]) / 2
        piece = F.struct(a["at"].alias("at"), span.alias("span"), a["weight"].alias("w0"), b["weight"].alias("w1"),
                         acc["sum"].alias("before"), area.alias("area"))
        return F.struct((acc["sum"] + area).alias("sum"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"))

    kind = "struct<sum:double,pieces:array<struct<at:double,span:double,w0:double,w1:double,before:double,area:double>>>"
    start = F.struct(F.lit(0.0).alias("sum"), F.array().alias("pieces")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.size(knots) - 2), start, lambda acc, i: step(acc, i).cast(kind))


def invert(pieces: Column, demand: Column) -> Column:
    """The time at which the integral reaches ``demand``: a quadratic in the one segment that contains it."""
    def within(p):
        left = demand - p["before"]
        slope = (p["w1"] - p["w0"]) / p["span"]
        # w0 x + slope x^2 / 2 = left, in the form that stays exact for a level segment.
        root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * left, F.lit(0.0)))
        return p["at"] + F.least(p["span"], F.when(p["w0"] + root > 0, 2 * left / (p["w0"] + root)).otherwise(F.lit(0.0)))

    inside = F.filter(pieces, lambda p: (p["area"] > 0) & (p["before"] + p["area"] >= demand))
    return F.coalesce(F.get(F.transform(inside, within), 0), F.lit(1.0))


def targets(planned: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target``: the budget (all words) shared by weight, none above ``max_epochs`` times its size.

    Sources in order of size per weight fill first; a source is capped while its cap lies below the level that the
    budget left for it and all later ones allows.
    """
    w = F.col("weight")
    cap = F.col("source_size") * float(max_epochs)
    order = Window.orderBy(F.col("source_size") / w, F.col("source").isNull(), "source")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / (
        F.sum(w).over(every) - F.coalesce(F.sum(w).over(earlier), F.lit(0.0)))
    levelled = (planned.withColumn("level", level).withColumn("capped", cap <= level * w)
                .withColumn("turn", F.row_number().over(order)))
    # The level stands still once no source is capped any more: the first uncapped source has the final one.
    final = F.min(F.when(~F.col("capped"), F.struct("turn", "level"))).over(every)["level"]
    return (levelled.withColumn("final", final)
            .withColumn("target", F.when(F.col("capped"), cap).otherwise(F.col("final") * w))
            .drop("level", "capped", "turn", "final"))


def _rows(docs: DataFrame, key: str, text: str, source: str, seed: int, *more: Column) -> DataFrame:
    """The stored rows (id, source, size, hash, tie, ...) with the cells they lie in."""
    t = F.coalesce(F.col(text), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    # ``s`` is the source with a mark before it, so that null (no mark) is a plain value to group and join by.
    rows = stored(docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), word_count(t).alias("size"), order.alias("hash"),
        F.xxhash64(t).alias("tie"), F.spark_partition_id().alias("at"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("s"), *more), "mix-rows")
    return _in_cells(rows, rows.count())


def _digits(n: int) -> int:
    """Hex digits of a hash that tell ``n`` rows into cells of at most ``CELL`` on average."""
    digits = 1
    while digits < 15 and n > CELL * 16 ** digits:
        digits += 1
    return digits


def _in_cells(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``bucket``, the start of the hash, and, in hot cells only, ``fine`` and ``part``. Hot cells are under ``HOT``
    by arithmetic, and broadcast."""
    digits = _digits(n)
    levels = (("fine", F.struct(F.col("hash").alias("hash"), F.shiftright("tie", 64 - 4 * digits).alias("tie")),
               F.struct(F.lit("").alias("hash"), F.lit(0).cast("long").alias("tie"))),
              ("part", F.struct("tie", "at"), F.struct(F.lit(0).cast("long").alias("tie"), F.lit(0).alias("at"))))
    cut, keys = rows.withColumn("bucket", F.substring("hash", 1, digits)), ["s", "bucket"]
    for name, inside, outside in levels:
        sums = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        hot = sums.filter(F.col("n") > max(CELL, n / HOT)).select(*keys, F.lit(True).alias("hot"))
        cut = (cut.join(F.broadcast(hot), keys, "left")
               .withColumn(name, F.when(F.col("hot"), inside).otherwise(outside)).drop("hot"))
        keys.append(name)
    return cut


def _place(rows: DataFrame, cells: DataFrame, weights, curves, max_epochs: int, whole: bool) -> DataFrame:
    """``rows`` with their source's plan, ``passes`` (array of (n, words)) and ``positions``.

    cells: ``CELLS`` and cell_size, the sizes of all rows; rows are shuffled once, by cell.
    """
    sums = Window.partitionBy("s").orderBy(*CELLS[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*CELLS, F.coalesce(F.sum("cell_size").over(sums), F.lit(0)).alias("cell_before"))
    sources = cells.groupBy("s").agg(F.sum("cell_size").alias("source_size")).withColumn(
        "source", F.when(F.col("s") != "", F.expr("substring(s, 2)")))
    planned = schedules(sources, weights, curves).withColumn("p", _pieces(F.col("knots")))
    plan = targets(planned.select("source", "source_size", F.col("p.pieces").alias("pieces"),
                                  F.col("p.sum").alias("weight")), max_epochs)
    plan = plan.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")

    inside = Window.partitionBy(*CELLS).orderBy("hash", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, CELLS).join(plan, "s")
              .withColumn("start", F.col("cell_before") + F.col("in_cell")))
    size, goal, total = F.col("size"), F.round("target").cast("long"), F.col("source_size")

    def begin(n: Column) -> Column:
        return F.col("start") + n * total

    def words(n: Column) -> Column:
        if whole:
            return F.when(2 * begin(n) + size <= 2 * goal, size).otherwise(F.lit(0))
        return F.least(F.greatest(goal - begin(n), F.lit(0)), size)

    turns = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    passes = F.filter(F.transform(turns, lambda n: F.struct(n.alias("n"), words(n).alias("words"))), lambda x: x["words"] > 0)
    return placed.withColumn("passes", passes).withColumn("positions", F.transform(
        "passes", lambda x: invert(F.col("pieces"), begin(x["n"]) / F.col("target") * F.col("weight"))))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELLS).agg(F.sum("size").alias("cell_size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
        weights: Sequence[float] = (1, 2, 3), curves=CURVES, max_epochs: int = 3, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``, sorted by training position: id, ``size``, ``source``, ``source_size``,
    ``target``, ``taken`` (words, repeats counted), ``passes`` (times it is seen) and ``positions``, one per pass.

    A source's documents, in hash order, are passed over again and again until its target is reached; the last
    one is cut there, or with ``whole`` seen whole if at least half of it lies before the target.
    """
    rows = _rows(docs, key, text, source, seed)
    placed = _place(rows, _cells(rows), weights, curves, max_epochs, whole)
    return placed.select(
        F.col("id").alias(key), "size", "source", "source_size", "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]).alias("taken"),
        F.size("passes").alias("passes"), "positions").orderBy(F.get("positions", 0), key)


def ordered(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
            weights: Sequence[float] = (1, 2, 3), curves=CURVES, max_epochs: int = 3, with_position: bool = False) -> DataFrame:
    """The mix itself: whole documents in training order, a document once for each pass that it is seen in; all
    columns kept. Documents outside their source's target, or without words, are not in it. ``with_position`` adds
    ``mix_position`` (0 to 1, the order) and ``mix_pass`` (from 0), which outlive any later shuffle."""
    rows = _rows(docs, key, text, source, seed, F.struct("*").alias("row"))
    placed = _place(rows, _cells(rows), weights, curves, max_epochs, whole=True)
    seen = placed.select("row", "id", "tie", "passes", F.posexplode("positions").alias("nth", "position"))
    more = [F.col("position").alias("mix_position"), F.get("passes", F.col("nth"))["n"].alias("mix_pass")] if with_position else []
    return seen.orderBy("position", "id", "tie").select("row.*", *more)
