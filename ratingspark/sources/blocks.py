"""CSV records that span lines and JSON arrays, read from many blocks of one file at once.

Spark's own readers give a file of such records to one task, as a block cannot tell whether it starts inside a record. Here
the file is read as text pieces (lines, or what lies between closing braces), which Spark splits at will, in three steps:

1. every block sums up what it does to the reader's state, for any state that it may start in: for CSV how many quotes it
   holds, for JSON how many quotes, and how the bracket depth changes if it starts outside or inside a string;
2. these sums, one small row for each block, are put together in file order, which gives the state at every block's start;
3. every block is cut into records from its known state. Records inside a block are parsed where they are; what a block
   holds of a record that began before it, or goes on after it, is sent by its record and put together there.

The driver holds one row of numbers per block, up to ``MAX_BLOCKS`` (petabytes in usual blocks); files of more are left to Spark's reader. CSV is
RFC 4180: quotes only around whole fields, doubled inside them. JSON files hold one array of objects. Text is UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.sources.files import CSV_READ, read_csv, read_json

MAX_BLOCKS = 1_000_000
#: What a row of text is: a whole record, the end, the middle or the beginning of one.
WHOLE, END, MIDDLE, BEGIN = range(4)

Blocks = dict[tuple[str, int], tuple]
Cut = Callable[[tuple, bool, Iterator[str]], Iterator[tuple[int, str]]]

#: Possessive, so that a string's characters are taken in runs and an opening quote without a partner is given up at once.
_STRINGS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_QUOTES = re.compile(r'\\.|"', re.S)


def pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``file, start, value``: the pieces of all files in order, ``start`` that of the block they were read from."""
    text = spark.read.option("lineSep", sep).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    rows = ((f, s, v) for b in batches for f, s, v in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for block, mine in groupby(rows, key=lambda r: r[:2]):
        yield block, (r[2] for r in mine)


def summed_up(rows: DataFrame, does: Callable[[Iterator[str]], tuple]) -> DataFrame:
    """``file, start, does``: what each block does, an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), values in _in_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([does(values)], pa.list_(pa.int64()))],
                                             ["file", "start", "does"])

    return rows.mapInArrow(run, "file string, start long, does array<long>")


def states(blocks: list, first: tuple, after: Callable[[tuple, list], tuple], inside: Callable[[tuple], bool]) -> tuple[Blocks, set]:
    """The state at the start of every block, by file and position, and the blocks that start or end ``inside`` a record."""
    at: Blocks = {}
    torn = set()
    for _, rows in groupby(sorted(blocks, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        state, before = first, None
        for file, start, does in rows:
            at[file, start] = state
            if inside(state):
                torn |= {before, (file, start)}
            state, before = after(state, does), (file, start)
    return at, torn - {None}


def cut(rows: DataFrame, at: Blocks, records: Cut, only: set | None, kinds: tuple[int, ...]) -> DataFrame:
    """``file, start, kind, text`` of the given kinds, of all blocks or ``only`` some."""
    sent = rows.sparkSession.sparkContext.broadcast((at, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = sent.value
        for block, values in _in_blocks(batches):
            if some is not None and block not in some:
                continue
            found: list[tuple[int, str]] = []
            for kind, text in records(state[block], block[1] == 0, values):
                if kind in kinds:
                    found.append((kind, text))
                if len(found) >= 1000:
                    yield _batch(block, found)
                    found = []
            if found:
                yield _batch(block, found)

    return rows.mapInArrow(run, "file string, start long, kind int, text string")


def _batch(block: tuple[str, int], found: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(found)
    return pa.RecordBatch.from_arrays([pa.array([block[0]] * n), pa.array([block[1]] * n, pa.int64()), pa.array([k for k, _ in found], pa.int32()),
                                       pa.array([t for _, t in found], pa.string())], ["file", "start", "kind", "text"])


def stitched(parts: DataFrame, sep: str) -> DataFrame:
    """``text`` of the records that lie in several blocks: each begins with a BEGIN; MIDDLEs and the END follow in file order."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("record", F.count_if(F.col("kind") == BEGIN).over(order))
    whole = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("p"))
    return whole.select(F.array_join(F.transform("p", lambda x: x["text"]), sep).alias("text"))


def _records(rows: DataFrame, at: Blocks, torn: set, records: Cut, sep: str) -> DataFrame:
    whole = cut(rows, at, records, None, (WHOLE,)).select("text")
    return whole.unionByName(stitched(cut(rows, at, records, torn, (END, MIDDLE, BEGIN)), sep)) if torn else whole


# ---------------------------------------------------------------- CSV

def csv_does(values: Iterator[str]) -> tuple:
    return (sum(v.count('"') for v in values) % 2,)


def csv_records(state: tuple, first: bool, lines: Iterator[str]) -> Iterator[tuple[int, str]]:
    """The records of a block that starts inside quotes or not; the first one of a file is its header and goes."""
    kind, held, is_open, header = (END if state[0] else WHOLE), [], bool(state[0]), first
    for line in lines:
        held.append(line)
        if line.count('"') % 2:
            is_open = not is_open
        if not is_open:
            text, held = "\n".join(held), []
            if header:
                header = False
            elif text.rstrip("\r") or kind == END:
                yield kind, text.removesuffix("\r")
            kind = WHOLE
    if held:
        yield (MIDDLE if kind == END else BEGIN), "\n".join(held)


def read_csv_blocks(spark: SparkSession, path: str, schema: T.StructType, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of headed CSV files, as :func:`ratingspark.sources.files.read_csv` reads them, from all blocks at once.
    A file's header lies in its first block. Line ends inside values stay as they are, also in files whose records end
    in CR LF (Spark's reader makes them LF)."""
    rows = pieces(spark, path, "\n")
    sums = summed_up(rows, csv_does).limit(max_blocks + 1).collect()
    if len(sums) > max_blocks:
        return read_csv(spark, path, schema)
    at, torn = states(sums, (0,), lambda s, does: ((s[0] + does[0]) % 2,), lambda s: s[0] == 1)
    ddl = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json()).toDDL()
    parsed = F.from_csv("text", ddl, {k: v for k, v in CSV_READ.items() if k != "header"})
    return _records(rows, at, torn, csv_records, "\n").select(parsed.alias("r")).select("r.*")


# ---------------------------------------------------------------- JSON arrays

def _depth(piece: str, inside: bool) -> tuple[int, bool]:
    """How a piece changes the bracket depth, and whether it ends inside a string."""
    if '"' not in piece and "\\" not in piece:
        return (0 if inside else piece.count("{") + piece.count("[") - piece.count("]"), inside)
    rest = _STRINGS.sub("", '"' + piece if inside else piece)
    plain, mark, _ = rest.partition('"')  # an opening quote that is left has no partner in this piece
    return plain.count("{") + plain.count("[") - plain.count("]"), bool(mark)


def json_does(values: Iterator[str]) -> tuple:
    """Change of depth and string state (0 or 1) at the end, for a start outside and for one inside a string."""
    depth, inside = [0, 0], [False, True]
    for v in values:
        for i in (0, 1):
            change, inside[i] = _depth(v, inside[i])
            depth[i] += change - (not inside[i])  # the brace that ended the piece
    return depth[0], int(inside[0]), depth[1], int(inside[1])


def _in_object(state: tuple) -> bool:
    """Depth 1 is between the objects of the array, 0 before it."""
    return state[0] > 1 or bool(state[1])


def json_records(state: tuple, first: bool, values: Iterator[str]) -> Iterator[tuple[int, str]]:
    """The objects of a block whose start has this depth and string state."""
    depth, inside = state[0], bool(state[1])
    kind, held = (END if _in_object(state) else WHOLE), []
    for v in values:
        change, inside = _depth(v, inside)
        if kind == WHOLE and not held:
            start = v.find("{")
            if start < 0:  # the end of the array
                depth += change - 1
                continue
            v = v[start:]
        held.append(v)
        depth += change - (not inside)
        if depth == 1 and not inside:
            yield kind, "}".join(held) + "}"
            kind, held = WHOLE, []
    if held:
        yield (MIDDLE if kind == END else BEGIN), "}".join(held)


def read_json_blocks(spark: SparkSession, path: str, schema: T.StructType, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The objects of files that hold one JSON array each, as ``read_json(multiline=True)`` reads them, from all blocks at once."""
    rows = pieces(spark, path, "}")
    sums = summed_up(rows, json_does).limit(max_blocks + 1).collect()
    if len(sums) > max_blocks:
        return read_json(spark, path, schema, multiline=True)

    def after(state: tuple, does: list) -> tuple:
        i = 2 if state[1] else 0
        return state[0] + does[i], does[i + 1]

    at, torn = states(sums, (0, 0), after, _in_object)
    parsed = F.from_json("text", schema)
    return _records(rows, at, torn, json_records, "}").select(parsed.alias("r")).select("r.*")
