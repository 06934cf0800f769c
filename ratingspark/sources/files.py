"""File sources and sinks: headed CSV, JSON, text, parquet, media listings.

Parquet is the format between stages; CSV and JSON sit at the edges. Every reader
takes an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# CSV dialect of Python's csv module: double-quote escaping, records may span lines.
CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, UTF-8, non-ASCII kept as is."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Files of one JSON array each, a record per line, as many as ``df`` has partitions."""
    def run(batches):
        before = "["
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{before if i == 0 else ','}{v}" for i, v in enumerate(b.column(0).to_pylist())],
                                                       pa.string())], ["value"])
            before = "," if b.num_rows else before
        yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON Lines, or (``multiline``) files holding one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Append sink: a new part file per write, no header bookkeeping needed."""
    df.write.mode("append").parquet(path)


def write_text(df: DataFrame, path: str, col: str = "transcript", mode: str = "overwrite") -> None:
    df.select(F.coalesce(F.col(col), F.lit("")).alias("value")).write.mode(mode).text(path)


def write_documents(df: DataFrame, path: str, key: str, col: str = "transcript", mode: str = "overwrite") -> None:
    """One record per document (a JSON line of key and whole text), so line breaks stay inside their document."""
    df.select(key, F.coalesce(F.col(col), F.lit("")).alias("text")).write.mode(mode).json(path)


def read_documents(spark: SparkSession, path: str, key: str, col: str = "transcript") -> DataFrame:
    """``key`` is the key column's name and type, e.g. ``doc_id long``."""
    name = key.split()[0]
    return spark.read.schema(f"{key}, text string").json(path).select(name, F.col("text").alias(col))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path of a folder that all tasks reach as a folder of their own system (``file:``), None for one in another store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(at).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _tasks(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_media(names: DataFrame, folder: str, col: str = "media") -> None:
    """A folder ``<col>=<name>`` with one file for each of the distinct ``names`` (null and empty ones share a folder). Making a file takes far longer than moving its
    name, so the names are dealt over all cores by a hash: left to themselves, few bytes would end in one task.

    In a mounted folder the tasks make the files by plain system calls, under the names that Spark's writer gives: that writer starts a process for each mode it sets (four
    or more a name), and its commit moves all folders one by one on the driver. A file gets its name when it is whole, and a task that runs again makes the same files."""
    spark = names.sparkSession
    dealt = names.select(F.col(col).cast("string").alias(col), F.lit("x").alias("value")).repartition(_tasks(spark), F.xxhash64(F.nullif(col, F.lit(""))))
    at = mounted(spark, folder)
    if at is None:
        dealt.write.partitionBy(col).text(folder)
        return
    os.makedirs(at)
    job = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, n = f"part-{task.partitionId():05d}-{job}.c000.txt", 0
        for name, rows in groupby(x for b in batches for x in b.column(0).to_pylist()):
            own = f"{at}/{col}={NO_NAME if name is None else _UNSAFE_IN_FOLDER.sub(lambda m: f'%{ord(m[0]):02X}', name)}"
            with contextlib.suppress(FileExistsError):
                os.mkdir(own)
            with open(f"{own}/.{part}-{task.taskAttemptId()}", "wb") as f:
                f.writelines(b"x\n" for _ in rows)
            os.replace(f.name, f"{own}/{part}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    named = dealt.select(F.nullif(col, F.lit("")).alias(col)).sortWithinPartitions(col)
    named.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    open(f"{at}/_SUCCESS", "wb").close()


#: Folders up to this many are looked through on the driver; beyond, tasks share them.
LOOKED_THROUGH = 32
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Characters that Spark's writer gives as %XX in the folder of a value.
_UNSAFE_IN_FOLDER = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _entries(folder: bytes) -> Iterator[os.DirEntry]:
    """What Spark's listing sees in a folder; a folder that is gone is an error, never an empty one."""
    with os.scandir(folder) as found:
        for e in found:
            if (e.name.startswith((b"_common_metadata", b"_metadata")) and e.is_dir()
                    or not (e.name.startswith(b".") or e.name.startswith(b"_") and b"=" not in e.name or e.name.endswith(b"._COPYING_"))):
                yield e


def _tops(root: bytes) -> list[tuple[bytes, bool]]:
    """Folders that hold the tree ``root`` between them, and whether with all that is below: as many as are found first in going down, over
    ``LOOKED_THROUGH`` being below them."""
    own, whole = [], [root]
    while True:
        below = list(islice((e.path for d in whole for e in _entries(d) if e.is_dir()), LOOKED_THROUGH + 1))
        if not 0 < len(below) <= LOOKED_THROUGH:
            return [(d, False) for d in own] + [(d, True) for d in whole]
        own, whole = own + whole, below


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _length(e: os.DirEntry) -> int:
    """0 also for a file that is gone, or a link to nothing."""
    try:
        return e.stat().st_size
    except FileNotFoundError:
        return 0


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of all files that are not empty in a mounted folder, listed by the tasks; the driver holds no list of them."""

    def one_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((e.path, None if e.is_dir() else _length(e)) for b in batches for d, whole in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for e in _entries(d) if whole or not e.is_dir())
        yield from _in_batches(rows, pa.schema([("path", pa.binary()), ("length", pa.int64())]))

    def files(folder: bytes) -> Iterator[tuple[bytes, int]]:
        below = [folder]
        while below:
            for e in _entries(below.pop()):
                if e.is_dir():
                    below.append(e.path)
                else:
                    yield e.path, _length(e)

    def all_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p.decode("utf-8", "replace"), n) for b in batches for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for p, n in (files(path) if length is None else [(path, length)]))
        yield from _in_batches(rows, pa.schema([("path", pa.string()), ("length", pa.int64())]))

    tops = spark.createDataFrame([(bytearray(d), whole) for d, whole in _tops(os.fsencode(root))], "folder binary, whole boolean")
    level = tops.mapInArrow(one_level, "path binary, length long")
    return level.repartition(_tasks(spark), F.xxhash64("path")).mapInArrow(all_below, "path string, length long").where("length > 0")


def list_media(spark: SparkSession, folder: str, glob: str = "*.mp4", recursive: bool = True,
               name_pattern: str = r"([^/]*)$") -> DataFrame:
    """``path, name, length`` of media files; ``name`` is the first group of ``name_pattern`` in the path. Only metadata
    is read: file bodies never leave storage. A mounted folder is listed by the tasks, with the rows that Spark's reader of files gives (no empty and no hidden files);
    that reader would list with a task a folder, hold all files on the driver and read few of them a task. Other stores are left to it, the content column pruned away."""
    at = mounted(spark, folder) if recursive and not re.search(r"[{}\[\]*?\\]", folder) else None
    if at and os.path.isdir(at):
        named_so = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        df = _listed(spark, at).where(F.regexp_extract("path", r"([^/]*)\z", 1).rlike(rf"\A(?s:{named_so})\z")).withColumn("path", F.concat(F.lit("file:"), "path"))
    else:
        df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
              .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    return df.select("path", F.regexp_extract("path", name_pattern, 1).alias("name"), "length")
