"""A keyed, append-only table with atomic appends and a key index (ST1, J1).

``sink/_part=<id>/`` holds the rows of one append, ``sink/_index/_part=<id>/`` the index of its keys, and
``sink/_manifests/<version>.json`` says that the part belongs to the table. A manifest appears by one rename that fails if the
version exists, after rows and index are complete: a writer killed before it leaves files that no reader looks at, and of
two writers one gets the version. The other one then looks at what was committed meanwhile, drops the keys it holds from
its own rows, and tries the next version, so no key is lost and none is written twice. Every ``SUMMARY``-th manifest
lists all parts, so a reader opens at most that many.

The index is a Bloom filter per part, cut by key hash into pieces of at most ``KEYS`` keys (32 bits a key, one false alarm in some
10^6 lookups). A batch joins its keys to the pieces they would lie in and reads only the parts that may hold one of
them; the exact anti-join follows. Index and rows are Spark tables: nothing but names of parts comes to the driver.

The rename must be atomic and must not replace a file: HDFS and local folders are such; object stores need a committer of their own.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, SUMMARY = "_part", 32
KEYS, WORDS, HASHES = 256, 128, 3
#: Positions taken from one 64-bit hash, each of as many bits as number the bits of a piece.
EACH, BITS = 4, 13


class Part(NamedTuple):
    name: str
    rows: int
    shards: int


class Log:
    """The manifests of one sink."""

    def __init__(self, spark: SparkSession, sink: str):
        self.spark, self.sink = spark, sink.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.folder = f"{self.sink}/_manifests"
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.sink).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _names(self) -> dict[int, str]:
        folder = self._path(self.folder)
        if not self.fs.exists(folder):
            return {}
        found = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return {int(n.split(".")[0]): n for n in found if n.endswith(".json") and not n.startswith((".", "_"))}

    def _load(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        return max(self._names(), default=0)

    def parts(self, after: int = 0, upto: int | None = None) -> list[Part]:
        """The parts committed by the versions after ``after``, up to ``upto`` or the last one."""
        names = {v: n for v, n in self._names().items() if upto is None or v <= upto}
        start = max((v for v, n in names.items() if ".all." in n), default=0) if after == 0 else 0
        out = [Part(*p) for p in self._load(names[start])["all"]] if start else []
        return out + [Part(*self._load(names[v])["part"]) for v in sorted(names) if v > max(start, after)]

    def commit(self, version: int, part: Part) -> bool:
        """Makes ``part`` version ``version`` of the table; False if another writer has taken that version."""
        whole = version % SUMMARY == 0
        content = {"part": part} | ({"all": [*self.parts(upto=version - 1), part]} if whole else {})
        tmp = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            return self._renamed(tmp, self._path(f"{self.folder}/{version:010d}{'.all' if whole else ''}.json"))
        finally:
            self.fs.delete(tmp, False)

    def _renamed(self, tmp, target) -> bool:
        if self.fs.getUri().getScheme() == "file":  # a link is the local rename that does not replace
            try:
                os.link(tmp.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        from py4j.protocol import Py4JJavaError

        hadoop = self.jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(tmp, target, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def folder_of(self, name: str, index: bool = False) -> str:
        return f"{self.sink}/{'_index/' if index else ''}{PART}={name}"

    def read(self, parts: list[Part], index: bool = False) -> DataFrame:
        """The rows (or index pieces) of these parts."""
        base = f"{self.sink}/_index" if index else self.sink
        return self.spark.read.option("basePath", base).parquet(*[self.folder_of(p.name, index) for p in parts])

    def drop(self, name: str) -> None:
        """Removes a part of this writer's own that was never committed."""
        for index in (False, True):
            self.fs.delete(self._path(self.folder_of(name, index)), True)


def committed(spark: SparkSession, sink: str) -> DataFrame | None:
    """All committed rows, or None while nothing has been written."""
    log = Log(spark, sink)
    parts = log.parts()
    return log.read(parts) if parts else None


# ---------------------------------------------------------------- key index

def _hash(key: Column, i: int) -> Column:
    return F.xxhash64(key, F.lit(i))


def _positions(key: Column) -> Column:
    """The bits of a key within its piece."""
    return F.array(*[F.shiftrightunsigned(_hash(key, i + 1), BITS * j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
                     for i in range(HASHES) for j in range(EACH)])


def _shard(key: Column, shards: Column) -> Column:
    return F.pmod(_hash(key, 0), shards.cast("long"))


def pieces(keys: DataFrame, key: str, shards: int) -> DataFrame:
    """``shards, shard, words``: the Bloom filter of the keys, one row for each piece that has any."""
    bits = keys.select(_shard(F.col(key), F.lit(shards)).alias("shard"), F.explode(F.array_distinct(_positions(F.col(key)))).alias("at"))
    words = bits.groupBy("shard", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    return (words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
            .select(F.lit(shards).alias("shards"), "shard", filled.alias("words")))


def shards_for(rows: int) -> int:
    """Pieces of a part: a power of two, so that parts of all sizes have few different ones."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / KEYS)))


def may_hold(log: Log, parts: list[Part], keys: DataFrame, key: str) -> list[Part]:
    """Those of the parts whose index does not rule out every one of the keys."""
    if not parts:
        return []
    sizes = sorted({p.shards for p in parts})
    asked = keys.select(F.col(key).alias("k")).distinct().select("k", F.explode(F.array(*map(F.lit, sizes))).alias("shards"))
    asked = asked.select("shards", _shard(F.col("k"), F.col("shards")).alias("shard"), _positions(F.col("k")).alias("at"))
    mask = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)))
    set_bit = lambda p: F.get(F.col("words"), F.shiftright(p, 6)).bitwiseAND(mask(p)) != 0
    found = log.read(parts, index=True).join(asked, ["shards", "shard"]).filter(F.forall("at", set_bit)).select(PART).distinct()
    names = {r[0] for r in found.collect()}  # at most the number of parts
    return [p for p in parts if p.name in names]


# ---------------------------------------------------------------- finished keys, append

def finished(log: Log, parts: list[Part], keys: DataFrame, key: str, error_col: str | None = None) -> DataFrame | None:
    """Keys of those parts that may hold any of ``keys`` (with ``error_col``: of rows without an error); None if no part may."""
    hit = may_hold(log, parts, keys, key)
    if not hit:
        return None
    rows = log.read(hit)
    return (rows.where(F.col(error_col).isNull()) if error_col else rows).select(key).distinct()


def append(rows: DataFrame, sink: str, key: str, since: int | None = None, error_col: str | None = None) -> Part | None:
    """Adds ``rows`` as one part, in one atomic step; returns it, or None if no row was left to add.

    ``since`` is the version that the caller compared its rows with. Keys committed by others after it (with
    ``error_col``: without an error) are dropped from the part before it is committed.
    """
    spark = rows.sparkSession
    log = Log(spark, sink)
    since = log.version() if since is None else since
    name = f"p{uuid.uuid4().hex[:16]}"
    rows.write.parquet(log.folder_of(name))
    while True:
        mine = spark.read.schema(rows.schema).parquet(log.folder_of(name))
        newest = log.version()
        taken = finished(log, log.parts(after=since, upto=newest), mine.select(key), key, error_col) if newest > since else None
        if taken is not None and not mine.join(taken, key, "left_semi").isEmpty():
            again = f"p{uuid.uuid4().hex[:16]}"
            mine.join(taken, key, "left_anti").select(*rows.columns).write.parquet(log.folder_of(again))
            log.drop(name)
            name, since = again, newest
            continue
        n = mine.count()
        if not n:
            log.drop(name)
            return None
        part = Part(name, n, shards_for(n))
        pieces(mine.select(key), key, part.shards).write.mode("overwrite").parquet(log.folder_of(name, index=True))
        if log.commit(newest + 1, part):
            return part
        since = newest
