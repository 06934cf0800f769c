"""Removal of byte strings that occur more than once in a corpus, by refining the interleave of sampled suffixes.

Merging Burrows-Wheeler transforms interleaves the sorted suffixes of the shards: each round knows which suffixes agree
in a longer prefix, an interval of the interleave, and a suffix alone in its interval is settled. Here the same is done
for a content-defined sample of the suffixes, and intervals are named by hashes of their common prefix, so a round
is one count per interval over all shards, and no suffix is ever sorted again.

* A suffix is sampled where the hash of 16 bytes is the least among ``SAMPLED`` neighbouring starts. Every start of a
  ``length``-byte window has one such anchor at ``offset`` 0..SAMPLED-1 after it, fixed by the window's own bytes, so
  equal windows have their anchors at equal offsets.
* Round 0 drops every anchor whose shortest needed prefix (common to the windows of all its offsets) is unique.
* Each later round takes ranges of offsets, four times narrower than before. The bytes common to all windows of a range
  are its interval; the bytes that any of them covers (prefix, and what precedes the suffix: its BWT context)
  are its hull. A unique interval settles the range: none of its windows repeats. A repeated hull settles it too: all of
  them do. What is left is split, and of a settled group one witness goes on while others still need a partner.
* At width 1 interval and hull are the window itself, so the answer is exact, up to collisions of polynomial hashes
  modulo a prime at four random points (124 bits): no structure of the bytes makes two strings agree.

Equal texts are one row with a count (of 2 at least when copied), so groups of copies cost nothing. The distinct
texts are written once, bucketed by their hash: the rounds join them without shuffling text. Counts are pre-aggregated,
joins are left to the adaptive skew split, and long texts are hashed piece by piece.

Defined results: a null text is empty; texts shorter than ``length`` have nothing to remove unless part of
a repeat, which they cannot be; null or repeated ids do no harm, every row of the table is a document of its own; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import stored
from ratingspark.session import scratch_path

GRAM, SAMPLED, FAN, PIECE = 16, 256, 4, 1 << 20
#: Rows of one interval beyond this share of all, one in so many, are not given to one task.
HOT = 1000
PRIME = np.uint64((1 << 31) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """A number with the same remainder modulo ``PRIME``, 31 bits shorter (2^31 is 1 modulo ``PRIME``)."""
    return (x & PRIME) + (x >> np.uint64(31))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any substring of a text in constant time: polynomials modulo the prime 2^31 - 1 at four random points, two to a
    hash of 62 bits. Two different strings of n bytes agree at a point with a probability under n / 2^31, whatever they hold."""

    points = [int(x) for x in np.random.default_rng(20).integers(1 << 20, (1 << 31) - 1, 4)]
    _powers: tuple = ()

    def __init__(self, data: np.ndarray):
        self.symbols = data.astype(np.uint64) + np.uint64(1)
        self.up, self.down = self.powers(len(data) + 1)
        self.sums: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, n: int):
        """Powers of the points and of their inverses, kept for texts to come."""
        if not cls._powers or len(cls._powers[0][0]) < n:
            size, both = max(n, 1 << 17), []
            for points in (cls.points, [pow(x, -1, int(PRIME)) for x in cls.points]):
                both.append([])
                for x in points:
                    p = np.ones(1, np.uint64)
                    while len(p) < size:
                        p = np.concatenate([p, _fold(_fold(p * np.uint64(pow(x, len(p), int(PRIME))))) % PRIME])
                    both[-1].append(p[:size].astype(np.uint32))
            cls._powers = tuple(both)
        return cls._powers

    def _at(self, j: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if j not in self.sums:  # symbols below 2^9 by powers below 2^31: sums of 2^23 bytes stay below 2^63
            self.sums[j] = np.zeros(len(self.symbols) + 1, np.uint64)
            np.cumsum(self.symbols * self.up[j][:len(self.symbols)], out=self.sums[j][1:])
        x = _fold(self.sums[j][end] - self.sums[j][start]) * self.down[j][start]
        x = _fold(_fold(_fold(x)))
        return np.where(x >= PRIME, x - PRIME, x)

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        return _mix(self._at(2 * k, start, end) << np.uint64(31) | self._at(2 * k + 1, start, end))


def _grams(data: np.ndarray) -> np.ndarray:
    """A number for the ``GRAM`` bytes from each place, which only orders the places: that some grams share one does no harm."""
    x = data.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] | x[n:] << np.uint64(8 * n)
    return _mix(_mix(x[:-8]) * np.uint64(3) + x[8:])


def _pieces(n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first start, end of starts, first byte, end of bytes) of the pieces in which a text of n bytes is hashed."""
    for first in range(0, max(1, n - length + 1), PIECE):
        end = min(first + PIECE, n - length + 1)
        yield first, end, max(0, first - SAMPLED), min(n, end + length + 2 * SAMPLED)


def anchors(data: np.ndarray, length: int):
    """(anchor, least offset, greatest offset, interval hash) of a text's sampled suffixes; together their offsets
    cover every start of a ``length``-byte window once. An anchor shared by two pieces is one row."""
    found = list(_piece_anchors(data, length))
    if not found:
        return None
    anchor, low, high, core = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.append(True, anchor[1:] != anchor[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(anchor)) - 1
    return anchor[new], low[last], high[new], core[new]


def _piece_anchors(data: np.ndarray, length: int):
    n = len(data)
    if n < length:
        return
    for first, end, lo, hi in _pieces(n, length):
        roll = Rolling(data[lo:hi])
        at = np.arange(first - lo, end - lo + SAMPLED - 1)
        gram = _grams(data[lo:hi])[at]
        key = (gram & ~np.uint64((1 << 22) - 1)) | (at - at[0]).astype(np.uint64)
        blocks = np.pad(key, (0, -len(key) % SAMPLED), constant_values=np.uint64((1 << 64) - 1)).reshape(-1, SAMPLED)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = end - first
        least = np.minimum(after[:starts], before[SAMPLED - 1:SAMPLED - 1 + starts])
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        anchor, where = np.unique(place, return_index=True)
        last = np.append(where[1:], starts) - 1
        near = anchor + first - lo
        yield (anchor + first, (anchor - last).astype(np.int32), (anchor - where).astype(np.int32),
               roll.of(near, near + length - SAMPLED + 1))


def ranges(data: np.ndarray, nodes: np.ndarray, width: int, fan: int, length: int):
    """Hashes of ranges of offsets. nodes: rows (anchor, first offset of the range, least and greatest own offset);
    each range is split into ``fan`` of ``width``; yields (nodes, interval hash, two hull hashes) by piece."""
    n = len(data)
    if fan > 1:
        split = np.repeat(nodes, fan, axis=0)
        split[:, 1] += np.tile(np.arange(fan) * width, len(nodes))
        split = split[(split[:, 2] <= split[:, 1] + width - 1) & (split[:, 3] >= split[:, 1])]
        nodes = split
    whole = n <= 4 * PIECE
    piece = np.zeros(len(nodes), np.int64) if whole else nodes[:, 0] // PIECE
    for p in np.unique(piece):
        own = nodes[piece == p]
        lo, hi = (0, n) if whole else (max(0, p * PIECE - SAMPLED), min(n, (p + 1) * PIECE + length + SAMPLED))
        roll = Rolling(data[lo:hi])
        a, x = own[:, 0], own[:, 1]
        y = x + width - 1
        start, end = np.maximum(a - y, 0), np.minimum(a - x + length, n)
        tail = (end - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)  # where the anchor lies in the hull
        yield (own, roll.of(a - x - lo, a - y + length - lo),
               roll.of(start - lo, end - lo) ^ tail, roll.of(start - lo, end - lo, 1) + tail)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows as sorted, disjoint, non-adjacent rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.column_stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]])


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer() or b"", np.uint8)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """Distinct texts (h, text, copies), bucketed by h: joins on h need no shuffle of the text side."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    name = f"texts_{uuid.uuid4().hex}"
    (docs.select(_name(body).alias("h"), body.alias("text")).groupBy("h")
     .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).repartition(n, "h")
     .write.bucketBy(n, "h").sortBy("h").option("path", scratch_path(spark, "repeat-texts")).saveAsTable(name))
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are the job's, and ``found`` knows them and their buckets
    return found


def _name(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                if (got := anchors(_bytes(b.column(1)[i]), length)) is None:
                    continue
                a, low, high, core = got
                weight = np.full(len(a), min(2, b.column(2)[i].as_py()))
                for column, x in zip(found, (np.full(len(a), i), weight, a, low, high, core.view(np.int64)), strict=True):
                    column.append(x)
            if found[0]:
                row, weight, *rest = (np.concatenate(c) for c in found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(weight.astype(np.int32)), *map(pa.array, rest)],
                                                 ["h", "weight", "a", "low", "high", "core"])

    return texts.select("h", "text", "copies").mapInArrow(run, "h binary, weight int, a long, low int, high int, core long")


def _range_rows(texts: DataFrame, nodes: DataFrame, width: int, fan: int, length: int) -> DataFrame:
    """nodes: (h, weight, a, x, low, high) to their ranges of ``width`` with hashes: (..., core, hull1, hull2)."""
    packed = nodes.groupBy("h").agg(F.first("weight").alias("weight"), F.collect_list("a").alias("a"), F.collect_list("x").alias("x"),
                                    F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[] for _ in range(9)]
            for i in range(b.num_rows):
                own = np.column_stack([np.array(b.column(c)[i].values, dtype=np.int64) for c in (3, 4, 5, 6)])
                for part, core, u1, u2 in ranges(_bytes(b.column(1)[i]), own, width, fan, length):
                    n = len(part)
                    cols = (np.full(n, i), np.full(n, b.column(2)[i].as_py(), np.int32), part[:, 0], part[:, 1].astype(np.int32),
                            part[:, 2].astype(np.int32), part[:, 3].astype(np.int32), *(v.view(np.int64) for v in (core, u1, u2)))
                    for column, x in zip(found, cols, strict=True):
                        column.append(x)
            if found[0]:
                row, *rest = (np.concatenate(c) for c in found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, rest)],
                                                 ["h", "weight", "a", "x", "low", "high", "core", "hull1", "hull2"])

    return (texts.select("h", "text").join(packed, "h").select("h", "text", "weight", "a", "x", "low", "high")
            .mapInArrow(run, "h binary, weight int, a long, x int, low int, high int, core long, hull1 long, hull2 long"))


def _shared(sampled: DataFrame) -> DataFrame:
    """The stored anchors whose interval is another's too. Anchors of an interval with over a ``HOT``-th of all rows, which are under
    ``HOT`` intervals by arithmetic, are told from their broadcast names and not shuffled."""
    sums = stored(sampled.groupBy("core").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("anchors")).filter("n > 1"), "repeat-shared")
    hot = F.broadcast(sums.filter(F.col("anchors") > sampled.count() / HOT).select("core"))
    rest = sampled.join(hot, "core", "left_anti").join(sums.select("core"), "core", "left_semi")
    return rest.unionByName(sampled.join(hot, "core", "left_semi"))


def _with_totals(hulls: DataFrame) -> DataFrame:
    """``hulls`` of intervals with more than one suffix, with ``open``, the number of the interval's hulls with one suffix.

    An interval may hold any number of hulls, so it is dealt over salts first: a task that adds up an interval reads a row per salt,
    and one that hands out the sums reads the hulls of a salt."""
    salts = int(hulls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = hulls.withColumn("salt", F.pmod(F.xxhash64("hull1", "hull2"), F.lit(salts)).cast("int"))
    dealt = salted.groupBy("core", "salt").agg(F.sum("same").alias("same"), F.count_if(F.col("same") == 1).alias("alone"))
    every = Window.partitionBy("core")
    sums = (dealt.select("core", "salt", F.sum("same").over(every).alias("total"), F.sum("alone").over(every).alias("open"))
            .filter("total > 1").drop("total"))
    return salted.join(sums, ["core", "salt"]).drop("salt")


def repeated_spans(texts: DataFrame, length: int = 400) -> DataFrame:
    """(h, start, end): byte spans of distinct texts (h, text, copies) that repeated windows cover; spans may overlap."""
    sampled = stored(_anchor_rows(texts, length), "repeat-anchors")
    nodes = _shared(sampled).select("h", "weight", "a", F.lit(0).alias("x"), "low", "high")
    spans, width, fan = None, SAMPLED, 1
    while True:
        rows = stored(_range_rows(texts, nodes, width, fan, length), "repeat-ranges")
        rows = rows.withColumn("id", F.xxhash64("h", "a"))
        hulls = rows.groupBy("core", "hull1", "hull2").agg(F.sum("weight").alias("same"), F.min("id").alias("witness"))
        known = rows.join(_with_totals(hulls), ["core", "hull1", "hull2"])
        if width > 1:
            known = stored(known.select("h", "weight", "a", "x", "low", "high", "same", "open", (F.col("id") == F.col("witness")).alias("first")),
                           "repeat-known")
        end = F.greatest("low", "x")
        start = F.least("high", F.col("x") + width - 1)
        settled = known.filter("same > 1").select("h", (F.col("a") - start).alias("start"), (F.col("a") - end + length).alias("end"))
        spans = settled if spans is None else spans.unionAll(settled)
        if width == 1:
            return spans
        nodes = known.filter("same = 1 or (open > 0 and first)").select("h", "weight", "a", "x", "low", "high")
        width, fan = width // FAN, FAN


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text",
                   with_kept: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, unless switched off, ``kept`` (the remaining bytes, as binary), over windows of ``length``
    bytes that occur more than once."""
    if length < SAMPLED + GRAM:
        raise ValueError(f"length must be at least {SAMPLED + GRAM}")
    texts = _texts(docs, text)
    spans = repeated_spans(texts, length).groupBy("h").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                data, starts = _bytes(b.column(1)[i]), b.column(3)[i]
                cut = np.zeros((0, 2), np.int64)
                if b.column(2)[i].as_py() > 1 and len(data) >= length:
                    cut = np.array([[0, len(data)]])
                elif starts.is_valid:
                    cut = merged(np.column_stack([np.array(starts.values), np.array(b.column(4)[i].values)]))
                edges = [0, *cut.ravel().tolist(), len(data)]
                kept = b"".join(data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             ["h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cleaned = (texts.join(spans, "h", "left").select("h", "text", "copies", "start", "end")
               .mapInArrow(run, "h binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    rows = docs.select(F.col(key).alias("id"), _name(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    return rows.join(cleaned, "h").select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                                         *(["kept"] if with_kept else []))
