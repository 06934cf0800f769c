"""SimHash near-duplicates: all fingerprints within a few bits of each other, found with vantage-point trees.

Two 64-bit fingerprints at most ``bits`` apart agree within ``bits // blocks`` in at least one of ``blocks`` parts of
the word, so one tree per part searches with that small radius. A node of a tree holds a vantage point and a distance
``m``: fingerprints nearer than or at ``m`` go to the near side, the others to the far side. By the triangle bound a
partner of a near one lies at ``m + radius`` at most, so only far ones in that band are sent to the near side too;
everything else is pruned. The leaves are the shards: Spark groups the fingerprints by leaf, and a leaf's task goes on
splitting its own members the same way and compares the last few by full Hamming distance. Where a part cannot be
split any more (many fingerprints agree in it) the node splits by the whole word.

A leaf's task returns a spanning forest of its links, not the pairs, so thousands of near copies give as many rows
as there are copies. Equal fingerprints are one node throughout. The trees are fitted on a sample of about ``SAMPLE``
fingerprints at most, and at most half of them; every fingerprint is routed, and the result is exact whatever the sample was.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other; rows
with null ids belong to components but never name one, unless there is no other id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import one_row_each, stored
from ratingspark.llm.components import components

SAMPLE, SHARD, SMALL = 100_000, 8_000, 256
BLOCKS = 3


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the A-Z lower-cased text's shingles of ``width`` words, repeats included (XXH64, majority of bits)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - width + 1
    for lo in range(0, n, 1 << 16):
        ends = starts[lo + width:min(lo + (1 << 16), n) + width]
        h = np.array([digest(line[a:b - 1], seed) for a, b in zip(starts[lo:], ends, strict=False)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """One row per row of ``docs``: (id, fp), fp the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, fp long")


def _distance(fps: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ point) & mask)


def _split(fps: np.ndarray, rng: np.random.Generator, scopes: list[tuple[int, int]]):
    """The best (vantage point, mask, radius, m) for these fingerprints, or None if no split is worth it.

    scopes: (mask, radius) to try in turn. Several vantage points are tried and the costs of both sides, border
    included, compared by their squares.
    """
    best = None
    for mask, radius in scopes:
        for point in rng.choice(fps, min(4, len(fps)), replace=False):
            upto = np.cumsum(np.bincount(_distance(fps, point, np.uint64(mask)), minlength=65)).astype(float)
            m = np.arange(64 - radius)
            near, far = upto[m + radius], len(fps) - upto[m]
            cost = near**2 + far**2
            i = int(cost.argmin())
            if max(near[i], far[i]) <= 0.85 * len(fps) and (best is None or cost[i] < best[0]):
                best = cost[i], point, np.uint64(mask), radius, i
        if best:
            return best[1:]
    return None


def _sides(fps: np.ndarray, node) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the near side (with the border that the triangle bound can't exclude) and of the far side."""
    point, mask, radius, m = node
    d = _distance(fps, point, mask)
    return d <= m + radius, d > m


def grow(sample: np.ndarray, total: int, mask: int, radius: int, bits: int, seed: int) -> list:
    """A tree as a list of nodes ((vantage, mask, radius, m), near, far); a leaf is None. Splits until a leaf is
    expected to hold at most ``SHARD`` of ``total`` fingerprints."""
    rng, nodes = np.random.default_rng(seed), []
    scopes = [(mask, radius), ((1 << 64) - 1, bits)]
    share = total / max(1, len(sample))

    def add(fps: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(fps) * share > SHARD and len(fps) >= 8 and (cut := _split(fps, rng, scopes)):
            near, far = _sides(fps, cut)
            nodes[at] = (cut, add(fps[near]), add(fps[far]))
        return at

    add(sample)
    return nodes


def route(tree: list, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions in fps) for every leaf that has any; a border fingerprint is in several."""
    waiting = [(0, np.arange(len(fps)))]
    while waiting:
        at, where = waiting.pop()
        if not len(where):
            continue
        if tree[at] is None:
            yield at, where
            continue
        cut, near, far = tree[at]
        n, f = _sides(fps[where], cut)
        waiting += [(near, where[n]), (far, where[f])]


class Forest:
    """Union-find over positions 0..n-1 whose unions come in arrays of edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        while (apart := x != y).any():
            lo, hi = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(self.label, hi, lo)
            while (self.label != (deeper := self.label[self.label])).any():
                self.label = deeper
            x, y = self.label[lo], self.label[hi]


def link_near(fps: np.ndarray, bits: int, mask: int, radius: int, seed: int = 0) -> np.ndarray:
    """For distinct fingerprints: the position of the first of each one's component, by local vantage-point splits."""
    rng, forest = np.random.default_rng(seed), Forest(len(fps))
    scopes = [(mask, radius), ((1 << 64) - 1, bits)]
    waiting = [np.arange(len(fps))]
    while waiting:
        where = waiting.pop()
        own = fps[where]
        if len(where) > SMALL and (cut := _split(own, rng, scopes)):
            near, far = _sides(own, cut)
            waiting += [where[near], where[far]]
            continue
        for lo in range(0, len(where), 1024):
            block = own[lo:lo + 1024]
            i, j = np.nonzero(np.bitwise_count(block[:, None] ^ own[None, lo:]) <= bits)
            keep = i < j
            if keep.any():
                forest.link(where[i[keep] + lo], where[j[keep] + lo])
    return forest.label


def _parts(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame, bits: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` that are at most ``bits`` apart."""
    spark = distinct.sparkSession
    total = distinct.count()
    # By hash, so it does not depend on the order of rows; about SAMPLE at most, never more than half of all.
    share = min(0.5, SAMPLE / max(1, total))
    drawn = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").limit(2 * SAMPLE)
    sample = np.sort(drawn.toArrow().column("fp").to_numpy()).astype(np.int64).view(np.uint64)
    masks, radius = _parts(blocks), bits // blocks
    trees = spark.sparkContext.broadcast([grow(sample, total, m, radius, bits, i) for i, m in enumerate(masks)])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t, tree in enumerate(trees.value):
                for leaf, where in route(tree, fps):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(where), t, np.int32)), pa.array(np.full(len(where), leaf, np.int32)),
                         pa.array(fps[where].view(np.int64))], ["tree", "leaf", "fp"])

    def within(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        first = link_near(fps, bits, masks[key[0].as_py()], radius)
        linked = np.flatnonzero(first != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[first[linked]].view(np.int64)})

    sharded = distinct.select("fp").mapInArrow(shard, "tree int, leaf int, fp long")
    return sharded.groupBy("tree", "leaf").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    reachable over fingerprints at most ``bits`` apart."""
    prints = stored(fingerprints(docs, key, text, width), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    labels = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    known = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    best = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = known.join(best, "label").select("fp", "component_id")
    return prints.join(found, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept.

    A document is an id with a text: rows that repeat both are one row, different texts of one id are different documents
    (of two in one component the one with the smaller hash stays), and rows without an id take part, but stay only where
    no document with an id is in their component.
    """
    # One key for both, never null, by which rows are grouped and joined without moving them twice.
    name = F.concat_ws(":", F.md5(F.coalesce(F.col(text), F.lit(""))), F.col(key).cast("string"))
    own = F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("id"), name.alias("name"))
    found = near_duplicates(docs.select(own.alias("own"), F.col(text).alias("text")), "own", "text", width, bits)
    kept = found.filter(F.col("own") == F.col("component_id")).select("own.name").distinct()
    return one_row_each(docs, name.alias("name")).join(kept, "name", "left_semi").select("row.*")
