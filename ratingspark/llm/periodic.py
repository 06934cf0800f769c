"""Periodic runs in texts: every maximal stretch of words that repeats with some period, found by recompression.

The texts of a chunk are one sequence of word numbers with a separator, equal to nothing, before and after each text.
Block compression (a stretch of one symbol becomes one symbol) and pair compression (symbols are dealt to a left and a
right class; a left one followed by a right one becomes one symbol) alternate until one symbol is left: a run-length
grammar whose levels shrink by a constant share. Equal stretches are cut alike except for one symbol at their ends,
so a longest common extension (LCE) climbs both places level by level while their symbols agree and climbs down to the
first word that differs: one step a level, no suffix array, and exact whatever the classes were.

A run of period q that is at least 2q long holds a place i of the grid 0, q, 2q, ... with i + q still inside it, so the
candidates of all periods are the pairs (i, i + q): n/1 + n/2 + ... of them. The words on both sides of a pair are
compared first; where either agrees, the extensions to the right and to the left of it give the run. Of the periods found for one
stretch the smallest is its period.

Each text is worked on in the partition it lies in and nothing is shuffled; chunks hold whole texts, about ``CHUNK`` words
or one longer text (some 60 bytes a word), and the candidates are met in pieces of at most ``PIECE``.

Defined results: a null text or one without words has no runs and collapses to the empty text; null and repeated keys are
kept row by row; an empty table gives an empty one; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import SPACE, let

CHUNK, PIECE = 250_000, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Grammar:
    """The levels of a recompressed sequence. ``symbols[k]`` are those of level k; ``first[k]`` says where the children of
    its nodes begin in level k - 1 (one entry more than nodes), ``parent[k]`` which node of level k + 1 holds each one, and
    ``blocks[k]`` whether level k + 1 was made by blocks."""

    def __init__(self, sequence: np.ndarray):
        self.symbols, self.first, self.parent, self.blocks = [sequence.astype(np.int32)], [None], [], []
        self.names, turn = int(sequence.max(initial=0)) + 1, 0
        while len(self.symbols[-1]) > 1:
            self._block()
            if len(self.symbols[-1]) > 1:
                self._pair(turn)
            turn += 1

    def _level(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        below = len(self.symbols[-1])
        head = np.zeros(below, np.int32)
        head[starts] = 1
        self.parent.append(np.cumsum(head, dtype=np.int32) - 1)
        self.first.append(np.append(starts, below).astype(np.int32))
        self.symbols.append(symbols.astype(np.int32))
        self.blocks.append(blocks)

    def _named(self, symbols: np.ndarray, where: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """``symbols`` with a new name at each of the places, the same one for the same key."""
        found, which = np.unique(keys, return_inverse=True)
        symbols[where] = self.names + which
        self.names += len(found)
        return symbols

    def _block(self) -> None:
        s = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) < len(s):
            counts = np.diff(np.append(starts, len(s)))
            long = np.flatnonzero(counts > 1)
            symbols = s[starts]
            self._level(starts, self._named(symbols, long, symbols[long].astype(np.int64) << 32 | counts[long]), True)

    def _pair(self, turn: int) -> None:
        s = self.symbols[-1]
        # Any way to deal the symbols is right; a fixed hash of symbol and turn deals them evenly.
        mixed = (s.astype(np.uint64) + np.uint64(turn * 0x632BE59B + 1)) * np.uint64(0x9E3779B97F4A7C15)
        right = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) > 0
        second = np.append(False, ~right[:-1] & right[1:])
        starts = np.flatnonzero(~second)
        pairs = np.flatnonzero(np.append(second[1:], False)[starts])
        if len(pairs):
            at, symbols = starts[pairs], s[starts]
            self._level(starts, self._named(symbols, pairs, s[at].astype(np.int64) << 32 | s[at + 1]), False)

    def extend(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """The places where the words read from ``x`` on (or back) first differ from those read from ``y`` on: places of the
        first. Both must meet different separators in the end, and no place may be its own partner."""
        step, lead = (1, 0) if forward else (-1, 1)  # lead: 0 if a node is entered by its first child, 1 if by its last
        out, stopped, at = np.empty(len(x), np.int64), [], np.arange(len(x))
        for k, symbols in enumerate(self.symbols):
            same = symbols[x] == symbols[y]
            more = None
            if k < len(self.parent):
                parent, first = self.parent[k], self.first[k + 1]
                px, py = parent[x], parent[y]
                if self.blocks[k]:
                    left_x, left_y = ((first[px + 1] - x, first[py + 1] - y) if forward else (x - first[px] + 1, y - first[py] + 1))
                    whole = left_x == left_y
                    ends = step * np.minimum(left_x, left_y)
                    x, y = np.where(same & ~whole, x + ends, x), np.where(same & ~whole, y + ends, y)
                    more, up_x, up_y = same & whole, px + step, py + step
                else:
                    inside = (x != first[px + lead] - lead) | (y != first[py + lead] - lead)
                    more, up_x, up_y = same, np.where(inside, px + step, px), np.where(inside, py + step, py)
                    # past a second child lies the next node; a node alone beside it ends there as well
            else:
                more = np.zeros(len(x), bool)
            stopped.append((at[~more], x[~more], y[~more]))
            if not more.any():
                break
            at, x, y = at[more], up_x[more], up_y[more]
        at = x = y = np.empty(0, np.int64)
        for k in range(len(stopped) - 1, -1, -1):
            symbols = self.symbols[k]
            if len(at):  # entered from above: the first children that differ
                first = self.first[k + 1]
                px, py = x, y
                x, y = first[px + lead] - lead, first[py + lead] - lead
                same = symbols[x] == symbols[y]
                width = np.minimum(first[px + 1] - first[px], first[py + 1] - first[py]) if self.blocks[k] else 1
                x, y = x + step * same * width, y + step * same * width
            at, x, y = (np.append(a, b) for a, b in zip((at, x, y), stopped[k], strict=True))
        out[at] = x
        return out


def _candidates(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q of the harmonic grids of all texts (words starts..ends of the sequence), in pieces."""
    periods = (ends - starts) // 2
    text = np.repeat(np.arange(len(starts)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    counts = (ends[text] - starts[text] - 1) // q
    upto = np.cumsum(counts)
    lo = 0
    while lo < len(q):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PIECE, "right")))
        each = np.repeat(np.arange(lo, hi), counts[lo:hi])
        turn = np.arange(len(each)) - np.repeat(upto[lo:hi] - counts[lo:hi] - done, counts[lo:hi])
        period = q[each]
        yield starts[text[each]] + turn * period, period
        lo = hi


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), one for each stretch, with its smallest period; by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[:len(runs)]
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list], least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The runs (start, end, period) of all texts (lists of words), as places of the sequence in which a separator
    precedes every text, and the place of each text's first word in it."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    sequence = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    for t, at in zip(texts, starts.tolist(), strict=True):
        sequence[at:at + len(t)] = list(map(number.__getitem__, t))
    apart = np.append(starts - 1, len(sequence) - 1)
    sequence[apart] = len(number) + np.arange(len(apart))
    found, grammar = [np.empty((0, 3), np.int64)], None
    for i, q in _candidates(starts, starts + sizes):
        near = (sequence[i] == sequence[i + q]) | (sequence[i - 1] == sequence[i + q - 1])
        i, q = i[near], q[near]
        if not len(i):
            continue
        grammar = grammar or Grammar(sequence)
        end = grammar.extend(i, i + q, True) + q
        start = grammar.extend(i - 1, i + q - 1, False) + 1
        run = end - start >= np.maximum(least, 2 * q)
        if run.any():
            found.append(_smallest(np.stack([start[run], end[run], q[run]], axis=1)))
    return _smallest(np.concatenate(found)), starts


def _chunks(texts: Iterator) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for t in texts:
        words = t.as_py().split() if t.is_valid else []  # bytes split at the six ASCII white-space characters
        if held and n + len(words) > CHUNK:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words) + 1
    if held:
        yield held


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_words``, ``runs`` (start, length, period of every run of at least ``least``
    words, by start, then period) and ``collapsed``: the words outside all repetitions (a run's words after its first
    period), joined by single spaces."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in _chunks(b.column(1).cast(pa.binary())):
                found, starts = runs_of(texts, least)
                owner = np.searchsorted(starts, found[:, 0], "right") - 1
                offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
                kept = [b" ".join(t) for t in texts]
                for d in np.unique(owner).tolist():
                    mine = found[offsets[d]:offsets[d + 1]] - [[starts[d], starts[d], 0]]
                    edge = np.zeros(len(texts[d]) + 1, np.int64)
                    np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
                    np.add.at(edge, mine[:, 1], -1)
                    kept[d] = b" ".join([texts[d][i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
                fields = [found[:, 0] - starts[owner], found[:, 1] - found[:, 0], found[:, 2]]
                structs = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "runs", "collapsed"])
                done += len(texts)

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def planted(key: Column, text: Column) -> Column:
    """The words of ``text``, of every tenth hash of the key with a periodic end: h = crc32 of the key's digits, g = floor(h / 10);
    if h % 10 = 0, word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Other texts, and those with a null key, stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        filled = let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.transform(
            words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, v["a"] + (i - v["a"]) % v["p"]))))
        return F.when(n > 0, F.array_join(filled, " ")).otherwise(text)

    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull()
    return F.when(chosen, let(F.array_remove(F.split(text, SPACE), ""), repeated)).otherwise(text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``find_runs``: how many runs, the longest one (ties: the first start, then the smallest period; nulls if
    there is none), its exponent in thousandths, and SHA-256 of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))  # null if there is none
    length, start, period = (best.getField(c) for c in ("length", "col2", "col3"))
    return (found.select(key, F.size("runs").cast("long").alias("n_runs"), (-start).alias("start"), length.alias("length"),
                    (-period).alias("period"), F.floor(1000 * length / -period).alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
                    "n_words"))
