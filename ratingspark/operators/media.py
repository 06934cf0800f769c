"""Containment join of ids to file names ("first file whose name contains the id").

A theta join on ``contains`` would compare every id with every name. Instead one automaton of all ids (Aho-Corasick) is
built in each task and reads every name once, whatever the ids' number and lengths; a task keeps the smallest name of each id it met, so it
emits at most one row per id. The ids are counted and measured first, and are sent to the tasks only up to ``MAX_IDS`` ids
of ``MAX_CHARS`` characters together.

Beyond that, each name emits its substrings of the lengths that ids actually have, and the
match becomes an equi-join on that substring: exact too, and the work per name is
bounded by (name length x number of distinct id lengths). Nearly all of these substrings are no id, and sorting them by text costs
far more than making them, so each is looked up first in a table of bits (a Bloom filter of all ids, ``MAX_BITS`` at most). It drops
no substring that is an id; of the others few are left, which the join drops. All substrings of a batch are hashed at once, by prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_IDS, MAX_CHARS = 200_000, 8_000_000
#: Bits for each id (two are set), and of the whole table: 16 MB, sent to every task.
BITS_PER_ID, MAX_BITS = 16, 1 << 27
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
#: An odd base, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def id_lengths(ids: DataFrame, id_col: str = "id") -> list[int]:
    """Distinct id lengths in bytes: a tiny set (at most the longest id's length)."""
    rows = ids.select(F.octet_length(id_col).alias("n")).where("n > 0").distinct().collect()
    return sorted(r["n"] for r in rows)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hashed:
    """Hashes of any stretches of a text, modulo 2 ** 64: the same bytes have the same hash wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data) or 1)[:len(data)], out=self.sums[1:])
        self.back = _powers(INVERSE, len(data) + 1)

    def places(self, start: np.ndarray, length: np.ndarray | int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two places each among ``bits``, a power of two."""
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and where each begins, with the end of the last; a null one is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], at - at[0]


def id_bits(ids: DataFrame, n: int, id_col: str = "id", max_bits: int = MAX_BITS) -> np.ndarray:
    """The table of bits of ``n`` ids, as words of 64."""
    bits = min(max_bits, max(1 << 16, 1 << (BITS_PER_ID * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _text_of(b.column(0))
            places = np.concatenate(_Hashed(data).places(at[:-1], np.diff(at), bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places))], ["place"])

    places = ids.select(F.col(id_col).cast("string")).mapInArrow(run, "place long")
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()
    return table


def name_substrings(names: DataFrame, lengths: list[int], table: np.ndarray, name_col: str = "name") -> DataFrame:
    """``sub, name``: the substrings of each name with a length (in bytes) in ``lengths`` whose bits are set in ``table``."""
    sent = names.sparkSession.sparkContext.broadcast(table)

    def pieces(column: pa.Array) -> Iterator[pa.Array]:
        ends = _text_of(column)[1][1:]
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
            yield column[i:j]
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value.view(np.uint8)
        is_set = lambda place: (words[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        for column in (x for b in batches for x in pieces(b.column(0))):
            data, at = _text_of(column)
            hashed, row = _Hashed(data), np.repeat(np.arange(len(column)), np.diff(at))
            left = at[row + 1] - np.arange(len(data))  # bytes up to the name's end
            longest = int(left.max(initial=0))
            whole = np.append(data & 0xC0 != 0x80, True)  # where a character begins
            for n in lengths:
                start = np.flatnonzero(whole[:-1] & (left >= n))
                start = start[whole[start + n]]
                one, two = hashed.places(start, n, len(words) << 3)
                start = start[is_set(one) & is_set(two)]
                step = max(1, 4 * PIECE // (n + longest))  # rows of a batch, by what they hold at most
                for some in (start[i:i + step] for i in range(0, len(start), step)):
                    subs = pa.py_buffer(data[(some[:, None] + np.arange(n)).ravel()])
                    subs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(some), [None, subs]).cast(pa.binary()).view(pa.string())
                    yield pa.RecordBatch.from_arrays([subs, column.take(pa.array(row[some]))], ["sub", name_col])

    return names.select(F.col(name_col).cast("string")).mapInArrow(run, f"sub string, `{name_col}` string")


def smallest_by_automaton(names: DataFrame, ids: list[str], name_col: str = "name") -> DataFrame:
    """``sub, name``: from each task, the smallest name that contains the id, for every id that any of its names contains."""
    sent = names.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for x in sent.value:
            found.add_word(x, x)
        found.make_automaton()
        best: dict[str, str] = {}
        for b in batches:
            for name in b.column(0).to_pylist():
                for _, x in found.iter(name) if name and sent.value else ():
                    if x not in best or name < best[x]:
                        best[x] = name
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.string()), pa.array(best.values(), pa.string())], ["sub", name_col])

    return names.select(F.col(name_col).cast("string")).mapInArrow(run, f"sub string, `{name_col}` string")


def match_media(ids: DataFrame, names: DataFrame, id_col: str = "id", name_col: str = "name", max_ids: int = MAX_IDS,
                max_chars: int = MAX_CHARS) -> DataFrame:
    """For each id, the smallest file name containing it; NULL for an id that no name contains (and for an empty one).

    Up to the bounds the names pass an automaton of the ids. Beyond them the names' substrings that may be ids are reduced to the smallest name of each before they meet the ids. Both
    are combined map-side, so an id found in nearly all names (a one-digit one) leaves each task once, and the
    join has at most one row per id on either side: no key is hot.
    """
    wanted = ids.select(F.col(id_col).cast("string").alias(id_col)).distinct()
    texts = wanted.where(F.length(id_col) > 0)
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(id_col)), F.lit(0)).alias("chars")).first()
    if size["n"] <= max_ids and size["chars"] <= max_chars:
        subs = smallest_by_automaton(names, [r[0] for r in texts.collect()], name_col)
    else:
        subs = name_substrings(names, id_lengths(wanted, id_col), id_bits(texts, size["n"], id_col), name_col)
    best = subs.groupBy("sub").agg(F.min(name_col).alias(name_col))
    return wanted.join(best, wanted[id_col] == best["sub"], "left").select(id_col, name_col)
