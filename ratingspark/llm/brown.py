"""Language-model scores from Brown classes: P(word | previous) = P(class | class of the previous) * P(word | class).

All training words are counted by Spark, and every word that occurs ``LEAST`` times is clustered by the exchange algorithm
on the class bigram likelihood. The driver seeds the classes with the most frequent words and one stand-in for each of
``ENDINGS`` groups of the other words (by a hash of their last letters). Then Spark gathers each word's neighbours by
class from all training texts, a hash batch of the words at a time, and the words of the batch move to their best
class; where all moves of a batch together lower the likelihood, only those of the largest gain stand, as many as raise
it. Sweeps end when one raises the likelihood by less than ``ENOUGH`` of itself. Words that are rarer, or never seen, keep the class of their
ending. The number of classes is the cube root of that of the clustered words, at least ``CLASSES``.

A word's emission is its count over its class's; a class's transition counts are smoothed by 0.5. A word
never seen has the probability that the base model gives it, and the rest is shared by the known words, so the
probabilities of all next tokens sum to one.

Words are looked up in a broadcast head of at most ``HEAD`` frequent words; a text's other words travel as (word, count)
rows and join the table of all counts. The driver and each worker hold a hash, a class and a batch number for each
clustered word (some 11 bytes a word), never the words themselves beyond the head. A task takes its Arrow batches in
pieces of some ``PIECE`` bytes and holds bounded sums between them, so its memory does not follow the size of a batch or partition.

Defined results: a null or empty text is the end token alone; white space around words does not matter; rows with
null ids are trained on; repeated rows count and are scored as often as they occur; an empty training set knows nothing:
every token then has the base model's probability of an unknown one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import stored

HEAD, HEAD_BYTES, UNITS, ENDINGS, CLASSES, PASSES = 200_000, 64, 480, 96, 40, 12
#: Words seen so often are clustered one by one; every word moves once a sweep, together with its batch.
LEAST, SWEEPS, BATCHES, ENOUGH = 5, 12, 4, 0.002
#: Neighbours and words that a task sums up before it hands them on, words whose moves are weighed at once, and counts looked up.
PENDING, WORDS, CHUNK, SMALL = 1_000_000, 500_000, 256, 16
#: Bytes of text, or of what was made of it, that a task takes at a time.
PIECE = 1 << 21
#: Lines scored at a time.
ROWS = 256


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of some ``PIECE`` bytes of a column (strings or binaries); a longer value is not cut. After
    the last one Arrow's unused memory goes back, as the worker stays while Spark's own steps need the executor's memory."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(upto // PIECE)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The A-Z lower-cased words of all texts in UTF-8, one after the other, and how many each text has. Arrow's ASCII functions know
    those letters and the six ASCII white-space characters only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at the ends of a text leaves empty words there
    upto = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    offsets = lists.offsets.to_numpy()
    return flat.filter(full).cast(pa.binary()), np.diff(upto[offsets - offsets[0]])


def held_out(key: Column, fold: int = 1, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of (text); counted by pieces, summed up in the task, and combined before the shuffle."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0
        for b in pieces(batches, 0):
            found = pc.value_counts(all_words(b.column(0))[0])
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            pending += len(found)
            if pending > WORDS:
                held = [summed(held)]
                pending = held[0].num_rows
                if pending > WORDS // 2:
                    yield from held[0].to_batches()
                    held, pending = [], 0
        if held:
            yield from summed(held).to_batches()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, limit: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``limit``: all from a count level on, so no task sorts the vocabulary."""
    level = F.floor(F.log2("n") * 16).cast("int")
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    # At most 16 * 63 levels.
    sizes = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in sizes:
        total += r.words
        if total > limit:
            break
        least = r.level
    if least is None:
        return []
    found = short.filter(level >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return list(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))


def word_key(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


class Units:
    """Maps words to units: 0 is the end token, then the head words, the other clustered words in the order of their
    keys, and the groups of endings."""

    def __init__(self, head: list[tuple[bytes, int]], seeds: int = UNITS, endings: int = ENDINGS):
        self.head, self.endings = len(head), endings
        self.words, self.counts = pa.array([w for w, _ in head], pa.binary()), np.array([n for _, n in head], np.int64)
        self.alone = self.counts >= LEAST
        self.seeds = min(seeds, int(self.alone.sum()))  # the head comes by falling counts
        self.head_ending = np.array([self.ending(w) for w, _ in head], np.int64)
        self.with_keys(np.zeros(0, np.int64))

    def with_keys(self, keys: np.ndarray) -> Units:
        """keys: sorted keys of the clustered words outside the head."""
        self.keys = keys
        self.first_ending = 1 + self.head + len(keys)
        self.size = self.first_ending + self.endings
        self.head_unit = np.where(self.alone, np.arange(self.head) + 1, self.first_ending + self.head_ending).astype(np.int32)
        if not self.head:
            self.head_unit = np.zeros(1, np.int32)
        return self

    def ending(self, word: bytes) -> int:
        return crc32(word[-3:]) % self.endings

    def of(self, text: list[bytes]) -> tuple[dict[bytes, list[int]], np.ndarray]:
        """Where the words stand that have no unit among those of the head, and the unit of every word."""
        unit, tails = self.of_all(pa.array(text, pa.binary()), np.array([len(text)]))
        return {x["word"]: x["at"] for x in tails[0].as_py()}, unit

    def of_all(self, flat: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The unit of every word of a batch of texts (:func:`all_words`), and for each text its words that have no unit among
        those of the head, in the order they come, with their places. A word's key and ending are made once a batch."""
        at = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy()
        unit = self.head_unit[at]
        left = np.flatnonzero((at < 0) | (unit > self.head))
        coded = flat.take(pa.array(left)).dictionary_encode()
        code, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        own = np.array([self.first_ending + self.ending(w) for w in kinds], np.int32)
        if len(self.keys) and kinds:
            key = np.array([word_key(w) for w in kinds], np.int64)
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[found] == key
            own[known] = 1 + self.head + found[known]
        unit[left] = own[code] if kinds else 0

        row = np.repeat(np.arange(len(sizes)), sizes)[left]
        _, first, group, times = np.unique(row * max(1, len(kinds)) + code, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)  # groups by text and first place
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place = (left - np.repeat(np.cumsum(sizes) - sizes, sizes)[left])[np.argsort(rank[group], kind="stable")]
        places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times[order])), pa.int32()), pa.array(place, pa.int32()))
        names = coded.dictionary.take(pa.array(code[first[order]]))
        per_row = np.bincount(row[first], minlength=len(sizes))
        return unit, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)), pa.int32()),
                                              pa.StructArray.from_arrays([names, places], ["word", "at"]))


def other_keys(counts: DataFrame, units) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words to be clustered that are not in the head, and the group of endings of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        for b in batches:
            found = b.column(0).filter(pc.invert(pc.is_in(b.column(0), value_set=u.words))).to_pylist()
            yield pa.RecordBatch.from_pydict({"key": pa.array([word_key(w) for w in found], pa.int64()),
                                              "ending": pa.array([u.ending(w) for w in found], pa.int16())})

    found = counts.filter(F.col("n") >= LEAST).select("word").mapInArrow(run, "key long, ending short").toArrow()
    keys, first = np.unique(found.column("key").to_numpy(), return_index=True)
    return keys, found.column("ending").to_numpy()[first].astype(np.int64)


def encoded(rows: DataFrame, units) -> DataFrame:
    """Per row of (id, text): its id; ``line``, the units of its words and the end token, 4 bytes each; and ``tail``, the
    words without a unit in the head with their places. All later steps read these instead of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        for b in pieces(batches, 1):
            flat, sizes = all_words(b.column(1))
            unit, tails = u.of_all(flat, sizes)
            line = np.zeros(len(unit) + len(sizes), "<i4")  # 0 is the end token
            line[np.arange(len(unit)) + np.repeat(np.arange(len(sizes)), sizes)] = unit
            offsets = (4 * np.append(0, np.cumsum(sizes + 1))).astype(np.int32)
            lines = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(line)])
            yield pa.RecordBatch.from_arrays([b.column(0), lines, tails], ["id", "line", "tail"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"id {kind}, line binary, tail array<struct<word:binary,at:array<int>>>")


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a column of binaries (4 bytes each), one after the other, and where each row's begin and end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "<i4") if column.buffers()[2] else np.zeros(0, "<i4")
    return data[offsets[0] // 4:offsets[-1] // 4], (offsets - offsets[0]) // 4


def _line(batch: pa.RecordBatch) -> np.ndarray:
    """All lines one after the other, with the end token in front."""
    return np.append(np.zeros(1, np.int32), _ints(batch.column(0))[0])


def class_bigrams(lines: DataFrame, label: np.ndarray, classes: int) -> np.ndarray:
    """How often a unit of class b follows one of class a, over all lines; at most classes ** 2 rows a task."""
    shared = lines.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes * classes, np.int64)
        for b in pieces(batches, 0):
            line = shared.value[_line(b)].astype(np.int64)
            n += np.bincount(line[:-1] * classes + line[1:], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": at, "n": n[at]})

    found = lines.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(classes * classes, np.int64)
    n[found.column("at").to_numpy()] = found.column("n").to_numpy()
    shared.destroy()
    return n.reshape(classes, classes)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _summed_all(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(*map(np.concatenate, zip(*held, strict=True)))


def neighbours(lines: DataFrame, state, batch: int, classes: int) -> DataFrame:
    """(unit, bag) of the batch's words, summed per task, a row for each unit: its bag holds pairs (at, n) of 4 bytes
    each. at is the class of the next unit, ``classes`` + that of the one before, or 2 * ``classes`` where a unit follows itself."""
    width = 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, group = state.value

        def handed_on(key, n):
            unit, at = np.divmod(key, width)
            first = np.flatnonzero(np.diff(unit, prepend=-1))
            data = pa.py_buffer(np.stack([at, n], axis=1).astype("<i4"))
            offsets = pa.py_buffer((8 * np.append(first, len(unit))).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(unit[first].astype(np.int32)),
                                               pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, data])], ["unit", "bag"])

        held, pending = [], 0
        for b in pieces(batches, 0):
            line = _line(b)
            kind, here = label[line].astype(np.int64), group[line] == batch
            same = line[:-1] == line[1:]
            left, right = np.flatnonzero(here[:-1]), np.flatnonzero(here[1:] & ~same)
            key = np.concatenate([line[left].astype(np.int64) * width + np.where(same[left], 2 * classes, kind[left + 1]),
                                  line[right + 1].astype(np.int64) * width + classes + kind[right]])
            held.append(np.unique(key, return_counts=True))
            pending += len(held[-1][0])
            if pending > PENDING:
                held = [_summed_all(held)]
                pending = len(held[0][0])
                if pending > PENDING // 2:
                    yield handed_on(*held[0])
                    held, pending = [], 0
        if held:
            yield handed_on(*_summed_all(held))

    return lines.mapInArrow(run, "unit int, bag binary")


def moves(found: DataFrame, state, n: np.ndarray) -> DataFrame:
    """(unit, class, gain) of the units that gain by another class. found: neighbours; all rows of a unit meet in one task, one
    after the other."""
    classes = len(n)
    width = 2 * classes + 1

    def whole_units(batches):
        held = []  # of the unit that the next rows may belong to
        for b in pieces(batches, 1):
            bag, ends = _ints(b.column(1))
            unit = np.repeat(b.column(0).to_numpy().astype(np.int64), np.diff(ends) // 2)
            key, times = unit * width + bag[::2], bag[1::2].astype(np.int64)
            last = np.searchsorted(unit, unit[-1])
            if held and held[0][0][0] // width < unit[-1]:
                yield _summed_all([*held, (key[:last], times[:last])])
                held = []
            elif last:
                yield _summed(key[:last], times[:last])
            held.append((key[last:], times[last:]))
        if held:
            yield _summed_all(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, _ = state.value
        weigh = None
        for key, times in whole_units(batches):
            weigh = weigh or Gains(n)
            unit, at = np.divmod(key, width)
            starts = np.flatnonzero(np.diff(unit, prepend=-1))
            for i in range(0, len(starts), CHUNK):
                part = slice(starts[i], starts[i + CHUNK] if i + CHUNK < len(starts) else len(unit))
                names = unit[starts[i:i + CHUNK]]
                old = label[names].astype(np.int64)
                new, gain = weigh.best(np.searchsorted(names, unit[part]), at[part], times[part].astype(float), old)
                left = new != old
                yield pa.RecordBatch.from_pydict({"unit": names[left].astype(np.int32), "class": new[left].astype(np.int32),
                                                  "gain": gain[left].astype(np.float32)})

    return found.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "unit int, class int, gain float")


class Gains:
    """Gain in the class bigram likelihood of putting one unit into each class, all others left where they are."""

    def __init__(self, n: np.ndarray):
        self.n = n = n.astype(float)
        self.rows, self.cols = n.sum(1), n.sum(0)
        small = np.arange(SMALL + 1.0)[:, None, None]
        # [times, class of the neighbour, class joined]
        self.out, self.into = (_f(m[None] + small) - _f(m)[None] for m in (n.T, n))

    def best(self, row: np.ndarray, at: np.ndarray, times: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best class, gain over the present one) of each unit. row, at, times: neighbours by unit number, sorted; old: class of each unit."""
        classes, units = len(self.n), len(old)
        dense = np.zeros((units, 2 * classes + 1))
        dense[row, at] = times
        out, into, own = dense[:, :classes], dense[:, classes:-1], dense[:, -1]
        each = np.arange(units)
        gain = np.zeros((units, classes))
        for shift, table, m, mine, cross in ((0, self.out, self.n.T, out, into), (classes, self.into, self.n, into, out)):
            pick = np.flatnonzero((at >= shift) & (at < shift + classes))
            if not len(pick):
                continue
            u, d, x = row[pick], at[pick] - shift, times[pick]
            value = table[np.minimum(x, SMALL).astype(np.int64), d]
            many = np.flatnonzero(x > SMALL)
            value[many] = _f(m[d[many]] + x[many, None]) - _f(m[d[many]])
            # The counts without the unit itself: less in the row of its class, and where its class is the neighbour's.
            less = m[d, old[u]] - x - np.where(d == old[u], cross[u, old[u]] + own[u], 0)
            home = np.flatnonzero(d == old[u])
            rest = m[d[home]] - cross[u[home]]
            value[home] = _f(rest + x[home, None]) - _f(rest)
            value[np.arange(len(u)), old[u]] = _f(less + x) - _f(less)
            first = np.flatnonzero(np.diff(u, prepend=-1))
            gain[u[first]] += np.add.reduceat(value, first)
        corner = np.broadcast_to(np.diag(self.n), (units, classes)).copy()
        corner[each, old] -= out[each, old] + into[each, old] + own
        gain += _f(corner + out + into + own[:, None]) + _f(corner) - _f(corner + out) - _f(corner + into)
        for total, mine in ((self.rows, out.sum(1) + own), (self.cols, into.sum(1) + own)):
            rest = np.broadcast_to(total, (units, classes)).copy()
            rest[each, old] -= mine
            gain -= _f(rest + mine[:, None]) - _f(rest)
        gain[:, 0] = -np.inf
        new = gain.argmax(1)
        more = gain[each, new] - gain[each, old]
        return np.where(more > 1e-9, new, old), more


def likelihood(n: np.ndarray) -> float:
    n = n.astype(float)
    return float(_f(n).sum() - _f(n.sum(1)).sum() - _f(n.sum(0)).sum())


def cluster(lines: DataFrame, label: np.ndarray, group: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigrams) after at most ``SWEEPS`` sweeps over the batches that ``group`` puts the units
    in; units in none stay."""
    context = lines.sparkSession.sparkContext
    n = class_bigrams(lines, label, classes)
    worth = likelihood(n)
    for _ in range(SWEEPS):
        before = worth
        for batch in range(BATCHES):
            state = context.broadcast((label, group))
            # At most the units of the batch, 12 bytes each.
            found = moves(neighbours(lines, state, batch, classes), state, n).toArrow()
            state.destroy()
            unit, to, gain = (found.column(c).to_numpy() for c in ("unit", "class", "gain"))
            order = np.lexsort((unit, -gain))
            while len(order):
                trial = label.copy()
                trial[unit[order]] = to[order]
                then = class_bigrams(lines, trial, classes)
                if likelihood(then) > worth:
                    label, n, worth = trial, then, likelihood(then)
                    break
                order = order[:len(order) // 4]
        if worth - before <= ENOUGH * abs(worth):
            break
    return label, n


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit (the end token keeps class 0 alone): units move, one at a time, to the class with the largest
    class bigram likelihood, until a pass moves none. pairs[a, b]: how often unit b follows unit a."""
    pairs = pairs.astype(float)
    units = len(pairs)
    order = np.argsort(-(pairs.sum(0)[1:]), kind="stable") + 1
    label = np.zeros(units, np.int64)
    label[order] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.eye(classes)[label]
    n = member.T @ pairs @ member
    for _ in range(passes):
        moved = 0
        for u in order.tolist():
            member[u] = 0
            own, out, into = pairs[u, u], pairs[u] @ member, pairs[:, u] @ member
            old = label[u]
            n[old] -= out
            n[:, old] -= into
            n[old, old] -= own
            # Gain of putting u into class c: the row and column of c change, and their crossing once more.
            cross = np.diag(n)
            gain = ((_f(n + out) - _f(n)).sum(1) + (_f(n + into[:, None]) - _f(n)).sum(0)
                    - (_f(cross + out) - _f(cross)) - (_f(cross + into) - _f(cross)) + _f(cross + out + into + own) - _f(cross))
            gain -= _totals(n.sum(1), n.sum(0), out, into, own)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            n[new] += out
            n[:, new] += into
            n[new, new] += own
            member[u, new], label[u] = 1, new
            moved += new != old
        if not moved:
            break
    return label


def _totals(rows: np.ndarray, cols: np.ndarray, out: np.ndarray, into: np.ndarray, own: float) -> np.ndarray:
    """Loss in the class totals when the unit joins each class: its own row and column sums are the same wherever it goes."""
    from_u, to_u = out.sum() + own, into.sum() + own  # the sums of ``n`` hold no pair of u while it has no class
    return _f(rows + from_u) - _f(rows) + _f(cols + to_u) - _f(cols)


class Model(NamedTuple):
    units: Units | None
    label: np.ndarray       # class of each unit
    step: np.ndarray        # log10 P(class | previous class) - log10 count of the class
    head_log: np.ndarray    # log10 count of each head word
    head_base: np.ndarray   # log10 base probability of each head word
    train_tokens: int
    denominator: float      # of the base model
    end_count: int


def unit_table(counts: DataFrame) -> tuple[Units, np.ndarray]:
    """The units of the counted words, and the groups of endings of those clustered outside the head."""
    clustered = counts.filter(F.col("n") >= LEAST).count()
    units = Units(head_words(counts, HEAD), max(UNITS, 8 * (class_number(clustered) - CLASSES)))
    shared = counts.sparkSession.sparkContext.broadcast(units)
    keys, ending = other_keys(counts, shared)
    shared.destroy()
    return units.with_keys(keys), ending


def class_number(clustered: int) -> int:
    return max(CLASSES, round(clustered ** (1 / 3)))


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """The model of all rows of (text); counts: their stored word counts."""
    units, ending = unit_table(counts)
    rows = texts.select(F.lit(None).cast("long").alias("id"), "text")
    lines = stored(encoded(rows, texts.sparkSession.sparkContext.broadcast(units)), "brown-lines")
    return fit(lines.select("line"), counts, units, ending)


def fit(lines: DataFrame, counts: DataFrame, units: Units, ending: np.ndarray) -> Model:
    """The model of the stored ``lines`` to learn from; counts: the counts of their words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.count(F.when(F.col("n") >= LEAST, 1)).alias("clustered")).first()
    ends = lines.count()
    n, v = total.n + ends, total.v + (ends > 0)
    classes = class_number(total.clustered)
    keys = units.keys

    # Seed units: the end token, the most frequent words, the groups of endings.
    seed = 1 + units.seeds + np.concatenate([[0], units.head_ending, ending, np.arange(units.endings)]).astype(np.int64)
    seed[:1 + units.seeds] = np.arange(1 + units.seeds)
    seeds = 1 + units.seeds + units.endings
    label = exchange(class_bigrams(lines, seed.astype(np.int32), seeds), classes)[seed].astype(np.uint16)
    group = np.full(units.size, BATCHES, np.uint8)  # the end token and the endings are in no batch
    group[1:1 + units.head] = [word_key(w) % BATCHES for w in units.words.to_pylist()]
    group[1 + units.head:units.first_ending] = keys % BATCHES
    label, follows = cluster(lines, label, group, classes)
    of_class = follows.sum(0)
    chance = (follows + 0.5) / (follows.sum(1, keepdims=True) + 0.5 * classes)
    denominator = n + 0.5 * (v + 1)
    step = np.log10(chance) - np.log10(np.maximum(of_class, 1))[None, :]
    many = units.counts.astype(float) if units.head else np.ones(1)
    return Model(units, label, step, np.log10(many), np.log10((many + 0.5) / denominator), n, denominator, ends)


def measure(lines: DataFrame, model, head: int) -> DataFrame:
    """Per row of :func:`encoded`: its id, tokens and scores of its end and head words (units up to ``head``), and its other
    words as an array of (word, times, step), step the sum of their transition terms. Logs are to base 10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        unknown = np.log10(0.5 / m.denominator)
        known = np.log10(max(1 - 0.5 / m.denominator, 1e-300))
        # By unit up to the head: what a token adds to the base and, beside its transition, to the score.
        end = (np.log10((m.end_count + 0.5) / m.denominator), known + np.log10(m.end_count) if m.end_count else unknown)
        base_of = np.append(end[0], m.head_base[:head])
        score_of = np.append(end[1], m.head_log[:head] + known)
        for b in pieces(batches, 1):
            for lo in range(0, b.num_rows, ROWS):
                yield part(b.slice(lo, ROWS), m, base_of, score_of)

    def part(b: pa.RecordBatch, m: Model, base_of: np.ndarray, score_of: np.ndarray) -> pa.RecordBatch:
        line, ends = _ints(b.column(1))
        starts = ends[:-1]
        kind = m.label[np.append(np.zeros(1, np.int32), line)]
        step = m.step[kind[:-1], kind[1:]]
        in_head = line <= head
        place = np.where(in_head, line, 0)
        moved = step if m.end_count else np.where(line > 0, step, 0)
        each = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every line has its end token
        tail = b.column(2)
        words_, places = tail.flatten().field(0), tail.flatten().field(1)
        of_row = np.diff(tail.offsets.to_numpy())
        times = np.diff(places.offsets.to_numpy())
        at = places.flatten().to_numpy() + np.repeat(np.repeat(starts, of_row), times)
        steps = np.add.reduceat(step[at], np.cumsum(times) - times) if len(at) else np.zeros(0)
        others = pa.StructArray.from_arrays([words_, pa.array(times, pa.int64()), pa.array(steps)], ["word", "times", "step"])
        offsets = pa.array(np.append(0, np.cumsum(of_row)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(each(in_head & ((line > 0) | (m.end_count > 0))).astype(np.int64)),
             pa.array(each(np.where(in_head, base_of[place], 0))), pa.array(each(np.where(in_head, score_of[place] + moved, 0))),
             pa.ListArray.from_arrays(offsets, others)], ["id", "n_tokens", "n_known", "base", "score", "tail"])

    kind = lines.schema["id"].dataType.simpleString()
    return lines.select("id", "line", "tail").mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base double, score double, "
                                                             "tail array<struct<word:binary,times:long,step:double>>")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out`` (crc32 of the id mod 5 is 1: not learned from), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-half unigrams) and ``score``, both log10 probabilities."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    learned = rows.filter(~held_out(F.col("id"))).select("text")
    counts = stored(word_counts(learned), "brown-counts")
    units, ending = unit_table(counts)
    names = docs.sparkSession.sparkContext.broadcast(units)
    lines = stored(encoded(rows, names), "brown-lines")
    names.destroy()
    model = fit(lines.filter(~held_out(F.col("id"))).select("line"), counts, units, ending)
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(units=None))
    parts = stored(measure(lines, shared, units.head).withColumn("row", F.monotonically_increasing_id()), "brown-parts")
    shared.destroy()

    d = model.denominator
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    n, times = F.col("n"), F.col("times")
    seen = n.isNotNull()
    joined = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(seen, times).otherwise(0)).alias("more_known"),
        F.sum(times * F.log10((F.coalesce(n, F.lit(0)) + 0.5) / d)).alias("more_base"),
        F.sum(F.when(seen, times * (F.log10(F.greatest(n, F.lit(1))) + float(np.log10(max(1 - 0.5 / d, 1e-300)))) + F.col("step"))
              .otherwise(times * float(np.log10(0.5 / d)))).alias("more_score"))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return parts.drop("tail").join(joined, "row", "left").select(
        F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "n_tokens", add("n_known", "more_known").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), add("base", "more_base").alias("base_score"),
        add("score", "more_score").alias("score"))
