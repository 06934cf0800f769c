"""Array column expressions: padding, argmax, cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_truncate(ids, length: int = 512, pad: int = 0) -> Column:
    """Truncate to ``length`` ids, then pad with ``pad`` up to ``length``."""
    arr = _c(ids)
    return F.slice(F.concat(F.slice(arr, 1, length), F.array_repeat(F.lit(pad), length)), 1, length)


def response_labels(ids, first, n, length: int | None = None, ignore: int = -100) -> Column:
    """Training labels of token ``ids`` whose response is the ``n`` tokens from ``first`` (0-based) on: their ids there, ``ignore``
    elsewhere, so the loss sees the response only. With ``length``, truncated and padded (with ``ignore``) like the ids."""
    arr = _c(ids)
    size = F.size(arr)
    lo = F.least(F.greatest(F.coalesce(_c(first), size), F.lit(0)), size)
    hi = F.least(F.greatest(_c(first) + F.coalesce(_c(n), F.lit(0)), lo), size)
    labels = F.when(arr.isNotNull(), F.concat(F.array_repeat(F.lit(ignore), lo), F.slice(arr, lo + 1, hi - lo),
                                              F.array_repeat(F.lit(ignore), size - hi)))
    return labels if length is None else pad_truncate(labels, length, ignore)


def attention_mask(ids, length: int = 512) -> Column:
    n = F.least(F.size(_c(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def argmax_label(scores) -> Column:
    """1-based position of the largest score; the first maximum wins."""
    arr = _c(scores)
    return F.array_position(arr, F.array_max(arr)).cast("int")


def cross_entropy(scores, target_pos) -> Column:
    """Per-row softmax cross-entropy: logsumexp(scores) - scores[target], stable form."""
    arr = F.transform(_c(scores), lambda x: x.cast("double"))
    m = F.array_max(arr)
    lse = m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return lse - F.element_at(arr, _c(target_pos).cast("int"))


def join_ints(arr, sep: str = ",") -> Column:
    """Array of numbers as one string (stable form for comparison and export)."""
    return F.array_join(_c(arr).cast("array<string>"), sep)


def value_counts(arr) -> Column:
    """``array<struct<value, n>>``: every distinct element of an array (without NULLs) and how often it occurs, by value.

    The array is sorted once and cut where its value changes: no shuffle, and n log n for a long one.
    """
    def counted(s: Column) -> Column:
        cuts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return F.transform(F.array(cuts), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(s, i).alias("value"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("n"))))[0]

    return F.transform(F.array(F.sort_array(_c(arr))), counted)[0]
