"""Deterministic, partition-independent hashing helpers.

Everything is derived from ``md5`` hex digests so the same integers come out of
Spark and of any SQL engine with ``md5``; no sort and no global state is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def salted_text(salt: str, *cols) -> Column:
    """``salt:col1:col2...`` (NULLs become empty strings)."""
    return F.concat_ws(":", F.lit(str(salt)), *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def salted_md5(salt: str, *cols) -> Column:
    """md5 hex of ``salt:col1:col2...`` (NULLs become empty strings)."""
    return F.md5(salted_text(salt, *cols))


def hex_prefix_int(hexcol: Column, n_hex: int = 8) -> Column:
    """First ``n_hex`` hex digits as a non-negative BIGINT (8 digits: 0 .. 2^32-1)."""
    return F.conv(F.substring(hexcol, 1, n_hex), 16, 10).cast("bigint")


def unit_hash(salt: str, *cols) -> Column:
    """Integer in [0, 2^32) from the salted md5 of the columns."""
    return hex_prefix_int(salted_md5(salt, *cols), 8)


def threshold_hex(p: float) -> str:
    """``p`` as an 8-digit lower-case hex bound, for text comparison with md5 prefixes."""
    if not 0.0 <= p < 1.0:
        raise ValueError("p must be within [0, 1)")
    return f"{int(p * (1 << 32)):08x}"


def below(salt: str, key, p: float) -> Column:
    """True for about a share ``p`` of keys; stable under any repartitioning."""
    if p >= 1.0:
        return F.lit(True)
    return F.substring(salted_md5(salt, key), 1, 8) < F.lit(threshold_hex(p))
