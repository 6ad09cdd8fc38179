"""Seeded, partition-independent randomness built from md5.

Every "random" choice in the package is a pure function of ``(seed, key...)``:
``md5(concat_ws(':', seed, key...))``, first 8 hex digits as an unsigned 32-bit
integer. The same expression exists in DuckDB, so sampling operators can be
checked exactly, and results do not change when data is repartitioned or a task
is retried (unlike ``rand()``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.concat_ws(":", *parts)


def hash_int(seed, *cols) -> Column:
    """Unsigned 32-bit integer (as BIGINT) from md5 of ``seed:col1:col2...``."""
    return F.conv(F.substring(F.md5(_key(seed, *cols)), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed, *cols) -> Column:
    """Uniform value in the open interval (0, 1)."""
    return (hash_int(seed, *cols) + F.lit(0.5)) / F.lit(TWO_32)


def hash_normal(seed, *cols, stddev: float = 1.0) -> Column:
    """N(0, stddev) by Box-Muller from two independent md5 uniforms."""
    u1 = hash_unit(seed, *cols, F.lit("a"))
    u2 = hash_unit(seed, *cols, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2) * F.lit(float(stddev))


def sql_hash_int(seed, *exprs: str) -> str:
    """DuckDB text of :func:`hash_int` (for oracle SQL)."""
    key = " || ':' || ".join([f"'{seed}'"] + [f"cast({e} as varchar)" for e in exprs])
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"
