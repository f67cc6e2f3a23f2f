"""Deterministic uniforms from md5.

``uniform(id, seed, split, salt)`` takes the first 13 hex digits of
``md5(id|seed|split|salt)`` as an integer h and returns (h + 0.5) / 2^52,
always strictly inside (0, 1).  Unlike ``rand()`` the value does not depend
on partitioning, task retries or executor loss, so a re-run after a lost
executor draws the same sample.  The same number is reproducible in any SQL
engine that has md5 (see ``uniform_sql``).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.lit(c)
    return F.lit(str(c))


def uniform(*parts) -> Column:
    """Uniform in (0,1) from the md5 of the '|'-joined parts.

    ``parts`` may be Columns or Python literals (str/int).
    """
    key = F.concat_ws("|", *[_as_str(p) for p in parts])
    h = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + F.lit(0.5)) / F.lit(TWO_POW_52)


def uniform_sql(*parts: str) -> str:
    """DuckDB/ANSI text of the same uniform; parts are SQL expressions."""
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / {TWO_POW_52})"


def race_key(u: Column, weight: Column) -> Column:
    """Exponential race key -ln(u)/w: the n smallest keys are a weighted
    sample without replacement (successive draws with probability ∝ w).
    Rows with null or non-positive weight get a null key and are never drawn."""
    return F.when(weight > 0, -F.log(u) / weight)
