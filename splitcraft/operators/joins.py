"""Joins of row-level tables with template-level ones.

A template holds a large share of all rows, so shuffling the rows on it puts
that share into one task.  The template side is written first and measured:
up to a stated size it is sent to all tasks and the rows stay where they are;
beyond it both sides get a salt, so that a template's rows are dealt to many
tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows and characters of keys up to which the template side is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32_000_000
SALTS = 64


def template_join(rows: DataFrame, templates: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``templates`` (one row per key) on ``keys``;
    ``how`` is inner, left, left_semi or left_anti."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    templates = materialize(templates)
    chars = sum((F.coalesce(F.length(k), F.lit(0)) for k in keys[1:]), F.coalesce(F.length(keys[0]), F.lit(0)))
    n, size = templates.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_CHARS:
        return rows.join(F.broadcast(templates), keys, how)
    columns = rows.columns
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(SALTS)).cast("int"))
    spread = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
