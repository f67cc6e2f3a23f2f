"""Select labelled rows and shape them for a sequence learner."""
from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain_prefix, snake_lower, truncate_tokens, whitespace_tokens

log = logging.getLogger(__name__)

START_SYMBOL = "@start@"
END_SYMBOL = "@end@"


def select_split(assignments: DataFrame, pool: DataFrame, id_col: str, split: str | None,
                 label: int | None, columns=("question", "query")) -> DataFrame:
    """Rows of one split with one label (1 train, 2 dev), projected to
    (id, question, program).  Only one of split/label given: warning; the
    filter applies only when the split name is set, and a name without a
    value matches nothing (as comparing with None does)."""
    if (split is None) != (label is None):
        log.warning("condition needs both a split name and a label value")
    if split is None:
        return pool.select(id_col, *columns)
    chosen = assignments.where((F.col("split_name") == split) & (F.col("label") == F.lit(label)))
    return pool.join(chosen.select(id_col), id_col, "left_semi").select(id_col, *columns)


def select_split_wide(wide: DataFrame, id_col: str, split: str, label: int, columns=("question", "query")):
    """Same on the wide table (one label column per split)."""
    return wide.where(F.col(f"`{split}`") == label).select(id_col, *columns)


def drop_empty_source(df: DataFrame, source_col: str = "question") -> DataFrame:
    """Rows with a non-empty source; a null target stays null ("no target")."""
    return df.where(F.length(F.col(source_col)) > 0)


def debug_limit(df: DataFrame, order_col: str, rows: int = 1001) -> DataFrame:
    """The reader's debug mode: the first 1,001 rows (in ``order_col`` order)."""
    return df.orderBy(order_col).limit(rows)


def instances(df: DataFrame, id_col: str = "example_id", source_col: str = "question",
              target_col: str | None = "query", source_max: int | None = None, target_max: int | None = None,
              lower: bool = False, add_domain: bool = False, start: str = START_SYMBOL, end: str = END_SYMBOL,
              add_start: bool = True, add_end: bool = True) -> DataFrame:
    """(id, source_tokens, target_tokens, source_truncated, target_truncated).

    Source: lower-cased if ``lower``; domain marker prepended if
    ``add_domain``; whitespace tokens cut to ``source_max``; then markers.
    Target (null stays null): ``snake_lower`` if ``lower``; same cut.
    """
    src = F.col(source_col)
    if lower:
        src = F.lower(src)
    if add_domain:
        src = domain_prefix(F.col(id_col), src)
    s_tok = whitespace_tokens(src)
    out = df.select(
        F.col(id_col),
        truncate_tokens(s_tok, source_max, start if add_start else None, end if add_end else None)
        .alias("source_tokens"),
        ((F.size(s_tok) > source_max) if source_max else F.lit(False)).alias("source_truncated"),
        *([] if target_col is None else [
            F.when(F.col(target_col).isNotNull(), truncate_tokens(
                whitespace_tokens(snake_lower(F.col(target_col)) if lower else F.col(target_col)),
                target_max, start if add_start else None, end if add_end else None)).alias("target_tokens"),
            (F.col(target_col).isNotNull() & (F.size(whitespace_tokens(F.col(target_col))) > target_max)
             if target_max else F.lit(False)).alias("target_truncated")]))
    return out


def truncation_counts(inst: DataFrame) -> DataFrame:
    """One row: instances whose source / target exceeded the max length."""
    cols = [F.sum(F.col("source_truncated").cast("long")).alias("source_exceeded")]
    if "target_truncated" in inst.columns:
        cols.append(F.sum(F.col("target_truncated").cast("long")).alias("target_exceeded"))
    return inst.agg(*cols)
