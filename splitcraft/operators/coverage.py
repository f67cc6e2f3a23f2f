"""Vocabulary coverage between evaluation and training rows.

A dev (or test) row is dropped when its program uses a property or an
operator that no train row of the same split uses.  Everything is computed
for all splits at once, keyed by the split columns:

  vocab(rows)   explode the per-row vocabulary (``program_vocab``) -> distinct
  missing       vocab(dev) left_anti vocab(train)
  removal       a dev row is dropped when `` strip(tok) `` occurs in its
                program for some missing tok of its split

The missing tokens of a group are few against its rows.  They are written and
measured; up to a stated number each group's tokens travel as one array to the
rows, which are tested where they lie: with the program split on single spaces
into e_0..e_k, `` tok `` occurs in it exactly when tok is one of e_1..e_(k-1).  No
word is exploded or shuffled.  Tokens with inner spaces (only the ``org.schema.``
dots can match one) are looked for as strings.

Beyond that number the test is an equi-join on (group, run of interior words);
tokens hold at most two spaces, so runs of 1-3 words cover every case.  AQE splits
skewed partitions.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import program_vocab
from ..session import materialize
from .joins import BROADCAST_CHARS, BROADCAST_ROWS

MAX_TOKEN_WORDS = 3
#: Missing tokens of one group up to which its rows are tested in place.
IN_PLACE_TOKENS = 1000


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def with_vocab(df: DataFrame, program_col: str, vocab_col: str = "vocab") -> DataFrame:
    return df.withColumn(vocab_col, program_vocab(F.col(program_col)))


def vocab_table(rows: DataFrame, group_cols: list[str], vocab_col: str = "vocab") -> DataFrame:
    """Distinct (group..., tok) over the rows' vocabularies."""
    # a plain explode() makes Spark ask for the array's size and nullness first,
    # which computes the vocabulary three times
    return rows.select(*group_cols, F.explode_outer(vocab_col).alias("tok")).where(F.col("tok").isNotNull()).distinct()


def missing_tokens(dev: DataFrame, train: DataFrame, group_cols: list[str],
                   vocab_col: str = "vocab") -> DataFrame:
    """Tokens used by dev rows but by no train row of the same group."""
    return vocab_table(dev, group_cols, vocab_col).join(
        vocab_table(train, group_cols, vocab_col), group_cols + ["tok"], "left_anti")


def _run_of(e, m: int):
    # a one-argument lambda: transform() would pass an index as 2nd argument
    return lambda j: F.array_join(F.slice(e, j, m), " ")


def interior_runs(program, max_words: int = MAX_TOKEN_WORDS) -> F.Column:
    """All runs of 1..max_words consecutive interior words of
    ``split(program, ' ')``, joined by single spaces."""
    e = F.split(program, " ", -1)
    n = F.size(e)
    if max_words == 1:
        return F.array_distinct(F.when(n >= 3, F.slice(e, 2, n - 2)).otherwise(F.array().cast("array<string>")))
    runs = []
    for m in range(1, max_words + 1):
        # 1-based start j in [2, n - m]
        seq = F.when(n - m >= 2, F.sequence(F.lit(2), n - m)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(seq, _run_of(e, m)))
    return F.array_distinct(F.concat(*runs))


def rows_without_tokens(df: DataFrame, tokens: DataFrame, group_cols: list[str], id_col: str, program_col: str,
                        vocab_col: str | None = None) -> DataFrame:
    """Rows of ``df`` that hold no token of their group (``tokens``: group...,
    tok): `` strip(tok) `` doesn't occur in the program or, with ``vocab_col``, tok
    is no member of that array.  Rows of a null group, a null program or a null
    array stay.  Each row is judged on its own, also where ids repeat."""
    run = F.col("tok") if vocab_col else _strip(F.col("tok"))
    toks = materialize(tokens.select(*group_cols, run.alias("_run")).distinct())
    most, n, chars = (toks.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("_run")).alias("s"))
                      .agg(F.max("c"), F.sum("c"), F.sum("s")).first())
    if not n:
        return df
    columns = [F.col(f"`{c}`") for c in df.columns]
    spaced = F.instr(F.col("_run"), " ") > 0
    if most <= IN_PLACE_TOKENS and n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        one = F.lit(True) if vocab_col else ~spaced
        lists = toks.groupBy(*group_cols).agg(F.collect_list(F.when(one, F.col("_run"))).alias("_one"),
                                              F.collect_list(F.when(~one, F.col("_run"))).alias("_many"))
        words = F.split(program_col, " ", -1)
        inner = F.col(vocab_col) if vocab_col else F.when(F.size(words) >= 3, F.slice(words, 2, F.size(words) - 2))
        hit = (F.coalesce(F.arrays_overlap(inner, "_one"), F.lit(False))
               | F.coalesce(F.exists("_many", lambda t: F.instr(F.col(program_col), F.concat(F.lit(" "), t, F.lit(" "))) > 0), F.lit(False)))
        return df.join(F.broadcast(lists), group_cols, "left").where(~hit).select(*columns)
    keyed = df.withColumn("_row", F.xxhash64(id_col, program_col))
    if vocab_col:
        held = F.col(vocab_col)
    else:  # runs of several words are needed only for tokens with inner spaces
        held = interior_runs(F.col(program_col), MAX_TOKEN_WORDS if toks.where(spaced).limit(1).count() else 1)
    runs = keyed.select(*group_cols, "_row", F.explode_outer(held).alias("_run")).where(F.col("_run").isNotNull())
    bad = runs.join(toks, group_cols + ["_run"], "left_semi").select(*group_cols, "_row").distinct()
    return keyed.join(bad, group_cols + ["_row"], "left_anti").select(*columns)


def remove_by_token(df: DataFrame, token: str, program_col: str, id_col: str) -> DataFrame:
    """Drop rows whose program contains `` token.strip() `` (literal)."""
    needle = f" {token.strip()} "
    return df.where(F.instr(F.col(program_col), needle) == 0)


def drop_uncovered(eval_rows: DataFrame, train_vocab: DataFrame, group_cols: list[str],
                   join_cols: list[str], id_col: str, program_col: str,
                   vocab_col: str = "vocab", strict: bool = False) -> DataFrame:
    """Drop evaluation rows that contain `` strip(tok) `` for a token used by
    their evaluation group but absent from ``train_vocab`` (join_cols..., tok);
    with ``strict`` those whose own vocabulary holds such a token."""
    missing = vocab_table(eval_rows, group_cols, vocab_col).join(train_vocab, join_cols + ["tok"], "left_anti")
    return rows_without_tokens(eval_rows, missing, group_cols, id_col, program_col, vocab_col if strict else None)


def validate_and_fix(labeled: DataFrame, group_cols: list[str], id_col: str, program_col: str,
                     label_col: str = "label", train_label: int = 1, eval_label: int = 2,
                     vocab_col: str = "vocab", strict: bool = False) -> DataFrame:
    """Drop evaluation rows (label == eval_label) that use a token unseen in
    the train rows (label == train_label) of their group.  Dropped rows leave
    the output (they get no label); train rows pass unchanged.

    By default a row goes if `` strip(tok) `` occurs in its program, so a member
    that begins with a bracket, or an enum, which no blanks need to surround, can
    stay.  With ``strict`` a row goes if its own vocabulary holds the token: what
    the evaluation rows use is then part of what the train rows use."""
    # kept for the branches below, without the vocabulary, which is larger than the row
    # and which each branch computes for its own rows
    labeled = labeled.persist(StorageLevel.MEMORY_AND_DISK)
    if vocab_col not in labeled.columns:
        labeled = with_vocab(labeled, program_col, vocab_col)
    train = labeled.where(F.col(label_col) == train_label)
    dev = labeled.where(F.col(label_col) == eval_label)
    kept = drop_uncovered(dev, vocab_table(train, group_cols, vocab_col), group_cols, group_cols,
                          id_col, program_col, vocab_col, strict)
    return train.unionByName(kept)


def split_coverage(labeled: DataFrame, group_cols: list[str], program_col: str,
                   label_col: str = "label", train_label: int = 1, eval_label: int = 2,
                   vocab_col: str = "vocab") -> DataFrame:
    """Per group: missing tokens (long form: group..., tok, kind) where kind
    is 'operator' or 'property'."""
    from ..functions.vocab import OPERATORS
    if vocab_col not in labeled.columns:
        labeled = with_vocab(labeled, program_col, vocab_col)
    missing = missing_tokens(labeled.where(F.col(label_col) == eval_label),
                             labeled.where(F.col(label_col) == train_label), group_cols, vocab_col)
    ops = F.array(*[F.lit(o) for o in OPERATORS])
    return missing.withColumn("kind", F.when(F.array_contains(ops, F.col("tok")), "operator")
                                       .otherwise("property"))


def coverage_flags(labeled: DataFrame, group_cols: list[str], program_col: str, **kw) -> DataFrame:
    """(group..., ok, n_missing): ok when the evaluation vocabulary is a subset
    of the train vocabulary."""
    groups = labeled.select(*group_cols).distinct()
    miss = split_coverage(labeled, group_cols, program_col, **kw).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_missing"))
    return (groups.join(miss, group_cols, "left")
                  .select(*group_cols, F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
                  .withColumn("ok", F.col("n_missing") == 0))
