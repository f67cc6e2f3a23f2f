"""Scoring predicted token/id sequences against gold, at table scale.

All metrics are column expressions plus distributed aggregates; nothing is
collected per example.  Corpus metrics end in one-row DataFrames.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import named_once

PAD = "@@PADDING@@"


def exact_match(gold, predicted) -> F.Column:
    """gold without its first and last token == predicted without its last
    token (the last predicted token is dropped even when it is no end
    marker)."""
    g, p = F.col(gold) if isinstance(gold, str) else gold, F.col(predicted) if isinstance(predicted, str) else predicted
    return F.slice(g, 2, F.greatest(F.size(g) - 2, F.lit(0))).eqNullSafe(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))))


def attach_gold(predictions: DataFrame, gold: DataFrame, id_col: str = "example_id", how: str = "left") -> DataFrame:
    """Pair predictions with gold by id (replaces positional pairing)."""
    return predictions.join(gold, id_col, how)


def paraphrase_filter(predictions: DataFrame, pool: DataFrame, id_col: str = "example_id",
                      gold_col: str = "gold_tokens", pred_col: str = "predicted_tokens") -> DataFrame:
    """Keep pool rows whose prediction is an exact match (only the id and the
    ``correct`` flag travel, as for millions of instances)."""
    flags = predictions.select(id_col, exact_match(gold_col, pred_col).alias("correct"))
    return pool.join(flags.where("correct"), id_col, "left_semi")


def sequence_accuracy(df: DataFrame, gold_col: str, pred_col: str, mask_col: str | None = None,
                      pad=PAD, shift_gold: bool = True) -> DataFrame:
    """Share of rows whose prediction equals gold on every unmasked gold
    position; a short prediction is right-padded with ``pad`` and a long one
    cut to gold length.  Gold (and mask) drop their first element when
    ``shift_gold`` (the start marker).  0.0 when there are no rows."""
    g = F.col(gold_col)
    m = F.col(mask_col) if mask_col else None
    if shift_gold:
        g = F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
        if m is not None:
            m = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))
    p = F.col(pred_col)

    def ok(x, i):
        same = F.coalesce(F.get(p, i), F.lit(pad)) == x
        return same if m is None else (F.get(m, i) == 0) | same

    row_ok = F.forall(F.transform(g, ok), lambda b: b)
    counted = F.lit(True) if m is None else F.exists(m, lambda v: v != 0)
    return df.where(counted).agg(F.coalesce(F.avg(row_ok.cast("double")), F.lit(0.0)).alias("id_seq_acc"))


def best_candidate(candidates: DataFrame, id_col: str = "example_id") -> DataFrame:
    """Per example the candidate with the highest log-probability (ties: the
    lowest rank), as (id, rank, token_ids, log_prob)."""
    best = candidates.groupBy(id_col).agg(F.max_by(
        F.struct("rank", "token_ids", "log_prob"),
        F.struct(F.col("log_prob"), -F.col("rank"))).alias("b"))
    return best.select(id_col, "b.rank", "b.token_ids", "b.log_prob")


def truncate_at_eos(ids, eos: int = 2) -> F.Column:
    """Ids up to and including the first ``eos``; all ids when none."""
    c = F.col(ids) if isinstance(ids, str) else ids
    pos = F.array_position(c, eos)
    return F.when(pos > 0, F.slice(c, 1, pos.cast("int"))).otherwise(c)


def _strip_ids(c, exclude):
    return F.filter(c, lambda x: ~x.isin(*exclude)) if exclude else c


def _make_lcs_udf():
    """Arrow function of gold and predicted ids: the length of their longest common
    subsequence.  Built from nested functions, so it is pickled by value and
    Python workers need no import of this package."""

    def lcs_bits(a, b) -> int:
        # bit-parallel: one big-int step per element of a
        if len(a) == 0 or len(b) == 0:
            return 0
        masks = {}
        for j, x in enumerate(b):
            masks[x] = masks.get(x, 0) | (1 << j)
        full = (1 << len(b)) - 1
        v = full
        for x in a:
            u = v & masks.get(x, 0)
            v = ((v + u) | (v - u)) & full
        return len(b) - bin(v).count("1")

    def lengths(gold, pred):
        import pandas as pd

        return pd.Series([lcs_bits(p, g) for g, p in zip(gold, pred)], dtype="int64")

    return lcs_bits, F.pandas_udf(lengths, T.LongType())


_lcs_bits, _lcs_length = _make_lcs_udf()


def _longer_grams(grams: str, units: str, n: int) -> F.Column:
    """The n-grams of an array of strings none of which is the prefix of another,
    each put together to one string, from its (n - 1)-grams."""
    most = F.greatest(F.size(grams) - 1, F.lit(0))
    return F.transform(F.slice(grams, F.lit(1), most), lambda x, i: F.concat(x, F.get(units, i + (n - 1))))


def _told_apart(grams: str) -> F.Column:
    """The same with repeated n-grams numbered, so that the intersection of two
    such arrays has the size of the clipped match."""
    def numbered(ordered):
        def name(x, i):  # equal ones stand side by side: the distance to the first is the number
            return F.concat(F.lit("#"), (i + 1 - F.array_position(ordered, x)).cast("string"), F.lit("#"), x)
        return F.transform(ordered, name)

    alone = F.size(F.array_distinct(grams)) == F.size(grams)
    return F.when(alone, F.transform(grams, lambda x: F.concat(F.lit("#0#"), x))).otherwise(named_once(F.sort_array(grams), numbered))


def _overlaps(df: DataFrame, gold_col: str, pred_col: str, exclude, max_n: int, lcs: bool) -> DataFrame:
    """Per row of ``df`` the lengths ``lg`` and ``lp``, the clipped n-gram matches
    ``m1``... and with ``lcs`` the longest common subsequence, in one narrow pass.
    Matches are native array functions; Python runs for the subsequence only.
    Where both sides are equal all n-grams match, and none is put together."""
    sides = df.select(_strip_ids(F.col(gold_col), exclude).alias("g"), _strip_ids(F.col(pred_col), exclude).alias("p"))
    kinds = {f.name: f.dataType for f in sides.schema}
    sides = sides.select(*[F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) for c in "gp"])
    whole = all(isinstance(k.elementType, T.IntegralType) for k in kinds.values())

    def unit(x):
        """A whole number with a comma, any other id with its length in front; a
        null one equals a null one."""
        x = x.cast("string")
        return F.coalesce(F.concat(x, F.lit(",")) if whole else F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("~"))

    rows = sides.withColumns({f"a{c}": F.transform(c, unit) for c in "gp"}).withColumn("same", F.col("ag") == F.col("ap"))
    rows = rows.withColumns({f"u{c}": F.when(F.col("same"), F.array().cast("array<string>")).otherwise(F.col(f"a{c}")) for c in "gp"})
    found = [F.size("g").cast("long").alias("lg"), F.size("p").cast("long").alias("lp")]
    ns = range(1, max_n + 1)
    rows = rows.withColumns({f"{c}1": F.col(f"u{c}") for c in "gp"})
    for n in ns[1:]:
        rows = rows.withColumns({f"{c}{n}": _longer_grams(f"{c}{n - 1}", f"u{c}", n) for c in "gp"})
    rows = rows.withColumns({f"{c}{n}": _told_apart(f"{c}{n}") for c in "gp" for n in ns})
    found += [F.when(F.col("same"), F.greatest(F.size("g") - (n - 1), F.lit(0))).otherwise(F.size(F.array_intersect(f"g{n}", f"p{n}")))
              .cast("long").alias(f"m{n}") for n in ns]
    if lcs:
        # a null id (and a NaN) is part of no common subsequence
        plain = all(isinstance(k.elementType, (T.IntegralType, T.StringType)) for k in kinds.values())
        alike = F.col("same") & ~F.array_contains("ag", "~") if plain else F.lit(False)
        differ = lambda c: F.when(alike, F.array().cast(kinds[c])).otherwise(F.col(c))
        found.append(F.when(alike, F.size("g").cast("long")).otherwise(_lcs_length(differ("g"), differ("p"))).alias("lcs"))
    return rows.select(*found)


def bleu(df: DataFrame, gold_col: str, pred_col: str, id_col: str | None = None, exclude=(), max_n: int = 4) -> DataFrame:
    """Corpus BLEU (uniform weights over 1..max_n grams, clipped counts,
    brevity penalty on corpus lengths, 1e-13 smoothing inside the logs).  Each
    row is counted on its own (ids may repeat); the only exchange is that of the
    final sums."""
    rows = _overlaps(df, gold_col, pred_col, exclude, max_n, False)
    total = lambda n: F.greatest(F.col("lp") - (n - 1), F.lit(0))
    stats = rows.agg(F.sum("lp").alias("plen"), F.sum("lg").alias("rlen"),
                     *[F.coalesce(F.sum(f"m{n}"), F.lit(0)).alias(f"m{n}") for n in range(1, max_n + 1)],
                     *[F.coalesce(F.sum(total(n)), F.lit(0)).alias(f"t{n}") for n in range(1, max_n + 1)])
    w = 1.0 / max_n
    score = sum(w * (F.log(F.col(f"m{n}") + 1e-13) - F.log(F.col(f"t{n}") + 1e-13)) for n in range(1, max_n + 1))
    bp = (F.when(F.col("plen") > F.col("rlen"), 1.0)
           .when((F.col("rlen") == 0) | (F.col("plen") == 0), 0.0)
           .otherwise(F.exp(1.0 - F.col("rlen") / F.col("plen"))))
    return stats.select(F.round(bp * F.exp(score), 9).alias("bleu"))


def rouge(df: DataFrame, gold_col: str, pred_col: str, id_col: str | None = None, exclude=()) -> DataFrame:
    """ROUGE-1, ROUGE-2 (per-row n-gram F1) and ROUGE-L (per-row LCS F1),
    each averaged over rows, in one pass."""
    rows = _overlaps(df, gold_col, pred_col, exclude, 2, True)

    def f1(match, tp, tr):
        match = match.cast("double")
        prec = F.when(tp > 0, match / tp).otherwise(0.0)
        rec = F.when(tr > 0, match / tr).otherwise(0.0)
        return F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)

    grams = lambda c, n: F.greatest(F.col(c) - n + 1, F.lit(0)).cast("double")
    r1, r2 = (f1(F.col(f"m{n}"), grams("lp", n), grams("lg", n)) for n in (1, 2))
    rl = f1(F.col("lcs"), grams("lp", 1), grams("lg", 1))
    return rows.agg(F.round(F.coalesce(F.avg(r1), F.lit(0.0)), 9).alias("rouge_1"),
                    F.round(F.coalesce(F.avg(r2), F.lit(0.0)), 9).alias("rouge_2"),
                    F.round(F.coalesce(F.avg(rl), F.lit(0.0)), 9).alias("rouge_l"))
