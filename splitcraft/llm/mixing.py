"""Mixing sources to target weights, by DataFrame functions alone.

**Temperature.**  A source with the share ``p`` of all tokens gets the weight
``p^a / sum(p^a)``: 1 keeps the shares, 0 makes all sources equal.  The exponent
is bisected: the weights' entropy falls as it grows and so does the number of
passes over the smallest source against the largest one.  Each step sums up the
sources for a grid of exponents at once (the sums of a few numbers for each
exponent are all that the driver sees) and goes on in the interval where the
target is met.

**Budget.**  The weights are shares of a budget of tokens.  By default it is the
least with which no source loses a row: the least repeated source is read once.

**Block permutations.**  Every pass over a source is a permutation of its rows by
a hash of key and pass.  Rows are taken in that order while the pass has room in
the source's budget; the last pass stops at it.  A row's place within its
source's budget gives its block, so each of the ``blocks`` parts of the mixture
has every source by its weight, and a hash permutes the rows of a block.  Places
come from sums by source, pass and slice of the hash, so that a source with a
third of all rows is in many tasks.

Tokens are words between white space, 1 at least.  Null sources form the source
``''``.  Rows with equal ids are ordered by their texts' hash.  A budget of 0
gives no rows, an empty table an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitcraft.llm.common import row_key, stored, table

GRID, STEPS = 16, 12
#: Rows in a slice of a source's pass on average at most, and slices at least.
SLICE_ROWS, SLICES = 4096, 16


def sources(rows: DataFrame) -> DataFrame:
    """``source, tokens, n``."""
    return rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def bisect(shares: DataFrame, met) -> float:
    """The least exponent in 0 to 1 for which ``met(Z, S, low, high)`` holds,
    1 if it holds for none; ``met`` has to turn true once as the exponent grows.
    ``Z`` is the sum of ``p^a``, ``S`` the weights' entropy, ``low`` and
    ``high`` are the least and the greatest number of passes per token of budget."""
    at, width = 0.0, 1.0
    for _ in range(STEPS):
        grid = [at + width * i / GRID for i in range(GRID + 1)]
        a, w = F.col("a"), F.exp(F.col("a") * F.log("p"))
        sums = (shares.withColumn("a", F.explode(F.array(*map(F.lit, grid))))
                .groupBy("a").agg(F.sum(w).alias("z"), F.sum(a * F.log("p") * w).alias("l"),
                                  F.min((a - 1) * F.log("p")).alias("low"), F.max((a - 1) * F.log("p")).alias("high")))
        points = {r["a"]: (r["z"], math.log(r["z"]) - r["l"] / r["z"], math.exp(r["low"]), math.exp(r["high"])) for r in sums.collect()}
        good = [x for x in grid if x in points and met(*points[x])]
        if not good:
            return 1.0
        if good[0] == grid[0]:
            return good[0]
        at, width = max(x for x in grid if x < good[0]), width / GRID
    return good[0]


def weights(per_source: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> tuple[DataFrame, float]:
    """``source, tokens, n, weight, goal`` and the exponent.  ``entropy`` is the
    target as a share of the greatest possible one (the log of the number of
    sources): the exponent at which the entropy has come down to it.
    ``repeats`` is the limit on passes over any source: the least exponent that
    keeps it.  With both, the greater exponent.  ``goal`` is the source's
    tokens in the mixture."""
    totals = per_source.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    total, count = totals["tokens"] or 0, totals["n"]
    if not total:
        return per_source.withColumns({"weight": F.lit(None).cast("double"), "goal": F.lit(0).cast("long")}), 1.0
    shares = per_source.withColumn("p", F.col("tokens") / F.lit(float(total)))
    exponent = 0.0
    if entropy is not None:
        aim = entropy * math.log(count)
        exponent = max(exponent, bisect(shares, lambda z, s, low, high: s <= aim + 1e-12))
    if repeats is not None:
        # passes over a source: weight * budget / tokens; the budget by default makes the least one 1
        passes = (lambda z, low, high: high / low) if budget is None else (lambda z, low, high: high / z * budget / total)
        exponent = max(exponent, bisect(shares, lambda z, s, low, high: passes(z, low, high) <= repeats + 1e-12))
    if entropy is None and repeats is None:
        exponent = 1.0
    power = F.exp(F.lit(exponent) * F.log("p"))
    z, low = shares.agg(F.sum(power), F.min((F.lit(exponent) - 1) * F.log("p"))).first()
    full = budget if budget is not None else math.ceil(total * z / math.exp(low) - 1e-6)
    weighted = shares.withColumn("weight", power / F.lit(z)).withColumn(
        "goal", F.greatest(F.floor(F.col("weight") * F.lit(float(full)) + 1e-6), F.lit(0)).cast("long"))
    if budget is None:  # rounding takes nothing away
        weighted = weighted.withColumn("goal", F.greatest("goal", "tokens"))
    return weighted.drop("p"), exponent


def mixture(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None,
            blocks: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``key, doc_id, source, pass, tokens, weight, block, place``: one row for
    each time that a document is taken.  ``place`` orders a block, ``key`` and
    ``doc_id`` lead back to the document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")
    rows = stored(docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                              F.coalesce(F.col(source_col), F.lit("")).alias("source"), words.alias("tokens")), "mixing")
    per_source = stored(sources(rows), "sources")
    weighted, _ = weights(per_source, entropy, repeats, budget)
    # slices of a pass, the more the larger the source
    goals = stored(weighted.withColumn("slices", F.greatest(F.ceil(F.col("n") / SLICE_ROWS), F.lit(SLICES)).cast("long"))
                   .withColumn("passes", F.ceil(F.col("goal") / F.col("tokens")).cast("int")).where("goal > 0"), "goals")
    plan = goals.select("source", "weight", "goal", "slices", "passes", F.col("tokens").alias("source_tokens"))
    salts = 32
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    taken = (rows.withColumn("salt", F.pmod("key", F.lit(salts)).cast("int")).join(salted, ["source", "salt"]).drop("salt")
             .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
             .withColumn("mixed", F.xxhash64("key", "pass", F.lit(seed)))
             .withColumn("slice", F.pmod(F.col("mixed"), F.col("slices"))))
    # what the slices before take up, counted before rows are numbered
    before = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (taken.groupBy("source", "pass", "slice").agg(F.sum("tokens").alias("filled"))
               .select("source", "pass", "slice", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("source", "pass", "slice").orderBy("mixed", "key").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("pass") * F.col("source_tokens") + F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return (taken.join(offsets, ["source", "pass", "slice"]).withColumn("begin", place).where("begin < goal")
            .select("key", "doc_id", "source", "pass", "tokens", "weight",
                    F.expr(f"cast(begin * {blocks} div goal as int)").alias("block"),
                    F.xxhash64("mixed", F.lit("block")).alias("place")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **target) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken.  Rows with one id and
    text share their passes: where the last pass takes one of them, all are."""
    picked = (mixture(docs, id_col=id_col, text_col=text_col, **target).groupBy("key", "pass").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("key").agg(F.count(F.lit(1)).alias("_llm_times")).withColumnRenamed("key", "_llm_key"))
    return (docs.withColumn("_llm_key", row_key(id_col, text_col)).join(picked, "_llm_key").withColumn("_llm_pass", F.explode(F.sequence(F.lit(1), F.col("_llm_times"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


#: Targets of the registered query: nearly even sources, none read more than four times.
ENTROPY, REPEATS = 0.97, 4.0


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source, with the least budget that reads
    every document once; smaller sources are read again, so there are more rows
    than documents."""
    docs = table(spark, sf_dir, "documents")
    return mixture(docs, entropy=ENTROPY, repeats=REPEATS).select("doc_id", "source", "pass", "tokens", "weight", "block", "place")
