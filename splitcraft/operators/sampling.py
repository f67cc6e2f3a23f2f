"""Seeded, reproducible samplers.

All randomness comes from ``functions.hashing.uniform`` (md5 of id, seed,
split name and a salt), so a sample is a pure function of its inputs: the
same on 1 or 1,000 executors, after task retries or lost executors, and in
DuckDB.

Weighted sampling without replacement uses exponential race keys
``-ln(u)/w``: the n smallest keys of a split are distributed exactly as n
successive draws with probability proportional to w.

Scale plan for "n smallest keys per split" (``smallest_n``):
  1. an analytic threshold t per split such that the expected number of
     keys below t is n + 4*sqrt(n) + 8.  It is computed from a weight
     summary (one row per distinct weight), never from the rows themselves;
  2. one pass over the (row x split) keys keeps only key <= t; survivors
     (about n + 4 sqrt(n) plus at most 4.4 %) are the only rows that get
     shuffled;
  3. survivors are counted per split; a split that takes its whole pool needs
     no ranking; the rare split with fewer survivors than needed, one whose cut
     was not found, and one of more than ``RANKED_ROWS`` rows gets its exact cut
     by selection (``grouped_cut``), so the result is exact;
  4. exact ``row_number`` over (split order by key, id) on the other survivors.
A rank window therefore holds O(n) rows (n is the requested sample size, at most
``RANKED_ROWS``), independent of the pool size.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import race_key, uniform
from ..session import materialize
from .joins import template_join

MARGIN_SIGMAS = 4.0
#: Rows of a sample that one task ranks; larger samples are cut by selection.
RANKED_ROWS = 1_000_000
#: Rows of a scan that one task works on where the work per row is heavy.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition on ``key`` into parts of about ``SPREAD_ROWS`` rows, at
    least one for each core, unless the scan deals the rows that evenly.
    CPU-heavy per-row work (regex chains) then uses every core, and no task grows
    with the input.  The number of a scan's partitions doesn't tell: a row group is
    read by one task, and the splits of a file between its row groups' middles are
    empty, so the rows of each are counted (which reads no column)."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # sessions without a driver-side context: leave the layout to Spark
        return df
    if df.isStreaming:
        return df
    held = df.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    most, rows = held.agg(F.max("_rows"), F.sum("_rows")).first()
    if not rows or most <= min(SPREAD_ROWS, max(rows * 3 // (2 * cores), 1)):
        return df
    return df.repartition(max(cores, -(-rows // SPREAD_ROWS)), key)


def specs_array(specs: list[dict]) -> Column:
    """Literal array<struct> of sampling specs, to be exploded per row."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in specs])


def race_thresholds(summary: DataFrame, group_cols: list[str], n_col: str = "n",
                    w_col: str = "w", cnt_col: str = "cnt", small_groups: bool = True) -> DataFrame:
    """Per group: a key threshold t with E[#keys <= t] >= n + 4 sqrt(n) + 8.

    ``summary`` has one row per (group, weight class): ``cnt`` rows share
    weight ``w``; E(t) = sum cnt * (1 - exp(-w t)).  Since E(t) <= t * W,
    the search starts at t0 = m / W: a coarse grid t0 * 2^k (k < 24) finds
    the doubling that reaches the target, a fine grid of 16 steps inside it
    picks t (at most 4.4 % above the smallest grid point that suffices).
    Both are exploded single-sum aggregates over the distinct weights of a
    group.  A null threshold means "no cut" (the group needs all its rows,
    or the grid did not reach the target).  ``small_groups``: one row per
    group is bounded by a parameter (e.g. one per sampling spec) and is
    broadcast; otherwise (e.g. one per template) AQE picks the joins.
    """
    def bc(df):
        return F.broadcast(df) if small_groups else df

    s = (summary.where(F.col(w_col) > 0)
                .groupBy(*group_cols, F.col(w_col).alias("_w"))
                .agg(F.sum(cnt_col).alias("_cnt"), F.max(n_col).alias("_n")))
    tot = (s.groupBy(*group_cols)
            .agg(F.sum(F.col("_w") * F.col("_cnt")).alias("_W"), F.sum("_cnt").alias("_npos"),
                 F.max("_n").alias("_n")))
    tot = (tot.withColumn("_m", F.col("_n") + MARGIN_SIGMAS * F.sqrt(F.col("_n")) + 8.0)
              .withColumn("_t0", F.col("_m") / F.col("_W")))
    base = s.select(*group_cols, "_w", "_cnt").join(bc(tot.select(*group_cols, "_t0", "_m")), group_cols)

    def first_reaching(frame, grid_col):
        e = (frame.groupBy(*group_cols, "_step", grid_col, "_m")
                  .agg(F.sum(F.col("_cnt") * (1.0 - F.exp(-F.col("_w") * F.col(grid_col)))).alias("_e")))
        return (e.where(F.col("_e") >= F.col("_m")).groupBy(*group_cols)
                 .agg(F.min(F.struct("_step", grid_col)).alias("_hit"))
                 .select(*group_cols, F.col(f"_hit.{grid_col}").alias(grid_col)))

    coarse = base.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(23)))) \
                 .withColumn("_tc", F.col("_t0") * F.pow(F.lit(2.0), F.col("_step")))
    hit = first_reaching(coarse, "_tc")
    fine = (base.join(bc(hit), group_cols)
                .withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(16))))
                .withColumn("_tf", F.col("_tc") / 2.0 * F.pow(F.lit(2.0), F.col("_step") / 16.0)))
    t = first_reaching(fine, "_tf")
    out = tot.join(t, group_cols, "left")
    return out.select(*group_cols,
                      F.when(F.col("_m") < F.col("_npos"), F.col("_tf")).alias("threshold"),
                      F.col("_n").alias("need"), F.col("_npos").alias("available"))


def id_text(df: DataFrame, id_col: str) -> Column:
    """The id as text in the id's own order (whole numbers get leading zeros)."""
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.col(id_col).cast("string")


def grouped_cut(keyed: DataFrame, group_cols: list[str], key_col: str, id_col: str, n_col: str, bins: int = 256) -> DataFrame:
    """(group..., cut_key, cut_id): the ``n``-th smallest (key, id) of every group
    that has more rows; ``cut_id`` is the id as ``id_text`` gives it.

    Selection for all groups at once: a round counts the remaining rows of each
    group in ``bins`` slices between its least and greatest key and goes on with
    the slice that holds the n-th, by that slice's own least and greatest key.
    Where all remaining keys are equal, the ids decide, one sign after the
    common beginning at a time.  A round is one aggregate; no group's rows are
    ever ranked or read in one place, and no keys come to the driver."""
    rows = materialize(keyed.select(*group_cols, F.col(key_col).cast("double").alias("_k"), id_text(keyed, id_col).alias("_t"),
                                    F.col(n_col).cast("long").alias("_need")).where(F.col("_k").isNotNull()))

    def chosen(hist: DataFrame, by: str) -> DataFrame:
        """Of each group the slice with the n-th row; ``_need`` counts on in it."""
        upto = F.sum("_n").over(Window.partitionBy(*group_cols).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        return (hist.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
                    .withColumn("_need", F.col("_need") - F.col("_upto") + F.col("_n")))

    size = F.count(F.lit(1)).alias("_n")
    state = materialize(rows.groupBy(*group_cols).agg(size, F.max("_need").alias("_need"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
                        .where((F.col("_need") > 0) & (F.col("_need") < F.col("_n"))).select(*group_cols, "_need", "_n", "_lo", "_hi"))
    keys = rows.drop("_need")
    while True:
        wide = state.where(F.col("_lo") < F.col("_hi"))
        if wide.limit(1).count() == 0:
            break
        left = template_join(keys, wide.drop("_n"), group_cols).where(F.col("_k").between(F.col("_lo"), F.col("_hi")))
        slice_ = F.least(F.floor((F.col("_k") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        hist = left.groupBy(*group_cols, slice_.alias("_b")).agg(size, F.max("_need").alias("_need"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
        state = materialize(state.where(F.col("_lo") == F.col("_hi")).unionByName(chosen(hist, "_b").select(*state.columns)))
    cuts = state.select(*group_cols, F.col("_lo").alias("cut_key"))
    ties = template_join(keys, state.select(*group_cols, "_need", "_lo"), group_cols).where(F.col("_k") == F.col("_lo")).select(*group_cols, "_t", "_need")
    ids = None
    while True:
        both = ties.groupBy(*group_cols).agg(size, F.max("_need").alias("_need"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        # the longest common beginning of the least and greatest id is that of all
        same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("_lo"), F.lit(1))), lambda i: F.substring("_lo", 1, i) == F.substring("_hi", 1, i)))
        both = materialize(both.withColumn("_p", F.when((F.col("_need") == F.col("_n")) | (F.col("_lo") == F.col("_hi")), 0).otherwise(same + 1)))
        settled = both.where(F.col("_p") == 0).select(*group_cols, F.col("_hi").alias("cut_id"))
        ids = settled if ids is None else ids.unionByName(settled)
        more = both.where(F.col("_p") > 0).select(*group_cols, "_p")
        if more.limit(1).count() == 0:
            break
        ties = template_join(ties, more, group_cols).withColumn("_c", F.expr("substring(_t, _p, 1)"))
        hist = ties.groupBy(*group_cols, "_c").agg(size, F.max("_need").alias("_need"))
        ties = template_join(ties.drop("_need", "_p"), chosen(hist, "_c").select(*group_cols, "_c", "_need"), [*group_cols, "_c"]).drop("_c")
    return cuts.join(ids, group_cols)


def within_cuts(keyed: DataFrame, cuts: DataFrame, group_cols: list[str], key_col: str, id_col: str) -> Column:
    """Condition on ``keyed`` joined with ``cuts`` (left): the row is among its
    group's first; groups without a cut are taken whole."""
    return (F.col("cut_key").isNull() | (F.col(key_col) < F.col("cut_key"))
            | ((F.col(key_col) == F.col("cut_key")) & (id_text(keyed, id_col) <= F.col("cut_id"))))


def first_by_cut(keyed: DataFrame, group_cols: list[str], key_col: str, id_col: str, n_col: str) -> DataFrame:
    """Rows with the ``n`` smallest (key, id) per group, by ``grouped_cut``."""
    cuts = grouped_cut(keyed, group_cols, key_col, id_col, n_col)
    joined = template_join(keyed, cuts, group_cols, "left")
    return joined.where(within_cuts(keyed, cuts, group_cols, key_col, id_col) & (F.col(n_col) > 0)).select(*keyed.columns)


def smallest_n(keyed: DataFrame, group_cols: list[str], key_col: str, id_col: str,
               n_col: str, thresholds: DataFrame | None = None, small_groups: bool = True) -> DataFrame:
    """Rows with the ``n`` smallest ``key`` per group (ties by id); exact.

    ``keyed`` holds one row per (row, group) with a per-group ``n_col``.
    With ``thresholds`` (from ``race_thresholds``) only rows under the
    group's cut are ranked; groups whose cut kept too few rows, or that have
    none, are cut by selection.  ``small_groups`` as in ``race_thresholds``.
    """
    keyed = keyed.where(F.col(key_col).isNotNull())
    if thresholds is None:
        return first_by_cut(keyed, group_cols, key_col, id_col, n_col)
    need, have = F.col("need"), F.col("available")
    whole = need >= have
    # no cut although the group is far larger, or more rows than one task should rank
    far = F.col("threshold").isNull() & (have > need + MARGIN_SIGMAS * F.sqrt(need) + 8)
    path = F.when(whole, "whole").when(far | (need > RANKED_ROWS), "cut").otherwise("rank")
    th = thresholds.select(*group_cols, "threshold", "need", "available", path.alias("_path"))
    joined = keyed.join(F.broadcast(th), group_cols) if small_groups else template_join(keyed, th, group_cols)
    cand = (joined.where((F.col("_path") != "cut") & (F.col("threshold").isNull() | whole | (F.col(key_col) <= F.col("threshold"))))
                  .persist(StorageLevel.MEMORY_AND_DISK))
    kept = cand.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_kept"))
    th = F.broadcast(th) if small_groups else th
    by_cut = (kept.join(th, group_cols, "right")
                  .where((F.col("_path") == "cut") | (F.coalesce(F.col("_kept"), F.lit(0)) < F.least(need, have)))
                  .select(*group_cols)).persist(StorageLevel.MEMORY_AND_DISK)
    columns = keyed.columns
    w = Window.partitionBy(*group_cols).orderBy(F.col(key_col), F.col(id_col))
    ranked = cand.where(F.col("_path") == "rank")
    rest = None
    if by_cut.limit(1).count():      # rare
        ranked = ranked.join(by_cut, group_cols, "left_anti")
        rest = first_by_cut(template_join(keyed, by_cut, group_cols, "left_semi"), group_cols, key_col, id_col, n_col)
    out = (ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col(n_col)).select(*columns)
                 .unionByName(cand.where(F.col("_path") == "whole").select(*columns)))
    return out if rest is None else out.unionByName(rest.select(*columns))


def train_dev_split(sample: DataFrame, group_cols: list[str], id_col: str, dev_share,
                    seed: int = 0, label_col: str = "label", largest: int | None = None) -> DataFrame:
    """Label 2 (dev) on ceil(p * size) rows of each sample, 1 (train) on the
    rest; dev rows are the smallest md5 keys (salt 'dev').

    ``dev_share`` is a float or a column name holding p per group.  Windows
    are per sample, so they hold at most the sample size; where ``largest``, the
    size of the largest sample, is above ``RANKED_ROWS``, the dev rows are cut
    by selection and no task holds a sample.
    """
    p = F.col(dev_share) if isinstance(dev_share, str) else F.lit(float(dev_share))
    split_name = F.concat_ws("|", *[F.col(c).cast("string") for c in group_cols])
    u2 = uniform(F.col(id_col), seed, split_name, "dev")
    if largest is not None and largest > RANKED_ROWS:
        sample = materialize(sample.withColumn("_u", u2))
        sizes = sample.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size"))
        keyed = template_join(sample, sizes, group_cols).withColumn("_dev", F.ceil(p * F.col("_size")))
        cuts = grouped_cut(keyed, group_cols, "_u", id_col, "_dev")
        dev = within_cuts(keyed, cuts, group_cols, "_u", id_col) & (F.col("_dev") > 0)
        return (template_join(keyed, cuts, group_cols, "left").withColumn(label_col, F.when(dev, F.lit(2)).otherwise(F.lit(1)).cast("int"))
                .drop("_u", "_size", "_dev", "cut_key", "cut_id"))
    w_all = Window.partitionBy(*group_cols)
    w_ord = Window.partitionBy(*group_cols).orderBy(u2, F.col(id_col))
    return (sample.withColumn("_size", F.count(F.lit(1)).over(w_all))
                  .withColumn("_r", F.row_number().over(w_ord))
                  .withColumn(label_col, F.when(F.col("_r") <= F.ceil(p * F.col("_size")), F.lit(2))
                                          .otherwise(F.lit(1)).cast("int"))
                  .drop("_size", "_r"))


def template_counts(pool: DataFrame, template_col: str) -> DataFrame:
    """(template, cnt, freq): rows per non-null template, freq = cnt / rows."""
    counts = pool.where(F.col(template_col).isNotNull()).groupBy(template_col).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("_total")).withColumn("_one", F.lit(1))
    # one-row total joined on a constant key (broadcast hash join)
    return (counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
                  .withColumn("freq", F.col("cnt") / F.col("_total")).drop("_one", "_total"))


def weighted_sample(pool: DataFrame, id_col: str, weight_col: str, specs: list[dict],
                    class_col: str | None = None, seed: int = 0) -> DataFrame:
    """For each spec {split_name, n}: n rows without replacement, drawn with
    probability proportional to ``weight_col`` (null/0 never drawn).

    The cut is computed from the distinct weights (``class_col`` is kept for
    callers that name the column on which the weight depends).
    Returns pool columns + split_name.
    """
    keyed = (pool.withColumn("_spec", F.explode(specs_array(specs)))
                 .withColumn("split_name", F.col("_spec.split_name"))
                 .withColumn("n", F.col("_spec.n"))
                 .drop("_spec")
                 .withColumn("_key", race_key(uniform(F.col(id_col), seed, F.col("split_name"), "draw"),
                                              F.col(weight_col))))
    # the cut needs no more than how many rows have each weight
    summary = (pool.groupBy(weight_col).agg(F.count(F.lit(1)).alias("cnt"))
                   .withColumn("_spec", F.explode(specs_array(specs)))
                   .select(F.col("_spec.split_name").alias("split_name"), F.col("_spec.n").alias("n"),
                           F.col(weight_col).alias("w"), "cnt"))
    th = race_thresholds(summary, ["split_name"])
    out = smallest_n(keyed, ["split_name"], "_key", id_col, "n", th)
    return out.drop("_key", "n")


def uniform_sample(pool: DataFrame, id_col: str, specs: list[dict], seed: int = 0,
                   on_short: str = "clamp") -> DataFrame:
    """n rows uniformly without replacement per spec; n larger than the pool
    is clamped (``on_short='clamp'``) or raises (``'error'``)."""
    if on_short == "error":
        total = pool.count()
        big = [s for s in specs if s["n"] > total]
        if big:
            raise ValueError(f"sample larger than population: {big[0]} > {total}")
    return weighted_sample(pool.withColumn("_w1", F.lit(1.0)), id_col, "_w1", specs,
                           class_col="_w1", seed=seed).drop("_w1")


def top_n_per_group(df: DataFrame, group_cols: list[str], id_col: str, n: int, seed: int, salt: str,
                     key_col: str = "_u", parts: tuple | None = None) -> DataFrame:
    """Per group, the ``n`` rows with the smallest md5 uniform
    u(id, seed, group, salt) (whole group when smaller), exact.

    Uses the same cut as the samplers: -ln(1-u) is an exponential race
    with weight 1, so per group a threshold from its row count keeps about
    n + 4 sqrt(n) rows (plus at most 4.4 %) before the shuffle, and the
    rank window holds O(n) rows even for a group with a third of all rows.  ``key_col`` keeps u."""
    gkey = F.concat_ws("|", *[F.col(c).cast("string") for c in group_cols])
    u = uniform(F.col(id_col), *parts) if parts else uniform(F.col(id_col), seed, gkey, salt)
    keyed = df.withColumn(key_col, u).withColumn("_need", F.lit(int(n)))
    summary = (df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("cnt"))
                 .withColumn("n", F.lit(int(n))).withColumn("w", F.lit(1.0)))
    # a race cut t on -ln(1-u) is the cut 1 - exp(-t) on u itself (same
    # expected survivors), so rows are ranked by u, ascending
    th = race_thresholds(summary, group_cols, small_groups=False).withColumn(
        "threshold", 1.0 - F.exp(-F.col("threshold")))
    return smallest_n(keyed, group_cols, key_col, id_col, "_need", th, small_groups=False).drop("_need")


def cap_per_group(df: DataFrame, group_cols: list[str], id_col: str, n: int, seed: int = 42,
                  count_col: str | None = None) -> DataFrame:
    """At most ``n`` rows of each group (rows chosen by md5 key); groups with
    at most n rows (counting non-null ``count_col`` if given) stay whole.
    Rows with a null group vanish, as in the reference.  Big groups go
    through ``top_n_per_group`` (thresholded, exact, skew-safe)."""
    base = df
    for c in group_cols:
        base = base.where(F.col(c).isNotNull())
    counted = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    sizes = base.groupBy(*group_cols).agg(counted.alias("_gsize"))
    keyed = template_join(base, sizes, group_cols)
    small = keyed.where(F.col("_gsize") <= n).drop("_gsize")
    big = keyed.where(F.col("_gsize") > n).drop("_gsize")
    return small.unionByName(top_n_per_group(big, group_cols, id_col, n, seed, "cap").drop("_u"))


def two_phase_sample(pool: DataFrame, id_col: str, template_col: str, n: int, exponent: float = 0.0,
                     seed: int = 0, split_name: str = "two_phase") -> DataFrame:
    """Repeat until n rows: draw a template with probability proportional to
    (its remaining rows)^exponent, then a uniform remaining row of it.

    Closed form: inside a template, rows in md5 order; the j-th (0-based) row
    arrives after gaps Exp(1) / (c - j)^e (competing exponential clocks,
    memoryless), so arrival = running sum of gaps.  The n earliest arrivals
    are the sample.  Only the first min(c, n) rows of a template can be
    drawn, so an exact thresholded top-n per template bounds every window
    by O(n) rows.  Returns pool columns + ``arrival``.
    """
    base = pool.where(F.col(template_col).isNotNull())
    counts = base.groupBy(template_col).agg(F.count(F.lit(1)).alias("_c"))
    prefix = top_n_per_group(base, [template_col], id_col, n, seed, split_name,
                             parts=(seed, split_name, "row"))
    w_t = Window.partitionBy(template_col).orderBy("_u", id_col)
    prefix = prefix.withColumn("_j", F.row_number().over(w_t) - 1)
    prefix = template_join(prefix, counts, template_col)
    gap_u = uniform(F.col(id_col), seed, F.lit(split_name), "gap")
    rate = F.pow((F.col("_c") - F.col("_j")).cast("double"), F.lit(float(exponent)))
    prefix = prefix.withColumn("_gap", -F.log(gap_u) / rate)
    w_run = w_t.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    arrivals = prefix.withColumn("arrival", F.sum("_gap").over(w_run)).drop("_gap", "_j", "_c", "_u")
    return global_smallest(arrivals, "arrival", id_col, n)


def kth_id(df: DataFrame, id_col: str, k: int):
    """The ``k``-th smallest id, found sign by sign: each round counts the signs
    that follow the ids' common beginning.  Equal ids count one by one."""
    part = df.select(id_col, id_text(df, id_col).alias("_t"))
    while True:
        st = part.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.count(F.lit(1)).alias("c")).first()
        if st["lo"] == st["hi"] or k == st["c"]:
            return part.where(F.col("_t") == st["hi"]).select(id_col).first()[0]
        p = next((i for i, (a, b) in enumerate(zip(st["lo"], st["hi"])) if a != b), len(st["lo"])) + 1
        sign, before = F.substring("_t", p, 1), 0
        for ch, n in sorted((r[0], r[1]) for r in part.groupBy(sign.alias("_c")).count().collect()):
            if before + n >= k:
                part, k = part.where(sign == ch), k - before
                break
            before += n


def kth_cut(df: DataFrame, key_col: str, id_col: str, k: int, bins: int = 4096):
    """Exact cut ``(key, id)`` such that exactly ``k`` rows have
    ``(key, id) <= cut`` (None when the frame has at most k rows).

    Each round is one aggregate: a histogram of the key over ``bins`` slices
    between the least and greatest remaining key, with the least and greatest key
    of each slice, between which the next round looks.  Where all remaining keys
    are equal, the ids decide (``kth_id``).  No keys are read and nothing is ranked;
    what comes to the driver is one histogram a round."""
    if k <= 0:
        return None
    key, need = F.col(key_col).cast("double"), k
    lo, hi, c = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if c <= k:
        return None
    while lo < hi:
        slice_ = F.least(F.floor((key - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
        hist = (df.where(key.between(F.lit(lo), F.lit(hi))).groupBy(slice_.alias("_b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
        for r in sorted(hist, key=lambda r: r["_b"]):
            if r["n"] >= need:
                lo, hi = r["lo"], r["hi"]
                break
            need -= r["n"]
    return lo, kth_id(df.where(key == F.lit(lo)), id_col, need)


def below_cut(df: DataFrame, key_col: str, id_col: str, cut) -> DataFrame:
    """Rows with ``(key, id) <= cut`` (all rows when cut is None)."""
    if cut is None:
        return df
    k, i = cut
    key, rid = F.col(key_col), F.col(id_col)
    return df.where((key < F.lit(k)) | ((key == F.lit(k)) & (rid <= F.lit(i))))


def global_smallest(df: DataFrame, key_col: str, id_col: str, n: int) -> DataFrame:
    """Exact n smallest rows by (key, id), distributed (see ``kth_cut``)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return below_cut(df, key_col, id_col, kth_cut(df, key_col, id_col, n))
