"""Split builders: many samples of one pool in one job.

Every builder returns the long ``assignments`` form
``(split_name, <id>, label)`` with label 1 = train, 2 = dev; pool rows not
chosen (or dev rows dropped by validation) have no row.  ``pivot_labels``
turns it into the reference's wide table (one label column per split).

All specs (alpha x size x replicate) are sampled together: the pool is
scanned once, each row is keyed for every spec by a generator
(``explode`` of a literal spec array), and only rows under each spec's race
threshold reach the shuffle.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import race_key, uniform
from ..functions.templates import MUST_TRAIN_TEMPLATES
from .coverage import drop_uncovered, validate_and_fix, vocab_table, with_vocab
from ..session import materialize
from .joins import template_join
from .sampling import (below_cut, kth_cut, race_thresholds, smallest_n, specs_array,
                       template_counts, train_dev_split)


def split_name(*parts) -> str:
    return "_".join(str(p) for p in parts).lower()


def uat_specs(alphas, sizes, replicates: int = 5, with_paraphrase: bool = False) -> list[dict]:
    """Spec list in the reference's loop order (size, alpha, replicate)."""
    return [{"split_name": split_name(a, s, i, with_paraphrase), "n": int(s), "alpha": float(a)}
            for s in sizes for a in alphas for i in range(replicates)]


def _check_sizes(pool: DataFrame, sizes, on_short: str) -> None:
    """A sample larger than the pool is clamped, or with ``on_short='error'``
    refused."""
    if on_short == "error":
        total = pool.count()
        big = [s for s in sizes if s > total]
        if big:
            raise ValueError(f"sample larger than population: {big[0]} > {total}")


def _sample_and_label(pool: DataFrame, id_col: str, program_col: str, weight: F.Column,
                      class_col: str, class_weights: DataFrame, specs: list[dict],
                      dev_share: float, seed: int, validate: bool = True) -> DataFrame:
    """Shared core: key every (row, spec), take n smallest per spec, split
    train/dev, drop uncovered dev rows."""
    keyed = (pool.withColumn("_spec", F.explode(specs_array(specs)))
                 .select("*", F.col("_spec.split_name").alias("split_name"), F.col("_spec.n").alias("n"),
                         F.col("_spec.alpha").alias("alpha"))
                 .drop("_spec"))
    keyed = keyed.withColumn("_key", race_key(uniform(F.col(id_col), seed, F.col("split_name"), "draw"), weight))
    summary = (class_weights.withColumn("_spec", F.explode(specs_array(specs)))
                            .select(F.col("_spec.split_name").alias("split_name"), F.col("_spec.n").alias("n"),
                                    F.col("_spec.alpha").alias("alpha"), class_col, "cnt", *[
                                        c for c in class_weights.columns if c not in (class_col, "cnt")]))
    summary = summary.withColumn("w", weight)
    th = race_thresholds(summary, ["split_name"])
    sample = smallest_n(keyed.select("split_name", "n", "_key", id_col, program_col),
                        ["split_name"], "_key", id_col, "n", th)
    labeled = train_dev_split(sample.drop("_key", "n"), ["split_name"], id_col, dev_share, seed,
                              largest=max(s["n"] for s in specs))
    if validate:
        labeled = validate_and_fix(labeled, ["split_name"], id_col, program_col)
    return labeled.select("split_name", id_col, "label")


def uat_splits(pool: DataFrame, id_col: str, template_col: str, program_col: str,
               alphas=(-1,), sizes=(20,), replicates: int = 5, dev_share: float = 0.05,
               seed: int = 0, with_paraphrase: bool = False, on_short: str = "clamp") -> DataFrame:
    """UAT sampling: weight of a row = p(template)^alpha; for every
    (size, alpha, replicate) draw ``size`` rows without replacement, carve a
    dev share, drop dev rows with unseen vocabulary.  alpha -1 gives every
    template the same total mass, 0 is uniform over rows."""
    _check_sizes(pool, sizes, on_short)
    specs = uat_specs(alphas, sizes, replicates, with_paraphrase)
    counts = template_counts(pool, template_col)             # template, cnt, freq
    pooled = template_join(pool, counts.select(template_col, "freq"), template_col)
    weight = F.pow(F.col("freq"), F.col("alpha"))
    return _sample_and_label(pooled, id_col, program_col, weight, template_col,
                             counts.select(template_col, "cnt", "freq"), specs, dev_share, seed)


def uniform_splits(pool: DataFrame, id_col: str, program_col: str, sizes=(20,), replicates: int = 5,
                   dev_share: float = 0.05, seed: int = 0, with_paraphrase: bool = False) -> DataFrame:
    """``replicates`` uniform samples of each size (sizes above the pool are
    clamped to the pool size by the ranking itself)."""
    specs = [{"split_name": split_name(s, i, with_paraphrase), "n": int(s), "alpha": 0.0}
             for s in sizes for i in range(replicates)]
    one = pool.withColumn("_all", F.lit(1))
    classes = one.groupBy("_all").agg(F.count(F.lit(1)).alias("cnt"))
    return _sample_and_label(one, id_col, program_col, F.lit(1.0), "_all", classes, specs, dev_share, seed)


HIERARCHY_LEVELS = ["template_kbfree_untyped_noops", "template_kbfree_untyped", "template_kbfree", "template"]


def hierarchy_weights(pool: DataFrame, levels=HIERARCHY_LEVELS) -> DataFrame:
    """Per finest template: weight = 1/#top * prod over levels of
    1/#distinct children of the parent * 1/#rows of the finest template
    (uniform at each level of the template tree).  Returns
    (levels..., cnt, hweight), one row per path of the tree."""
    cls = materialize(pool.groupBy(*levels).agg(F.count(F.lit(1)).alias("cnt")))
    # all further counts are of these few rows
    w = F.lit(1.0) / F.col("cnt")
    for parent, child in zip(levels[:-1], levels[1:]):
        kids = cls.groupBy(parent).agg(F.count_distinct(child).alias(f"_k_{parent}"))
        cls = cls.join(kids, parent)
        w = w / F.col(f"_k_{parent}")
    top = cls.agg(F.count_distinct(levels[0]).alias("_top")).withColumn("_one", F.lit(1))
    cls = cls.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one")
    w = w / F.col("_top")
    return cls.select(*levels, "cnt", w.alias("hweight"))


def hierarchical_splits(pool: DataFrame, id_col: str, program_col: str, sizes=(20,), replicates: int = 5,
                        dev_share: float = 0.05, seed: int = 0, with_paraphrase: bool = False,
                        levels=HIERARCHY_LEVELS, on_short: str = "clamp") -> DataFrame:
    """Weighted samples with the hierarchical weights (split names
    ``-2_{size}_{i}_{flag}``)."""
    _check_sizes(pool, sizes, on_short)
    specs = [{"split_name": split_name(-2, s, i, with_paraphrase), "n": int(s), "alpha": 0.0}
             for s in sizes for i in range(replicates)]
    hw = materialize(hierarchy_weights(pool, levels))
    pooled = template_join(pool, hw.select(*levels, "hweight"), levels)
    return _sample_and_label(pooled, id_col, program_col, F.col("hweight"), levels[-1], hw,
                             specs, dev_share, seed)


def pivot_labels(pool: DataFrame, assignments: DataFrame, id_col: str, split_names: list[str]) -> DataFrame:
    """Wide form: pool + one nullable int label column per split (one pivot,
    one left join)."""
    wide = assignments.groupBy(id_col).pivot("split_name", split_names).agg(F.first("label"))
    return pool.join(wide, id_col, "left")


def sampled_any(pool: DataFrame, assignments: DataFrame, id_col: str) -> DataFrame:
    """Pool rows chosen (train or dev) in at least one split."""
    return pool.join(assignments.select(id_col), id_col, "left_semi")


def split_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("split_name", "label").agg(F.count(F.lit(1)).alias("rows"))


def check_split_sizes(assignments: DataFrame, expected: dict | None = None) -> None:
    """The reference's assertions: both labels present in every split (else
    'there are no examples in dev, try to increase the training size')."""
    sizes = {(r["split_name"], r["label"]): r["rows"] for r in split_sizes(assignments).collect()}
    names = {k[0] for k in sizes}
    for name in names:
        if (name, 2) not in sizes or (name, 1) not in sizes:
            raise AssertionError(f"there are no examples in dev, try to increase the training size ({name})")
    if expected:
        for name, (n_train, n_dev) in expected.items():
            assert sizes.get((name, 1)) == n_train and sizes.get((name, 2)) == n_dev, name


def compositional_split(pool: DataFrame, id_col: str, template_col: str, program_col: str,
                        test_share: float, dev_share: float, iid_share: float = 0.05,
                        seed: int = 0, must_train=MUST_TRAIN_TEMPLATES) -> DataFrame:
    """Template-level split: ceil(test_share * T) of the distinct templates
    (except the must-train ones) go to comp_test, then ceil(dev_share * rest)
    to comp_dev; rows follow their template.  Of the train rows,
    ceil(iid_share * N) become iid_test, then ceil(iid_share * rest) iid_dev.
    All four held-out parts are validated against train.
    Output: pool columns + ``role``.
    """
    must = pool.sparkSession.createDataFrame([(t,) for t in must_train], f"{template_col} string")
    temps = pool.select(template_col).where(F.col(template_col).isNotNull()).distinct()
    comp = temps.join(F.broadcast(must), template_col, "left_anti")
    comp = comp.withColumn("_u", uniform(F.col(template_col), seed, "compositional", "template"))
    n_t = comp.count()
    n_test = _ceil(test_share * n_t)
    n_dev = _ceil(dev_share * (n_t - n_test))
    comp = comp.persist()
    cut_test = kth_cut(comp, "_u", template_col, n_test)
    test_t = below_cut(comp, "_u", template_col, cut_test) if n_test > 0 else comp.limit(0)
    rest = comp.join(test_t.select(template_col), template_col, "left_anti")
    cut_dev = kth_cut(rest, "_u", template_col, n_dev)
    dev_t = below_cut(rest, "_u", template_col, cut_dev) if n_dev > 0 else rest.limit(0)
    roles = (test_t.select(template_col, F.lit("comp_test").alias("role"))
             .unionByName(dev_t.select(template_col, F.lit("comp_dev").alias("role"))))
    rows = (template_join(pool.where(F.col(template_col).isNotNull()), roles, template_col, "left").withColumn("role", F.coalesce("role", F.lit("train"))))
    rows = rows.persist()
    train = rows.where(F.col("role") == "train").withColumn("_u", uniform(F.col(id_col), seed, "compositional", "iid_test"))
    n_train = train.count()
    k_test = _ceil(iid_share * n_train)
    iid_test = below_cut(train, "_u", id_col, kth_cut(train, "_u", id_col, k_test)) if k_test > 0 else train.limit(0)
    rest_rows = train.join(iid_test.select(id_col), id_col, "left_anti") \
                     .withColumn("_u", uniform(F.col(id_col), seed, "compositional", "iid_dev"))
    k_dev = _ceil(iid_share * (n_train - k_test))
    iid_dev = below_cut(rest_rows, "_u", id_col, kth_cut(rest_rows, "_u", id_col, k_dev)) if k_dev > 0 \
        else rest_rows.limit(0)
    iid = (iid_test.select(id_col, F.lit("iid_test").alias("_iid"))
           .unionByName(iid_dev.select(id_col, F.lit("iid_dev").alias("_iid"))))
    rows = (rows.join(iid, id_col, "left")
                .withColumn("role", F.coalesce("_iid", "role")).drop("_iid", "_u"))
    # validate every held-out role against the train rows' vocabulary
    rows = with_vocab(rows, program_col)
    train_rows = rows.where(F.col("role") == "train")
    held = rows.where(F.col("role") != "train")
    kept = drop_uncovered(held, vocab_table(train_rows, [], "vocab"), ["role"], [], id_col, program_col)
    return train_rows.unionByName(kept).drop("vocab")


def _ceil(x: float) -> int:
    """ceil of the float product, as scikit-learn sizes a test split."""
    return int(math.ceil(x))
