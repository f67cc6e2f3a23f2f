"""Sampler invariants, determinism and exactness of the scale paths."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from splitcraft.functions.hashing import race_key, uniform
from splitcraft.operators import sampling as SM
from splitcraft.operators import splits as S


def _pool(spark, n=3000, templates=30):
    # skewed template sizes: template t holds about n / (t + 1) / H rows
    rows = []
    i = 0
    for t in range(templates):
        for _ in range(max(1, n // (t + 1) // 4)):
            rows.append((f"id-{i:06d}", f"t{t}", f"now => q{t} => notify"))
            i += 1
    return spark.createDataFrame(rows, "example_id string, tmpl string, query string")


def test_weighted_sample_exact_sizes_and_determinism(spark):
    pool = _pool(spark)
    specs = [{"split_name": f"s{i}", "n": 50 + i} for i in range(4)]
    pool = pool.withColumn("w", F.lit(1.0))
    a = SM.weighted_sample(pool, "example_id", "w", specs, class_col="tmpl")
    sizes = {r["split_name"]: r["count"] for r in a.groupBy("split_name").count().collect()}
    assert sizes == {s["split_name"]: s["n"] for s in specs}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    b = SM.weighted_sample(pool, "example_id", "w", specs, class_col="tmpl")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, a.select("split_name", "example_id").collect())) == \
        sorted(map(tuple, b.select("split_name", "example_id").collect()))


def test_threshold_path_equals_plain_rank(spark):
    pool = _pool(spark).withColumn("w", F.lit(1.0))
    specs = [{"split_name": "a", "n": 200}, {"split_name": "b", "n": 5000}]
    keyed = (pool.withColumn("_s", F.explode(SM.specs_array(specs)))
                 .select("*", F.col("_s.split_name").alias("split_name"), F.col("_s.n").alias("n")).drop("_s")
                 .withColumn("_key", race_key(uniform(F.col("example_id"), 0, F.col("split_name"), "draw"),
                                              F.col("w"))))
    summary = (pool.groupBy("tmpl", "w").count().withColumnRenamed("count", "cnt")
                   .withColumn("_s", F.explode(SM.specs_array(specs)))
                   .select(F.col("_s.split_name").alias("split_name"), F.col("_s.n").alias("n"), "w", "cnt"))
    th = SM.race_thresholds(summary, ["split_name"])
    fast = SM.smallest_n(keyed, ["split_name"], "_key", "example_id", "n", th)
    slow = SM.smallest_n(keyed, ["split_name"], "_key", "example_id", "n", None)
    assert sorted(map(tuple, fast.select("split_name", "example_id").collect())) == \
        sorted(map(tuple, slow.select("split_name", "example_id").collect()))


def test_alpha_minus_one_spreads_templates(spark):
    pool = _pool(spark)
    a = S.uat_splits(pool, "example_id", "tmpl", "query", [-1, 0], [300], replicates=1, dev_share=0.2)
    joined = a.join(pool, "example_id")
    per = {r["split_name"]: Counter() for r in a.select("split_name").distinct().collect()}
    for r in joined.select("split_name", "tmpl").collect():
        per[r["split_name"]][r["tmpl"]] += 1
    flat = per["-1_300_0_false"]
    skew = per["0_300_0_false"]
    # alpha -1: every template has the same mass (about 10 rows each here);
    # alpha 0: rows are uniform, so the big template dominates
    assert max(flat.values()) < max(skew.values()) / 2
    mean = 300 / 30
    assert sum((v - mean) ** 2 for v in flat.values()) < sum((v - mean) ** 2 for v in skew.values())


def test_train_dev_split_ceil(spark):
    df = spark.createDataFrame([("s", f"i{i}") for i in range(20)], "split_name string, example_id string")
    out = SM.train_dev_split(df, ["split_name"], "example_id", 0.2)
    c = Counter(r["label"] for r in out.collect())
    assert c == {1: 16, 2: 4}


def test_kth_cut_matches_sort(spark):
    df = spark.range(0, 20000).select(F.col("id").cast("string").alias("id"),
                                      uniform(F.col("id"), 3, "x", "y").alias("u"))
    for k in (1, 17, 5000, 19999):
        cut = SM.kth_cut(df, "u", "id", k, bins=64)
        got = SM.below_cut(df, "u", "id", cut).count()
        assert got == k
        want = sorted((r.u, r.id) for r in df.collect())[k - 1]
        assert cut == want


def test_cap_per_group(spark):
    pool = _pool(spark)
    capped = SM.cap_per_group(pool, ["tmpl"], "example_id", 40)
    sizes = Counter(r["tmpl"] for r in capped.collect())
    orig = Counter(r["tmpl"] for r in pool.collect())
    for t, n in orig.items():
        assert sizes[t] == min(n, 40)


def test_hierarchy_weights_sum_to_one(spark):
    rows = [(f"i{i}", f"a{i % 2}", f"b{i % 4}", f"c{i % 8}", f"d{i % 16}") for i in range(200)]
    df = spark.createDataFrame(rows, "example_id string, l0 string, l1 string, l2 string, l3 string")
    hw = S.hierarchy_weights(df, ["l0", "l1", "l2", "l3"])
    total = df.join(hw.select("l3", "hweight"), "l3").agg(F.sum("hweight")).first()[0]
    assert abs(total - 1.0) < 1e-9


def test_two_phase_e1_is_uniform_over_rows(spark):
    pool = _pool(spark)
    got = SM.two_phase_sample(pool, "example_id", "tmpl", 500, exponent=1.0)
    assert got.count() == 500
    assert got.select("example_id").distinct().count() == 500


def test_neighbour_sets_invariants(spark):
    from splitcraft.operators import neighbours as NB
    rows = []
    i = 0
    for t in range(12):
        for _ in range(5 + 3 * t):
            rows.append((f"id-{i:05d}", f"a{t % 3}", " ".join(["x"] * (t % 5 + 1) + ["y"] * (t // 5 + 1))))
            i += 1
    pool = spark.createDataFrame(rows, "example_id string, abstract_template string, template string")
    out = NB.neighbour_sets(pool, "example_id", "abstract_template", "template", 60, 3).collect()
    sets = Counter(r.set_id for r in out if r.set_id >= 0)
    assert len(sets) == int(60 * 0.95 // 1 // 4)
    assert all(v <= 4 for v in sets.values())
    assert len({r.example_id for r in out}) == len(out)


def test_validate_and_fix_spaced_and_plain_tokens(spark):
    from splitcraft.operators.coverage import validate_and_fix
    rows = [
        ("g", "t1", "now => ( @org.schema.Hotel.Hotel ) filter param:name:String == x => notify", 1),
        # the dots of org.schema. match spaces: member '@org schema Hotel.Hotel' (three words)
        ("g", "d1", "now => ( @org schema Hotel.Hotel ) filter param:name:String == x => notify", 2),
        # uses an operator unseen in train
        ("g", "d2", "now => ( @org.schema.Hotel.Hotel ) filter not param:name:String == x => notify", 2),
        # the unseen operator only at the very start: ' not ' never occurs, row stays
        ("g", "d3", "not => ( @org.schema.Hotel.Hotel ) filter param:name:String == x => notify", 2),
        ("g", "d4", "now => ( @org.schema.Hotel.Hotel ) filter param:name:String == x => notify", 2),
    ]
    df = spark.createDataFrame(rows, "g string, example_id string, query string, label int")
    kept = {r.example_id for r in validate_and_fix(df, ["g"], "example_id", "query").collect()}
    assert kept == {"t1", "d3", "d4"}


def test_coverage_in_place_equals_the_join(spark, monkeypatch):
    """Both ways against a loop: plain, spaced and strict; null groups and programs, repeated ids."""
    import random

    from splitcraft.operators import coverage as C

    rng = random.Random(2)
    parts = ["@org.schema.Hotel.Hotel", "@org schema Hotel.Hotel", "param:a", "param:b", "(param:c", "param:d:X", "enum:q", "tt:x", "not", "count", "x", ""]
    rows = [(rng.choice(["g", "h", None]), f"e{rng.randint(0, 200)}", rng.choice(["(", ""]) + " ".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) + " )",
             1 if rng.random() < 0.1 else 2) for _ in range(400)] + [("g", "n", None, 2), ("g", None, "param:zz now param:zz )", 2)]
    df = C.with_vocab(spark.createDataFrame(rows, "g string, id string, query string, label int"), "query").cache()
    seen = [tuple(r) for r in df.select("g", "id", "query", "label", "vocab").collect()]
    for strict in (False, True):
        want = []
        for g, i, q, label, vocab in seen:
            train = {t for x in seen if x[0] == g and x[3] == 1 and g is not None for t in x[4] or []}
            missing = {t for x in seen if x[0] == g and x[3] == 2 and g is not None for t in x[4] or []} - train
            gone = q is not None and any(t in vocab if strict else f" {t.strip()} " in q for t in missing)
            if label == 1 or not gone:
                want.append(repr((g, i, q, label)))
        for limit in (1000, 0):
            monkeypatch.setattr(C, "IN_PLACE_TOKENS", limit)
            out = C.validate_and_fix(df, ["g"], "id", "query", strict=strict)
            assert sorted(repr(tuple(r)) for r in out.select("g", "id", "query", "label").collect()) == sorted(want)
        monkeypatch.undo()


def test_coverage_in_place_moves_no_word(spark):
    from splitcraft.operators import coverage as C

    df = spark.createDataFrame([("g", "a", "now param:x )", 1), ("g", "b", "now param:y )", 2)], "g string, id string, query string, label int")
    missing = spark.createDataFrame([("g", "param:y ")], "g string, tok string")
    plan = C.rows_without_tokens(df, missing, ["g"], "id", "query")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "LeftAnti" not in plan


def test_short_cut_is_redone_exactly(spark, monkeypatch):
    # a negative margin makes the cut keep too few rows: the redo path must
    # still return exactly the n smallest keys per group
    monkeypatch.setattr(SM, "MARGIN_SIGMAS", -6.0)
    pool = _pool(spark)
    got = SM.top_n_per_group(pool, ["tmpl"], "example_id", 30, 5, "t")
    want = (pool.withColumn("_u", uniform(F.col("example_id"), 5, F.col("tmpl"), "t"))
                .withColumn("_r", F.row_number().over(
                    __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("tmpl").orderBy("_u", "example_id")))
                .where("_r <= 30"))
    assert sorted(r.example_id for r in got.collect()) == sorted(r.example_id for r in want.collect())


def test_kth_cut_with_ties_and_bin_edges(spark):
    # keys on a coarse grid (many exact ties, many keys exactly on bin edges)
    df = spark.range(0, 6000).select(F.format_string("%06d", "id").alias("id"),
                                     (F.floor(uniform(F.col("id"), 9, "x", "y") * 40) / 8.0).alias("u"))
    rows = sorted((r.u, r.id) for r in df.collect())
    for k in (1, 150, 2999, 5999):
        cut = SM.kth_cut(df, "u", "id", k, bins=8)
        assert cut == rows[k - 1]
        assert SM.below_cut(df, "u", "id", cut).count() == k


@pytest.mark.parametrize("keys", ["spread", "ties", "equal"])
@pytest.mark.parametrize("ids", ["text", "long"])
def test_grouped_cut_is_the_nth_of_every_group(spark, keys, ids):
    """Sizes below, at and above n; ids of several lengths, also below zero."""
    n_of = {"a": 1, "b": 37, "c": 500, "d": 60, "e": 0}
    size_of = {"a": 40, "b": 300, "c": 90, "d": 60, "e": 10}
    rows = []
    for g, size in size_of.items():
        for i in range(size):
            key = {"spread": (i * 7919 % 1009) ** 3 / 7.0, "ties": float(i % 3), "equal": 5.0}[keys]
            rows.append((g, key, f"x{i * 31 % 1000}" if ids == "text" else i * 31 % 1000 - 400, n_of[g]))
    df = spark.createDataFrame(rows, f"g string, k double, id {'string' if ids == 'text' else 'long'}, n int").repartition(3)
    got = sorted((r.g, r.k, r.id) for r in SM.first_by_cut(df, ["g"], "k", "id", "n").collect())
    want = [(g, k, i) for g in n_of for _, k, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))[:n_of[g]]]
    assert got == sorted(want)


def test_large_samples_are_cut_not_ranked(spark, monkeypatch):
    """Above RANKED_ROWS no window holds a sample; the rows are the same."""
    pool = _pool(spark)
    specs = [{"split_name": "s", "n": 70}, {"split_name": "t", "n": 10 ** 6}]
    one = SM.uniform_sample(pool, "example_id", specs, seed=4)
    small = sorted((r.split_name, r.example_id, r.label) for r in SM.train_dev_split(one, ["split_name"], "example_id", 0.2).collect())
    monkeypatch.setattr(SM, "RANKED_ROWS", 10)
    other = SM.train_dev_split(SM.uniform_sample(pool, "example_id", specs, seed=4), ["split_name"], "example_id", 0.2, largest=10 ** 6)
    assert sorted((r.split_name, r.example_id, r.label) for r in other.collect()) == small
