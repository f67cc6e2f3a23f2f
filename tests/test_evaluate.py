import random

from pyspark.sql import functions as F

from splitcraft.operators import evaluate as EV
from splitcraft.operators import neighbours as NB


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_lcs_bits_matches_dp():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        assert EV._lcs_bits(a, b) == _lcs(a, b)


def test_exact_match_drops_last_prediction(spark):
    df = spark.createDataFrame([(["<s>", "a", "b", "</s>"], ["a", "b", "x"]), (["<s>", "a", "</s>"], ["a"])],
                               "g array<string>, p array<string>")
    assert [r[0] for r in df.select(EV.exact_match("g", "p")).collect()] == [True, False]


def test_sequence_accuracy_pads_and_cuts(spark):
    df = spark.createDataFrame([([1, 5, 6, 2], [5, 6, 2, 9]), ([1, 5, 6, 2], [5, 6]), ([1, 7], [7])],
                               "g array<long>, p array<long>")
    acc = EV.sequence_accuracy(df, "g", "p", pad=0).first()[0]
    assert abs(acc - 2 / 3) < 1e-12


def test_truncate_at_eos(spark):
    df = spark.createDataFrame([([4, 2, 5, 2],), ([4, 5],)], "ids array<int>")
    assert [r[0] for r in df.select(EV.truncate_at_eos("ids")).collect()] == [[4, 2], [4, 5]]


def _lev(a, b):
    dp = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, dp[0] = dp[0], i
        for j, y in enumerate(b, 1):
            prev, dp[j] = dp[j], min(dp[j] + 1, dp[j - 1] + 1, prev + (x != y))
    return dp[-1]


def test_nearest_templates_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "d", "e"]
    temps = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 12))) for _ in range(80)})
    df = spark.createDataFrame([(t,) for t in temps], "t string")
    got = {(r.t1, r.rank): (r.t2, r.dist) for r in NB.nearest_templates(df, "t", 3).collect()}
    for a in temps:
        cand = sorted(((_lev(a.split(), b.split()) or 100000), b) for b in temps if b != a)[:3]
        for rank, (d, b) in enumerate(cand, 1):
            assert got[(a, rank)] == (b, d)


def test_template_pairs_threshold_join_brute_force(spark):
    rng = random.Random(11)
    words = ["a", "b", "c", "d"]
    temps = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(120)})
    df = spark.createDataFrame([(t,) for t in temps], "t string")
    for d in (1, 2, 3):
        got = {(r.t1, r.t2): r.dist for r in NB.template_pairs(df, "t", d).collect()}
        want = {}
        for a in temps:
            for b in temps:
                if a != b:
                    x = _lev(a.split(), b.split())
                    if x <= d:
                        want[(a, b)] = x or 100000
        assert got == want, d


def test_matches_are_clipped_natively(spark):
    """Repeated n-grams, nulls, tokens that look like others put together, and empty sides."""
    from collections import Counter

    rng = random.Random(3)
    units = ["a", "b", "1:a", "a1:a", "", "#", None, "~"]
    sides = [[[rng.choice(units) for _ in range(rng.randint(0, 14))] for _ in range(2)] for _ in range(300)]
    sides += [[None, ["a"]], [["a"], None], [["a"] * 40, ["a"] * 25], [[], []]]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(sides)], "i long, g array<string>, p array<string>")
    got = [tuple(r) for r in EV._overlaps(df.orderBy("i").coalesce(1), "g", "p", (), 4, False).collect()]

    def grams(x, n):
        return Counter(tuple(x[j:j + n]) for j in range(len(x) - n + 1))

    want = []
    for g, p in sides:
        g, p = g or [], p or []
        want.append((len(g), len(p), *[sum((grams(g, n) & grams(p, n)).values()) for n in range(1, 5)]))
    assert got == want


def test_bleu_has_no_python_node(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 2, 3, 5, 5])], "g array<int>, p array<int>")
    plan = EV.bleu(df, "g", "p", exclude=(9,))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" in plan


def test_template_pairs_of_short_and_long_templates(spark):
    """Anchors and targets take their rarest grams in one order, also where some
    anchors are too short for them or only some templates are anchors."""
    rng = random.Random(5)
    words = list("abcdefghij")
    temps = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)}
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(8, 14))]
        for _ in range(5):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            temps.add(" ".join(near))
    temps = sorted(temps)
    df = spark.createDataFrame([(t,) for t in temps], "t string")
    e = NB.materialize(NB.encode(df, "t", NB.token_codes(df, ["t"])))
    want = {(a, b): _lev(a.split(), b.split()) for a in temps for b in temps if a != b and _lev(a.split(), b.split()) <= 2}
    some = spark.createDataFrame([(t,) for t in temps[::9]], "t string")
    for anchors, mine in ((e, set(temps)), (e.join(some, "t", "left_semi"), set(temps[::9]))):
        got = {(r.t1, r.t2): r.dist for r in NB._threshold_pairs(anchors, e, "t", 2).collect()}
        assert got == {k: v for k, v in want.items() if k[0] in mine}


def test_kept_pairs_are_not_computed_again(spark, tmp_dir):
    rng = random.Random(13)
    temps = sorted({" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(160)})
    first, path = temps[::2], tmp_dir + "/kept"
    df = lambda ts: spark.createDataFrame([(t,) for t in ts], "t string")
    read = lambda: {(r.t1, r.t2): r.dist for r in NB.kept_template_pairs(spark, path).collect()}
    want = {(a, b): _lev(a.split(), b.split()) for a in temps for b in temps if a != b and _lev(a.split(), b.split()) <= 2}
    NB.update_template_pairs(df(first), "t", 2, path)
    assert read() == {k: v for k, v in want.items() if set(k) <= set(first)}
    NB.update_template_pairs(df(temps), "t", 2, path)
    assert read() == want
    rows = spark.read.parquet(path + "/pairs")
    per_run = sorted(r["count"] for r in rows.groupBy("run").count().collect())
    old = sum(set(k) <= set(first) for k in want)
    assert per_run == sorted([old, len(want) - old])  # the second run wrote new pairs only
    NB.update_template_pairs(df(temps[5:50]), "t", 2, path)  # nothing new
    assert read() == want and spark.read.parquet(path + "/pairs").count() == len(want)
    # a run cut off before its templates: its pairs are not read
    rows.limit(3).withColumn("run", F.lit("cut off")).write.mode("append").parquet(path + "/pairs")
    assert read() == want
