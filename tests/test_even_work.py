"""Heavy work per row is dealt evenly and done once, with the results of plain Python."""
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from splitcraft.functions import templates as T
from splitcraft.functions import text as TX
from splitcraft.functions import vocab as V
from splitcraft.operators import coverage as C
from splitcraft.operators import evaluate as EV
from splitcraft.operators import sampling as SM
from splitcraft.plans import catalog
from splitcraft.plans.fixtures import predictions, token_id

SF_SMALL = "/root/testdata/sf0.001"

PIECES = ["now", " ", "  ", "=>", "(", ")", "\t", '"', " true ", " false ", "NUMBER_1", "NUMBER_VAL", " 12 ", " 7 unit:day ", "enum:a_b", "time:3:0:0",
          "location:VAL", "== location: home ", ", location:x ", "AB_3", "tt:thing_x ", "(tt:y)", "@org.schema.Book.Book ", "org.schema.Book:name ",
          "param:name:String ", " param:geo.lat:Loc(x) ", "param:price ", " and ", " not ", " >= ", " sort ", " desc ", " in_array~ ", "^^tt:z", '" a b "', "é", "ß", "—", "漢"]


def odd_texts(n=400):
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "   ", "nan"]


def plain_steps(text, steps):
    for kind, a, b in steps:
        text = re.sub(a, b.replace("$1", r"\1"), text, flags=re.ASCII) if kind == "re" else text.replace(a, b)
    return text


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_dir):
    """A file with one row group is read by one task, however many splits it has."""
    rng = random.Random(1)
    n = 20_000
    pq.write_table(pa.table({"id": list(range(n)), "t": [str(rng.random()) for _ in range(n)]}), f"{tmp_dir}/one.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "16k")
        df = spark.read.parquet(f"{tmp_dir}/one.parquet")
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores
        for rows, most in ((SM.SPREAD_ROWS, n // cores * 2), (1000, 1300)):
            SM.SPREAD_ROWS, before = rows, SM.SPREAD_ROWS
            try:
                dealt = SM.spread(df, "id")
            finally:
                SM.SPREAD_ROWS = before
            held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(held) == n and max(held) <= most
        assert SM.spread(df.repartition(8, "id"), "id").rdd.getNumPartitions() == 8  # even already
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_each_vocabulary_is_computed_once(spark):
    df = spark.createDataFrame([("a", "now => tt:x and tt:y ")], "g string, query string").withColumn("id", F.lit(1)).checkpoint()
    plan = C.vocab_table(C.with_vocab(df, "query"), ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(V.PROPERTY_PATTERNS)
    plan = catalog.q_quoted_spans(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_vocabulary_equals_the_patterns(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").checkpoint()
    got = df.orderBy("i").select(V.extract_properties("t").alias("p"), V.operators_present("t").alias("o")).collect()
    for t, r in zip(texts, got):
        assert r.p == list(dict.fromkeys(m for p in V.PROPERTY_PATTERNS for m in re.findall(p, t, flags=re.ASCII)))
        assert r.o == [o for o in V.OPERATORS if f" {o} " in t]
    assert got[-1].p is None and not got[-1].o


def test_rewrites_equal_plain_steps(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").checkpoint()
    lists = [T.TYPED_STEPS, T.UNTYPED_VALUE_STEPS[:-1], T.SCHEMA_STEPS + [T.SQUEEZE], T.NOOPS_STEPS]
    got = df.orderBy("i").select(*[T.apply_steps(F.col("t"), s).alias(f"s{k}") for k, s in enumerate(lists)],
                                 TX.ascii_fold("t").alias("f"), TX.whitespace_tokens("t").alias("w")).collect()
    multi = TX.MULTI_CHAR_FOLDS + TX.MULTI_CHAR_PUNCTUATION
    for t, r in zip(texts, got):
        assert [r[f"s{k}"] for k in range(len(lists))] == [plain_steps(t, s) for s in lists]
        folded = t.translate(str.maketrans(TX.FOLD_FROM + TX._PUNCT_FROM, TX.FOLD_TO + TX._PUNCT_TO))
        for a, b in multi:
            folded = folded.replace(a, b)
        assert r.f == folded and r.w == t.split()
    assert all(got[-1][c] is None for c in ("s0", "s1", "s2", "s3", "f", "w"))


def test_matches_of_equal_sides_and_whole_numbers(spark):
    rng = random.Random(4)
    sides = [[[rng.choice([1, 2, 11, 12, 112, None]) for _ in range(rng.randint(0, 12))] for _ in range(2)] for _ in range(200)]
    sides += [[g, list(g)] for g, _ in sides[:50]]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(sides)], "i long, g array<long>, p array<long>")
    got = [tuple(r) for r in EV._overlaps(df.orderBy("i").coalesce(1), "g", "p", (), 4, True).collect()]

    def grams(x, n):
        return Counter(tuple(x[j:j + n]) for j in range(len(x) - n + 1))

    def own(x):  # a null id is part of no common subsequence
        return [object() if v is None else v for v in x]

    want = [(len(g), len(p), *[sum((grams(g, n) & grams(p, n)).values()) for n in range(1, 5)], EV._lcs_bits(own(p), own(g))) for g, p in sides]
    assert got == want


def test_predicted_ids_are_those_of_the_tokens(spark):
    p = predictions(spark, SF_SMALL)
    assert p.where(~F.transform("predicted_tokens", token_id).eqNullSafe(F.col("pred_ids"))).count() == 0 and p.count() > 0
