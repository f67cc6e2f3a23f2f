import os

from pyspark.sql import functions as F

from splitcraft.sources import shards as SH
from splitcraft.sources import tsv as TSV


def test_tsv_roundtrip_with_quotes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pool.tsv")
    with open(path, "w") as f:
        f.write('1\tshow "x"\t"now => ( a ) filter b == "" c "" => notify"\n')
    df = TSV.read_pairs(spark, path)
    r = df.first()
    assert r.example_id == "1" and r.query == 'now => ( a ) filter b == " c " => notify'
    out = os.path.join(tmp_dir, "out")
    TSV.write_pool(df, out, "tsv")
    back = TSV.read_splits(spark, out, header=True).first()
    assert back.query == r.query


def test_raw_pairs_quirk_two_columns_dedups_on_program(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.tsv")
    with open(path, "w") as f:
        f.write("q1\tp1\nq2\tp1\nq1\tp2\n")
    df = SH.read_raw_pairs(spark, path)
    assert sorted(tuple(r) for r in df.select("c0", "c1").collect()) == [("q1", "p1"), ("q1", "p2")]


def test_raw_pairs_three_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw3.tsv")
    with open(path, "w") as f:
        f.write("0\tq1\tp1\n1\tq1\tp9\n2\tq2\tp2\n")
    df = SH.read_raw_pairs(spark, path)
    assert sorted(tuple(r) for r in df.select("c0", "c1").collect()) == [("q1", "p1"), ("q2", "p2")]


def test_shards_and_merge_invert(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "line")
    sh = SH.shard_round_robin(df, ["line"], 4)
    assert all(r.shard == r.line % 4 for r in sh.collect())
    merged = SH.merge_shards(sh, 1)
    assert all(r.merged_pos == r.line for r in merged.collect())


def test_row_index_is_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    idx = SH.row_index(df, ["k"], "i", partitions=7)
    assert all(r.k == r.i for r in idx.collect())


def test_predictions_drop_heavy_fields(spark, tmp_dir):
    df = spark.createDataFrame([("e1", ["a"], ["a"], [3], 1.0, True, [0.1])],
                               "example_id string, predicted_tokens array<string>, target_tokens array<string>, "
                               "predictions array<long>, log_probabilities double, correct boolean, "
                               "decoder_logits array<double>")
    out = os.path.join(tmp_dir, "preds")
    TSV.write_predictions(df, out, filter_mode=True)
    back = spark.read.json(out)
    assert set(back.columns) == {"example_id", "target_tokens", "log_probabilities", "correct"}


def test_first_wins(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "n long, k string")
    got = sorted(tuple(r) for r in SH.first_wins(df, ["k"], ["n"]).collect())
    assert got == [("a", 1), ("b", 2)]


def test_shard_files_keep_line_order(spark, tmp_dir):
    lines = [f"line {i} \t\"x\" \u2028 é" for i in range(101)]
    df = spark.createDataFrame(list(enumerate(lines)) + [(101, None)], "i long, v string").repartition(5)
    path = os.path.join(tmp_dir, "pool.tsv")
    names = SH.write_shard_files(df, ["i"], "v", path, 4)
    assert names == [f"{path}_part{k}" for k in (1, 2, 3, 4)] and sorted(os.listdir(tmp_dir)) == [f"pool.tsv_part{k}" for k in (1, 2, 3, 4)]
    written = lines + [""]
    for k, name in enumerate(names):
        files = sorted(f for f in os.listdir(name) if f.startswith("part-"))
        text = "".join(open(os.path.join(name, f), encoding="utf-8", newline="").read() for f in files)
        assert text == "".join(x + "\n" for x in written[k::4])
    back = SH.read_shard_files(spark, path, 4).orderBy("merged_pos").collect()
    assert [r.value for r in back] == written and [r.merged_pos for r in back] == list(range(102))
    two = [r.value for r in SH.read_shard_files(spark, path, 4, 2).orderBy("merged_pos").collect()]
    rest, want = [written[k::4] for k in range(4)], []
    while any(rest):
        for r in rest:
            want += r[:2]
            del r[:2]
    assert two == want
    import pytest
    with pytest.raises(FileExistsError):
        SH.write_shard_files(df, ["i"], "v", path, 4)


def test_shard_files_of_few_and_no_lines(spark, tmp_dir):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "i long, v string")
    SH.write_shard_files(df, ["i"], "v", os.path.join(tmp_dir, "few"), 3)
    assert [r.value for r in SH.read_shard_files(spark, os.path.join(tmp_dir, "few"), 3).orderBy("merged_pos").collect()] == ["a", "b"]
    SH.write_shard_files(df.limit(0), ["i"], "v", os.path.join(tmp_dir, "none"), 2)
    assert SH.read_shard_files(spark, os.path.join(tmp_dir, "none"), 2).count() == 0
