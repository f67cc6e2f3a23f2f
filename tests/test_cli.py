import os

import pytest
from pyspark.sql import functions as F

from splitcraft.functions import templates as T
from splitcraft.plans import cli
from splitcraft.plans.fixtures import programs
from splitcraft.sources import tsv as TSV
from tests.conftest import SF_SMALL


def _write_tsv(df, path):
    rows = df.collect()
    with open(path, "w") as f:
        for r in rows:
            f.write("\t".join('"' + str(v).replace('"', '""') + '"' if '"' in str(v) else str(v) for v in r) + "\n")


def test_cli_splits_and_instances(spark, tmp_dir):
    p = programs(spark, SF_SMALL)
    _write_tsv(p.select("example_id", "question", "query"), os.path.join(tmp_dir, "pool.tsv"))
    held = p.where("shape = 3").select("example_id", "question", "query", F.lit("x"), F.lit("y"),
                                       T.template_abstract(F.col("query")))
    _write_tsv(held.limit(20), os.path.join(tmp_dir, "test.tsv"))
    _write_tsv(held.limit(0), os.path.join(tmp_dir, "dev.tsv"))
    out = cli.main(["splits", "--augmented_path", os.path.join(tmp_dir, "pool.tsv"),
                    "--compositional_test_path", os.path.join(tmp_dir, "test.tsv"),
                    "--compositional_dev_path", os.path.join(tmp_dir, "dev.tsv"),
                    "--training_size", "40", "--create_training_pool", "--save_training_pool",
                    "--save_uat_samples"])
    pool = TSV.read_splits(spark, out["pool"], header=True)
    assert pool.where("query like '%aggregate count%'").count() == 0   # held-out shape removed
    table = TSV.read_splits(spark, out["splits"], header=True)
    names = [f"-1_40_{i}_false" for i in range(5)]
    assert all(n in table.columns for n in names)
    for n in names:
        c = {r[0]: r[1] for r in table.groupBy(n).count().collect()}
        assert int(c.get("1", 0)) == 32 and 0 < int(c.get("2", 0)) <= 8
    inst_dir = os.path.join(tmp_dir, "inst")
    cli.main(["instances", "--split_table", out["splits"], f"--condition_name={names[0]}",
              "--condition_value", "1", "--out", inst_dir, "--source_max_tokens", "3", "--add_domain_token"])
    inst = spark.read.parquet(inst_dir)
    assert inst.count() == 32
    r = inst.first()
    assert r.source_tokens[0] == "@start@" and r.source_tokens[1].startswith("<") and len(r.source_tokens) == 5


def test_score_command_reports_all_measures(spark, tmp_path):
    rows = [("a", ["@start@", "x", "y", "z", "w", "@end@"], ["x", "y", "z", "w", "@end@"]),
            ("b", ["@start@", "x", "y", "z", "w", "@end@"], ["x", "y", "q", "@end@"])]
    df = spark.createDataFrame(rows, "example_id string, target_tokens array<string>, predicted_tokens array<string>")
    TSV.write_predictions(df, str(tmp_path / "preds"))
    assert sorted(r.example_id for r in TSV.read_predictions(spark, str(tmp_path / "preds")).collect()) == ["a", "b"]
    cli.main(["score", "--predictions", str(tmp_path / "preds"), "--out", str(tmp_path / "out")])
    s = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert (s.exact_match, s.id_seq_acc) == (0.5, 0.5)
    assert 0 < s.bleu < 1 and s.rouge_1 == round((1 + 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)) / 2, 9)
    flags = {r.example_id: r.correct for r in spark.read.json(str(tmp_path / "out" / "correct")).collect()}
    assert flags == {"a": True, "b": False}


def test_cli_refuses_a_sample_larger_than_the_pool(spark, tmp_dir):
    p = programs(spark, SF_SMALL).limit(30)
    for name, rows in (("pool.tsv", p), ("test.tsv", p.limit(2)), ("dev.tsv", p.limit(0))):
        _write_tsv(rows.select("example_id", "question", "query", F.lit("x"), F.lit("y"), T.template_abstract(F.col("query")))
                   if name != "pool.tsv" else rows.select("example_id", "question", "query"), os.path.join(tmp_dir, name))
    with pytest.raises(ValueError, match="larger than population"):
        cli.main(["splits", "--augmented_path", os.path.join(tmp_dir, "pool.tsv"), "--compositional_test_path", os.path.join(tmp_dir, "test.tsv"),
                  "--compositional_dev_path", os.path.join(tmp_dir, "dev.tsv"), "--training_size", "31", "--save_uat_samples"])
