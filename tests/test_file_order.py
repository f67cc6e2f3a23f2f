"""Line numbers over several files and several splits of one file."""
import random

import pytest

from splitcraft.sources import shards as SHD
from splitcraft.sources import tsv as TSV


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "50"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, sizes, seed=1):
    """Files of many lengths, so that splits are packed out of order."""
    rng = random.Random(seed)
    lines = []
    for i, n in enumerate(sizes):
        mine = [f"id{i}.{j}\tq{rng.randint(0, 40)}\t{'w ' * rng.randint(1, 30)}{i}.{j}" for j in range(n)]
        (folder / f"part-{i:02d}.tsv").write_text("".join(x + "\n" for x in mine))
        lines += mine
    return [x.split("\t") for x in lines]


def test_places_over_files_and_splits(spark, tmp_path, small_splits):
    rows = write(tmp_path, [3, 120, 0, 1, 60, 7, 200])
    scan = spark.read.text(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 7
    got = TSV.read_pairs(spark, str(tmp_path), 1, 2, None).collect()
    assert sorted((int(r.example_id), r.c0, r.question, r.query) for r in got) == [(i, *r) for i, r in enumerate(rows)]


def test_paths_count_in_the_order_given(spark, tmp_path, small_splits):
    rows = write(tmp_path, [90, 40])
    names = [str(tmp_path / "part-01.tsv"), str(tmp_path / "part-00.tsv")]
    got = TSV.read_pairs(spark, names, 1, 2, None).collect()
    assert sorted((int(r.example_id), r.c0) for r in got) == [(i, r[0]) for i, r in enumerate(rows[90:] + rows[:90])]


def test_first_line_of_all_files_wins(spark, tmp_path, small_splits):
    rows = write(tmp_path, [50, 150, 5, 80])
    first = {}
    for i, (_, q, p) in enumerate(rows):
        first.setdefault(q, (i, q, p))
    got = SHD.read_raw_pairs(spark, str(tmp_path)).collect()
    assert sorted((r.line_no, r.c0, r.c1) for r in got) == sorted(first.values())


def test_lines_are_not_shuffled_for_their_numbers(spark, tmp_path):
    write(tmp_path, [5, 5])
    plan = SHD.read_numbered(spark.read.text, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    rows = plan[:plan.index("BroadcastExchange")]
    assert "Exchange" not in rows.replace("BroadcastExchange", "")
