"""Top-k search and repeated passages against brute force; toxicity held out."""
import hashlib
import math
import random

import numpy as np
import pytest

from splitcraft.llm import induced, substrings, topk, toxicity
from splitcraft.oracle import compare


def test_top_k_equals_sql(spark):
    r = compare(spark, "/root/testdata/sf0.01", "op8", topk.op8_ball_tree_top_k, topk.ORACLE)
    assert r["match"] and r["rows"] == 500


def slow_top_k(rows, every, k, scale):
    good = {(i, tuple(math.floor(float(np.float32(x)) * scale) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    best = {}
    for i, q in good:
        if i % every == 0:
            for j, v in good:
                if j != i and len(v) == len(q):
                    s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v))))
                    best[i, j] = max(best.get((i, j), s), s)
    out = []
    for i in {i for i, _ in best}:
        ranked = sorted((-s, j) for (a, j), s in best.items() if a == i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["ties", "edges", "huge"])
def test_top_k_odd_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rng = random.Random(7)
    if kind == "ties":
        rows = [(i, [float(rng.randint(-1, 1)) / 64 for _ in range(4)] if i % 3 else [0.5, 0.5, 0.0, 0.0]) for i in range(200)]
    elif kind == "edges":
        rows = [(i, [rng.random() for _ in range(3 if i % 2 else 5)]) for i in range(60)]
        rows += [(60, None), (61, [1.0, None, 0.0]), (62, [float("nan")] * 3), (63, [float("inf"), 0.0, 0.0]), (64, []), (None, [1.0, 1.0, 1.0]),
                 (5, [9.0, 9.0, 9.0]), (7, rows[7][1]), (20, [8.0, 8.0, 8.0])]
    else:
        rows = [(i, [rng.uniform(-1e30, 1e30) for _ in range(3)]) for i in range(40)] + [(100, [1e9, 2e9, -3e9])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 5, 64.0).collect()
    assert sorted(map(tuple, got)) == slow_top_k(rows, 20, 5, 64.0)
    assert topk.top_k(df.limit(0), F.lit(True), 5).count() == 0


def test_top_k_where_scaling_leaves_the_doubles(spark):
    """64 * x is beyond a double, x is not; zeros beside it."""
    from pyspark.sql import functions as F

    rows = [(0, [1.7e308, 0.0]), (1, [-1.7e308, 0.5]), (2, [0.0, 0.25]), (3, [1e-300, -0.01]), (4, [5e306, 1.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 3, 64.0).collect()))
    most = (1 << 63) - 1
    assert got == [(0, 1, 4, most), (0, 2, 2, 0), (0, 3, 3, 0), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0)]


@pytest.mark.parametrize("size", [1.0, 1e7])
def test_top_k_counts_an_id_once(spark, size):
    """An id with several top vectors takes one place, in doubles and in whole
    numbers, as candidate and as query."""
    rng = random.Random(3)
    rows = [(i, [size * rng.randint(1, 50), size * rng.randint(1, 50)]) for i in range(60)]
    rows += [(i, [size * (60 + 3 * n + i), size * 60]) for i in (7, 11, 20) for n in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 5).collect()
    assert sorted(map(tuple, got)) == slow_top_k(rows, 20, 5, 1.0)


def test_ball_tree_prunes_and_bounds():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (400, 3)) for c in (-9, 0, 9)])
    tree = topk.BallTree(x)
    q = rng.normal(size=(10, 3))
    bound = tree.bounds(q, np.sqrt((q ** 2).sum(axis=1)), list(range(len(tree.start))))
    for n, (a, b) in enumerate(zip(tree.start, tree.stop)):
        assert ((q @ x[tree.order[a:b]].T).max(axis=1) <= bound[:, n]).all()


def test_induced_order_equals_plain_sorting():
    rng = random.Random(1)
    for _ in range(300):
        a, n = rng.choice([1, 2, 3, 256]), rng.randint(0, 150)
        data = bytes(rng.randrange(a) for _ in range(n))
        got = induced.sorted_suffixes(np.frombuffer(data, np.uint8), held=rng.choice([5, 10 ** 6]))
        assert sorted(got.tolist()) == list(range(n))
        keys = [data[i:i + induced.DEPTH] for i in got]
        assert keys == sorted(keys)
        runs = induced.equal_runs(np.frombuffer(data, np.uint8), got)
        whole = [i for i in range(1, n) if max(got[i], got[i - 1]) + induced.DEPTH <= n]
        assert all((runs[i] == runs[i - 1]) == (keys[i] == keys[i - 1]) for i in whole)


def slow_removal(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s:s + 50]
            first[w] = min(first.get(w, (1 << 63)), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < ((1 << 63) - 1 if i is None else i):
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(docs):
    return sorted((str(r.doc_id), r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
                  for r in substrings.remove_repeats(docs).collect())


@pytest.mark.parametrize("sent,hot", [(8_000_000, None), (0, None), (8_000_000, 3), (0, 3)])
def test_removal_equals_brute_force(small, monkeypatch, sent, hot):
    monkeypatch.setattr(substrings, "SENT_KEYS", sent)
    if hot:
        monkeypatch.setattr(substrings, "HOT_ROWS", hot)
    assert removal(small) == slow_removal([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])


def test_removal_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 2000)
    monkeypatch.setattr(substrings, "SLICE_ANCHORS", 20)
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(40, 120))) for _ in range(12)]
    rows = [(rng.randint(0, 60), "".join(rng.choice(parts)[rng.randint(0, 9):] for _ in range(rng.randint(0, 6)))) for _ in range(80)]
    rows += [(100, "a" * 3000), (101, "a" * 2000), (102, "ab" * 300), (103, "ba" * 100), (104, "x" * 49), (105, "x" * 49), (106, "y" * 50), (107, "y" * 50)]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == slow_removal(rows)


def test_removal_on_edge_rows(edge_docs, no_docs):
    assert removal(edge_docs) == slow_removal([(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])
    assert removal(no_docs) == []


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    values, inverse, n = np.unique(np.array(scores)[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    y = np.array(labels)[order]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op3_compression_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    y = [t for _, t in labels]
    assert auc([got[i].score for i, _ in labels], y) > 0.93
    flagged = [t for i, t in labels if got[i].predicted]
    assert sum(flagged) > 0.6 * sum(y) and sum(flagged) > 0.75 * len(flagged)


def test_labels_of_held_out_rows_are_not_read(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (sorted(map(tuple, toxicity.classify(small, x).collect())) for x in (labels, turned))
    assert one == other


def test_toxicity_on_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, int(i == 15), 1) for i in range(1, 16)] + [(15, 0, 0), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    assert {r.score for r in toxicity.classify(edge_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(no_docs, labels).count() == 0
