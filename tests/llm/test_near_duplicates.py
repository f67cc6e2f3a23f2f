"""Groups by min-max hashing against all pairs."""
import random

import numpy as np
import pytest

from splitcraft.llm import minhash


def brute(rows, words, similarity=80):
    sets = {}
    for i, t in rows:
        found = (t or "").encode().lower().split()
        n = min(words, len(found))
        sets.setdefault(i, []).append(frozenset(tuple(found[k:k + n]) for k in range(len(found) - n + 1)) if found else frozenset())
    parent = {i: i for i in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, s) for i, ss in sets.items() if i is not None for s in ss]
    for k, (a, x) in enumerate(items):
        for b, y in items[:k]:
            both = len(x & y)
            if both and 100 * both >= similarity * (len(x) + len(y) - both) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("words", [2, 5])
def test_groups_equal_all_pairs(small, words):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    wanted = brute(rows, words)
    got = minhash.near_duplicates(small, words).collect()
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_wide_group_of_copies(spark, monkeypatch):
    """Copies of one text with up to a fifth of its words replaced: stars alone
    leave some open; small limits send the rest through blocks."""
    monkeypatch.setattr(minhash, "OPEN_PAIRS", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 16)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == brute(rows, 2)


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    """Each of an id's texts has its own links, in whatever order the rows
    come; all rows of the id are in one component, one without words too."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10 ** 6)}" for _ in range(60)] for _ in range(30)]
    near = lambda n: " ".join(base[n][:-2] + [f"x{rng.randrange(10 ** 6)}"] * 2)
    rows = [(100 + n, near(n)) for n in range(30)] + [(200 + n, near(n)) for n in range(30)]
    rows += [(300 + n // 3, near(n)) for n in range(24)]  # three texts of one id link three groups
    rows += [(50 + n, t) for n in range(6) for t in (near(24 + n), "") ] + [(7, near(29)), (7, "one other text"), (None, near(0))]
    wanted = brute(rows, 2)
    for order in (1, -1):
        got = minhash.near_duplicates(spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(3), 2).collect()
        assert len(got) == len(rows)
        assert all(r.component_id == wanted.get(r.doc_id) and r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_matrix_comparison_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))) for _ in range(60)]
    p, q = minhash.similar_rows(sets[:25], sets[25:], 50)
    wanted = {(i, j) for i in range(25) for j in range(35)
              if 100 * (n := len(np.intersect1d(sets[i], sets[25 + j]))) >= 50 * (len(sets[i]) + len(sets[25 + j]) - n)}
    assert set(zip(p.tolist(), q.tolist())) == wanted


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_min_and_max_estimate_similarity():
    a, b = minhash._constants()
    assert len(a) * 2 == minhash.BANDS * minhash.ROWS
    rng = np.random.default_rng(2)
    shared, x, y = (rng.integers(0, 1 << 63, n, np.uint64) for n in (800, 100, 100))
    one = minhash.min_max(np.unique(np.concatenate([shared, x])), a, b)
    other = minhash.min_max(np.unique(np.concatenate([shared, y])), a, b)
    assert abs((one == other).mean() - 0.8) < 0.1


def test_on_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(edge_docs, 2).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute(rows, 2)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.n_shingles for r in got if r.doc_id in (4, 5, 6)} == {0} and {r.n_shingles for r in got if r.doc_id in (7, 8, 9)} == {1}
    kept = minhash.drop_near_duplicates(edge_docs, 2)
    assert kept.columns == edge_docs.columns
    assert not {2, 3, 8, 11} & {r.doc_id for r in kept.collect()}
    assert minhash.near_duplicates(no_docs, 2).count() == 0
