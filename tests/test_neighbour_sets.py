"""Neighbourhood sets against a plain loop that serves one set after another."""
import hashlib
import math
import random

import pytest

import __spark_entry__ as E
from splitcraft.operators import neighbours as NB
from splitcraft.oracle import compare
from tests.conftest import SF_SMALL


@pytest.fixture()
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def uniform(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52


def serve_plainly(lists, rows, k, seed=0):
    """``lists``: set -> [(template, c)] from near to far; ``rows``: template ->
    ids in their random order.  Returns set -> ids taken at its turn."""
    used, out = set(), {}
    for j in sorted(lists):
        near, held = [], 0
        for n, (t, _) in enumerate(lists[j]):
            if n >= k and held >= k:
                break
            near.append(t)
            held += sum(r not in used for r in rows.get(t, []))
        keyed = []
        for t in near:
            ids = rows.get(t, [])
            c, key = len(ids), 0.0
            first = math.floor(uniform(j, seed, t, "offset") * c)
            for i in range(c):
                key += -math.log(uniform(j, seed, t, i)) / (c - i)
                keyed.append((key, ids[(first + i) % c]))
        out[j] = [r for _, r in sorted(x for x in keyed if x[1] not in used)[:k]]
        used.update(out[j])
    return out


def contended(pool):
    """A small pool of which about all rows are wanted; its sets are numbered
    among those of the other pools."""
    rng = random.Random(pool)
    n_t, k = rng.randint(2, 5), 2
    rows = {f"p{pool}t{t}": [f"p{pool}r{t}.{i}" for i in range(rng.choice([0, 1, 3, 8]))] for t in range(n_t)}
    left = sum(map(len, rows.values()))
    favourite = rng.sample(sorted(rows), n_t)
    lists = {}
    for j in range(max(1, left // k + rng.randint(-1, 2))):
        order = favourite if rng.random() < 0.7 else rng.sample(sorted(rows), n_t)
        lists[j * POOLS + pool] = [(t, len(rows[t])) for t in order]
    return lists, rows, k


POOLS = 20


def test_sets_equal_a_serial_loop(spark, few_partitions):
    """Twenty contended pools that share no template, served in one run."""
    pools = [contended(p) for p in range(POOLS)]
    lists = {j: near for some, _, _ in pools for j, near in some.items()}
    rows = {t: ids for _, some, _ in pools for t, ids in some.items()}
    frame = spark.createDataFrame([(j, t, n + 1, c, True) for j, near in lists.items() for n, (t, c) in enumerate(near)],
                                  "set_id long, template string, rank int, c long, complete boolean").coalesce(1)
    placed = spark.createDataFrame([(t, r, i) for t, ids in rows.items() for i, r in enumerate(ids)], "template string, id string, _pos long").coalesce(1)
    picks = NB.serve_sets(frame, lambda wanted: placed.join(wanted, "template", "left_semi"), "id", 2, start_prefix=3).collect()
    got = {j: sorted(r.id for r in picks if r.set_id == j) for j in lists}
    want = serve_plainly(lists, rows, 2)
    assert got == {j: sorted(ids) for j, ids in want.items()}
    for some, theirs, k in pools:  # short only where nothing was left
        left = sum(map(len, theirs.values()))
        for j in sorted(some):
            assert len(want[j]) == min(k, left)
            left -= len(want[j])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_neighbourhoods_widen_as_the_pool_empties(spark, few_partitions):
    """Nearly the whole pool goes into sets; lists of 2k templates are too short
    for the last ones."""
    size, k = 33, 2
    temps = ["x y", "x y z", "x q z", "a b c d", "a b c e", "a", "x y z w v", "q q q q q q q"]
    rows = [(f"e{i:03d}", f"w{i % 5}", temps[(i * i) % 8 if i % 3 else 0]) for i in range(32)]
    temps = sorted({t for _, _, t in rows})
    pool = spark.createDataFrame(rows, "example_id string, abstract_template string, template string")
    m = int(size * 0.95 // 1 // (k + 1))
    anchors = {r.set_id: (r.example_id, r.template) for r in NB.draw_anchors(pool, "example_id", "abstract_template", m).collect()}
    taken = {e for e, _ in anchors.values()}
    by_template = {t: sorted((e for e, _, x in rows if x == t and e not in taken), key=lambda e: (uniform(e, 0, "nbr", "order"), e)) for t in temps}
    lists = {}
    for j, (_, t) in anchors.items():
        others = sorted((t2 for t2 in temps if t2 != t), key=lambda t2: (edits(t.split(), t2.split()), t2))
        lists[j] = [(t2, len(by_template[t2])) for t2 in [*others, t]]
    want = serve_plainly(lists, by_template, k)
    out = NB.neighbour_sets(pool, "example_id", "abstract_template", "template", size, k).where("label = 1").collect()
    for j in anchors:
        assert sorted(r.example_id for r in out if r.set_id == j) == sorted([anchors[j][0], *want[j]])
    assert all(len(ids) == k for ids in want.values())


def test_sets_match_the_recursive_sql(spark):
    name = "neighbour_sets"
    r = compare(spark, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert r["match"], r
