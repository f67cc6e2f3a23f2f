"""Near-duplicate groups by min-max hashing.

Two documents are linked if their sets of word shingles have a Jaccard
similarity of at least 0.8; a group is what links connect.

1. **Signatures.**  Every permutation of the shingles gives two values, the
   least and the greatest, so ``BANDS * ROWS`` values cost half as many hash
   evaluations.  Equal sets (by a 64-bit digest) form a class, a node of the
   graph; only the document with its smallest doc_id goes on.
2. **Stars.**  Nodes that share a band of ``ROWS`` values meet in a bucket.
   The smallest one of a bucket is its hub, found by a sum that each task makes
   first.  Each node is compared with the hub it meets most, then with its
   other hubs outside its own component.
3. **Rest.**  A bucket may still hold several components.  Each document outside
   its largest one is then compared with all of the others: in a small bucket
   as pairs; else with that whole component and the other documents left over
   beside it, in blocks whose sets are compared as matrices, so that no pair
   becomes a row.  So no pair that meets in a bucket is left open unless it is
   connected already, and a large group of copies costs a star.
4. Every link is confirmed on the full sets (64-bit hashes of the shingles).

A pair at exactly 0.8 misses all 50 bands of 6 with probability 2.5e-7; more
similar pairs are missed more rarely.

Words are what stands between ASCII white space, A-Z lower-cased.  A text with
fewer words than a shingle has is one shingle; one without words (or null) has
none and is linked with nothing.  Rows without a doc_id are linked with
nothing and kept.  Rows that repeat a doc_id are one document: each of its texts
is compared as a node of its own, then they are linked with each other.  They all
get one ``component_id`` and stay or go together.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, ship, stored, table

BANDS, ROWS = 50, 6
#: Pairs of an open bucket above which they are compared in blocks, and the
#: shingles in a block's side.
OPEN_PAIRS, BLOCK_SHINGLES = 256, 1_000_000
CACHE_WORDS = 400_000

_hashes: dict[bytes, int] = {}


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    n = BANDS * ROWS // 2
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    new = set(found).difference(_hashes)
    if len(_hashes) + len(new) > CACHE_WORDS:
        _hashes.clear()
        new = set(found)
    for w in new:
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(found) - size + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, size, np.uint64)
        for j in range(size):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(acc)


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, in turn."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(a), np.uint32)
    # linear permutations of 32 well mixed bits
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    for start in range(0, len(x), 1024):
        with np.errstate(over="ignore"):
            v = x[start:start + 1024] * a[:, None] + b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number in it."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return acc.view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    """The node of a set: its digest."""
    return int(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), np.int64)[0])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, node, bands``: set size, node, band keys (null
    without shingles)."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants()
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), bands.append(None)
                    continue
                nodes.append(node_of(s))
                bands.append(band_keys(min_max(s, a, b)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bands"])

    return docs.mapInArrow(signed, "doc_id long, n_shingles long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` (array of long, distinct) of the texts that have any."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [x for t in part.column(1) if len(x := shingle_set(t.as_py(), words))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(sets, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough (in hundredths)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node it
    reaches.  Large and small stars in turn: an edge's smaller end moves to the
    smallest neighbour of that end, then all smaller neighbours of a node move
    to its smallest one, until only stars are left (a logarithmic number of
    rounds, also for a chain)."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        low = stored(edges.groupBy("b").agg(F.min("a").alias("low")), "low")
        inner = edges.join(low.select(F.col("b").alias("a")), "a", "left_semi")
        if low.count() == edges.count() and inner.isEmpty():
            roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
        large = (edges.join(low.select(F.col("b").alias("a"), "low"), "a", "left")
                 .select(F.coalesce("low", "a").alias("a"), "b").distinct())
        large = stored(large, "large")
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (large.join(least, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
                 .unionByName(least.select(F.col("low").alias("a"), "b")).distinct())
        edges = stored(small, "edges")


def _labelled(rows: DataFrame, labels: DataFrame, col: str, name: str) -> DataFrame:
    return (rows.join(labels.withColumnRenamed("node", col).withColumnRenamed("root", name), col, "left")
            .withColumn(name, F.coalesce(name, col)))


def similar_rows(x: list[np.ndarray], y: list[np.ndarray], similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sorted sets that are similar enough: a matrix
    product over the elements that both sides have."""
    xs, ys = np.concatenate(x), np.concatenate(y)
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    shared = np.intersect1d(xs, ys)
    if not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def matrix(flat, sizes):
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        there = shared[at] == flat
        out = np.zeros((len(sizes), len(shared)), np.float32)
        out[np.repeat(np.arange(len(sizes)), sizes)[there], at[there]] = 1
        return out

    both = (matrix(xs, nx) @ matrix(ys, ny).T).astype(np.int64)  # whole numbers below 2^24 are exact
    return np.nonzero(100 * both >= similarity * (nx[:, None] + ny[None, :] - both))


def _in_blocks(left: DataFrame, placed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links ``a, b`` between each node of ``left`` (main, node) and the
    component ``main`` (of ``placed``: node, main) with all others left beside
    it.  Both sides are cut into slices of about ``BLOCK_SHINGLES``; a task
    compares one slice with one."""
    whole = placed.join(left.select("main").distinct(), "main", "left_semi").select("main", "node").unionByName(left)

    def sliced(rows: DataFrame) -> DataFrame:
        rows = rows.join(sets, "node")
        total = rows.groupBy("main").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES).cast("int").alias("slices"))
        return stored(rows.join(total, "main").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")), "slices")

    x, y = sliced(left), sliced(whole)
    nx = x.select("main", F.col("slices").alias("other")).distinct()
    ny = y.select("main", F.col("slices").alias("other")).distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("other") - 1))
    x = x.join(ny, "main").select("main", F.col("slice").alias("sx"), every.alias("sy"), "node", "shingles")
    y = y.join(nx, "main").select(F.col("main").alias("of"), every.alias("tx"), F.col("slice").alias("ty"), F.col("node").alias("other"), F.col("shingles").alias("elements"))

    def compared(left_rows, right_rows):
        import pandas as pd

        out = []
        ids, other = left_rows["node"].to_numpy(), right_rows["other"].to_numpy()
        a, b = left_rows["shingles"].tolist(), right_rows["elements"].tolist()
        a, b = [np.sort(v) for v in a], [np.sort(v) for v in b]
        for i in range(0, len(a), 256):
            for j in range(0, len(b), 512):
                p, q = similar_rows(a[i:i + 256], b[j:j + 512], similarity)
                out.append(np.stack([ids[i + p], other[j + q]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        found = found[:, found[0] != found[1]]
        return pd.DataFrame({"a": found.min(axis=0), "b": found.max(axis=0)}).drop_duplicates()

    return x.groupBy("main", "sx", "sy").cogroup(y.groupBy("of", "tx", "ty")).applyInPandas(compared, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; ``words`` per
    shingle, ``similarity`` in hundredths."""
    ship(docs.sparkSession)
    texts = doc_texts(docs, id_col, text_col)
    signed = stored(signatures(texts, words), "signatures")

    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    reps = full.select("doc_id", "node", "bands").join(classes.select(F.col("rep").alias("doc_id"), "node"), ["doc_id", "node"], "left_semi")
    met = reps.select("node", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("bucket", "hub")
    members = stored(met.join(shared, "bucket"), "buckets")

    # stars: first the hub that a document meets most
    stars = stored(members.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("times")), "stars")
    seen = members.select("node").distinct()
    read = classes.join(seen, "node", "left_semi").select(F.col("rep").alias("doc_id"))
    sets = stored(shingle_sets(texts.join(read, "doc_id", "left_semi"), words).dropDuplicates(["node"]), "sets")
    first = stars.groupBy("b").agg(F.min_by("a", F.struct(-F.col("times"), "a")).alias("a"))
    # the texts of one doc_id are linked whatever they hold
    ids = stored(full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")), "ids")
    same = full.select("doc_id", F.col("node").alias("b")).join(ids.where("a <> z").select("doc_id", "a"), "doc_id").where("a <> b").select("a", "b").distinct()
    links = stored(confirmed(first, sets, similarity).unionByName(same), "links")
    labels = components(links)
    others = _labelled(_labelled(stars, labels, "a", "ra"), labels, "b", "rb").where("ra <> rb").select("a", "b").join(first, ["a", "b"], "left_anti")
    more = stored(confirmed(others, sets, similarity), "links")
    if not more.isEmpty():
        links = stored(links.unionByName(more), "links")
        labels = components(links)

    # the rest: buckets with several components
    placed = _labelled(members.select("bucket", "hub", "node"), labels, "node", "root")
    by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    spread = (by_root.groupBy("bucket").agg(F.sum("n").alias("total"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("parts"))
              .where("parts > 1 and total > 2"))
    open_ = stored(placed.join(spread.select("bucket", F.col("top.root").alias("main"), ((F.col("total") - F.col("top.n")) * F.col("total")).alias("pairs")), "bucket"), "open")
    if not open_.isEmpty():
        few = F.col("pairs") <= OPEN_PAIRS
        out = open_.where(few & (F.col("root") != F.col("main"))).select("bucket", "hub", F.col("node").alias("x"), F.col("root").alias("rx"))
        all_ = open_.where(few).select("bucket", F.col("node").alias("y"), F.col("root").alias("ry"))
        pairs = (out.join(all_, "bucket").where("rx <> ry and x <> hub and y <> hub")
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        rest = confirmed(pairs, sets, similarity)
        left = open_.where(~few & (F.col("root") != F.col("main"))).select("main", "node").distinct()
        left = stored(left, "left")
        if not left.isEmpty():
            rest = rest.unionByName(_in_blocks(left, _labelled(seen, labels, "node", "main"), sets, similarity))
        rest = stored(rest, "links")
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))

    # a component is called by its smallest doc_id
    linked = stored(labels.join(classes.select("node", "rep"), "node"), "linked")
    named = (linked.join(linked.groupBy("root").agg(F.min("rep").alias("component")), "root").select("node", "component")
             .unionByName(classes.where("n > 1").join(linked, "node", "left_anti").select("node", F.col("rep").alias("component"))))
    # a text without shingles goes with the others of its doc_id
    empty = F.col("n_shingles") == 0
    rows = (signed.where(~empty).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
            .unionByName(signed.where(empty).select("doc_id", "n_shingles").join(ids.select("doc_id", F.col("a").alias("node")), "doc_id", "left")))
    out = rows.join(named, "node", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each group; all rows of its doc_id stay,
    also equal ones."""
    kept = near_duplicates(docs, words, similarity).where("kept").select(F.col("doc_id").alias("_llm_kept"))
    return docs.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_llm_kept")), "left_semi")


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 2-word shingles are similar by 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


#: All pairs that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
      FROM w, unnest(range(1, greatest(len(words), 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * met >= 80 * (na.n + nb.n - met)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS doc_id, a AS root FROM e2 UNION SELECT e2.b, reach.root FROM reach JOIN e2 ON e2.a = reach.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id,
       coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
