"""Importance resampling towards the distribution of target texts.

A document's features are its words and word pairs, hashed into a fixed number
of buckets.  A bucket's gain is the scaled logarithm of its smoothed share in
the target texts over that in the documents; a document's weight is the mean
gain of its features, and with a Gumbel draw from its id added, the highest
scores are a sample in proportion to exp(weight / 1000), without replacement.

Both passes over the texts work on arrays: words are found by a table of bytes,
all checksums of a slice are computed together byte by byte, and that of a pair
follows from those of its words (a checksum moved past the second word's bytes
is a linear map, one table per length).  What the driver holds is one number per
bucket.

The cutoff is the exact key (score, id) of the last row drawn, found by a
weighted median of medians: every partition gives the median of its remaining
keys; the median of these, each weighted by its partition's remaining size, has
at least a quarter of the remaining keys on either side, so that every round
discards a quarter or more, whatever the scores are.  No task holds more than
its own partition's keys and the driver one key per partition and side.  Only the rows
drawn are sorted, by ranges.

A null text has no words.  Documents without words have no features and weight
0.  Rows with one id share their Gumbel draw; ties go to the smaller id, a null
id before all others, then to a hash of the text; equal rows are each drawn on
their own.  Extra columns are not looked at.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, row_key, ship, stored, table
from splitcraft.llm.words import batches_by_bytes, packed, word_bounds
from splitcraft.sources.shards import row_index

#: Bytes of text that are hashed together, and length up to which words are
#: hashed as arrays; longer ones are hashed one by one.
SLICE_BYTES, ARRAY_WORD = 2_000_000, 64
#: Remaining keys that are read instead of narrowed further.
FEW_KEYS = 4096
NO_ID = -(1 << 63)

#: Word signs: digits, letters (A-Z as a-z), all bytes of other signs.
LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    LOWER[_b] = _b
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)

#: The step of the checksum for one byte, by the reflected polynomial of CRC-32.
STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    STEP = np.where(STEP & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (STEP >> np.uint32(1))


def _moves() -> np.ndarray:
    """[length, byte of the checksum, its value] -> that part moved past so many
    bytes; the four parts are added without carry."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(ARRAY_WORD):
        now = STEP[now & np.uint32(255)] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


MOVES = _moves()


def checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    length = stop - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(length, ARRAY_WORD), kind="stable")
    at, size = start[order], length[order]
    short = size <= ARRAY_WORD
    at, size, rest = at[short], size[short], order[~short]
    crc = out[:len(at)].copy()
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # words with more than j bytes
        crc[:n] = STEP[(crc[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[order[short]] = ~crc
    for i in rest.tolist():
        out[i] = zlib.crc32(data[start[i]:stop[i]])
    return out


def pair_checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, crc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """CRC-32 of word, blank, next word for the words at the places ``left``."""
    right = left + 1
    reg = ~crc[left]
    blank = ~(STEP[(reg ^ np.uint32(0x20)) & np.uint32(255)] ^ (reg >> np.uint32(8)))
    length = stop[right] - start[right]
    moves = np.minimum(length, ARRAY_WORD)
    out = crc[right].copy()
    for k in range(4):
        out ^= MOVES[moves, k, (blank >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(length > ARRAY_WORD).tolist():
        first = zlib.crc32(b" ", int(crc[left[i]]))
        out[i] = zlib.crc32(data[start[right[i]]:stop[right[i]]], first)
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(of words, of pairs, first)``: the bucket of every word, the bucket of
    the pair that starts with it (-1 for a text's last word), and the first word
    of each text."""
    data, begins = packed(texts)
    data = LOWER[data]
    start, stop, first = word_bounds(data > 0, begins)
    crc = checksums(data, start, stop)
    pairs = np.full(len(start), -1, np.int64)
    last = np.zeros(len(start), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    left = np.flatnonzero(~last)
    if len(left):
        pairs[left] = pair_checksums(data, start, stop, crc, left) % np.uint32(buckets)
    return (crc % np.uint32(buckets)).astype(np.int64), pairs, first


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the column ``text``; a task sends its own
    sums only."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batches_by_bytes(batch, 0, SLICE_BYTES):
                words, pairs, _ = features(part.column(0), buckets)
                sums += np.bincount(words, minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Scaled logarithm of the ratio of smoothed shares, floored."""
    size, (t, s) = len(source), (int(target.sum()), int(source.sum()))
    return np.array([math.floor(1000 * math.log(float(a + 1) * float(s + size) / (float(b + 1) * float(t + size))))
                     for a, b in zip(target.tolist(), source.tolist())], np.int64)


def gumbel(seed, doc_id: int | None) -> int:
    """A floored, scaled Gumbel draw from seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed) -> DataFrame:
    """``doc_id, tie, n_words, n_features, weight, score`` of every row."""
    buckets = len(gain)
    gain = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_by_bytes(batch, 1, SLICE_BYTES):
                words, pairs, first = features(part.column(1), buckets)
                each = gain.value[words] + np.where(pairs >= 0, gain.value[pairs], 0)
                total = np.concatenate(([0], np.cumsum(each)))
                count = np.diff(first)
                n = np.where(count > 0, 2 * count - 1, 0)
                weight = np.where(n > 0, (total[first[1:]] - total[first[:-1]]) // np.maximum(n, 1), 0)
                noise = np.array([gumbel(seed, i) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *map(pa.array, (count, n, weight, weight + noise))],
                    names=["doc_id", "tie", "n_words", "n_features", "weight", "score"])

    rows = docs.select("doc_id", "text", row_key().alias("tie"))
    return rows.mapInArrow(score, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


def _below(a: np.ndarray, key: tuple) -> np.ndarray:
    """Which keys (columns: negated score, id, tie) come before ``key``."""
    x, y, z = key
    return (a[:, 0] < x) | ((a[:, 0] == x) & ((a[:, 1] < y) | ((a[:, 1] == y) & (a[:, 2] < z))))


def _median(a: np.ndarray) -> list[int]:
    order = np.lexsort((a[:, 2], a[:, 1], a[:, 0]))
    return a[order[(len(a) - 1) // 2]].tolist()


def weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    """The first key at which half of the weights are reached."""
    medians = sorted(medians)
    half, so_far = sum(w for _, w in medians) / 2, 0
    for key, weight in medians:
        so_far += weight
        if so_far >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int] | None:
    """The k-th smallest key of the columns ``neg, id, tie`` (None if there are
    no more than ``k``), by a weighted median of medians.

    A round is one job: every partition splits its remaining keys at the pivot
    and gives size and median of what is below, equal and above."""
    spark = keys.sparkSession
    schema = "side int, n long, neg long, id long, tie long"

    def job(lo, hi, pivot):
        def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = [np.zeros((0, 3), np.int64)]
            for b in batches:
                a = np.stack([np.asarray(c, np.int64) for c in b.columns], axis=1)
                if lo is not None:  # beyond an earlier pivot that was too small
                    a = a[~_below(a, lo) & ~(a == lo).all(axis=1)]
                if hi is not None:
                    a = a[_below(a, hi)]
                left.append(a)
            a = np.concatenate(left)
            if pivot is None:
                sides = [a[:0], a[:0], a]
            else:
                low, same = _below(a, pivot), (a == pivot).all(axis=1)
                sides = [a[low], a[same], a[~low & ~same]]
            rows = [[i, len(s), *_median(s)] for i, s in enumerate(sides) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c == 0 else pa.int64()) for c in range(5)],
                                             names=["side", "n", "neg", "id", "tie"])

        got: dict[int, list] = {0: [], 1: [], 2: []}
        for r in keys.select("neg", "id", "tie").mapInArrow(partition, schema).collect():
            got[r.side].append(((r.neg, r.id, r.tie), r.n))
        return got

    lo = hi = None
    part = job(None, None, None)[2]
    if sum(n for _, n in part) <= k or k < 1:
        return None
    while True:
        left = sum(n for _, n in part)
        if left <= FEW_KEYS:
            few = keys
            if lo is not None:
                few = few.where(F.struct("neg", "id", "tie") > _key_struct(lo))
            if hi is not None:
                few = few.where(F.struct("neg", "id", "tie") < _key_struct(hi))
            return sorted((r.neg, r.id, r.tie) for r in few.select("neg", "id", "tie").collect())[k - 1]
        pivot = weighted_median(part)
        got = job(lo, hi, pivot)
        below, same = (sum(n for _, n in got[i]) for i in (0, 1))
        if k <= below:
            hi, part = pivot, got[0]
        elif k <= below + same:
            return pivot
        else:
            lo, part, k = pivot, got[2], k - below - same


def _key_struct(key: tuple):
    return F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(key, ("neg", "id", "tie"))])


def resample(docs: DataFrame, target: DataFrame, percent: int, min_words: int, buckets: int = 10000, seed: int | str = 7,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document;
    ``rank`` counts the ``percent`` of the documents with ``min_words`` words or
    more that are drawn, in the order of the draw, and is null for all others."""
    ship(docs.sparkSession)
    docs = doc_texts(docs, id_col, text_col)
    target = target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    rows = stored(scored(docs, gains(bucket_counts(target, buckets), bucket_counts(docs, buckets)), seed), "scored")
    keyed = rows.withColumns({"neg": -F.col("score"), "id": F.coalesce("doc_id", F.lit(NO_ID))})
    able = keyed.where(F.col("n_words") >= min_words)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    wanted = percent * able.count() // 100
    if wanted == 0:
        return rows.select(*out, none)
    cut = cutoff(able, wanted)
    drawn = F.lit(True) if cut is None else F.struct("neg", "id", "tie") <= _key_struct(cut)
    drawn = drawn & (F.col("n_words") >= min_words)
    # equal rows at the cutoff may be more than fit: the places decide
    ranked = row_index(keyed.where(drawn), ["neg", "id", "tie"], "_place")
    winners = ranked.select(*out, F.when(F.col("_place") < wanted, F.col("_place") + 1).alias("rank"))
    return winners.unionByName(keyed.where(~drawn).select(*out, none))


#: Parameters of the registered query.
PERCENT, MIN_WORDS, BUCKETS, SEED = 25, 20, 10000, 7


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with at least 20 words, drawn towards the
    distribution of the ``benchmark`` texts."""
    made = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), PERCENT, MIN_WORDS, BUCKETS, SEED)
    return made.select("doc_id", "n_features", "weight", "score", "rank")
