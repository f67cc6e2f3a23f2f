"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: the ordinary one of the
words most common in ordinary texts, the toxic one of the same words and, before
them, the strings that toxic texts repeat in far more different surroundings
than ordinary texts do.  A window (one word) is compressed with either; the
difference of the two lengths is 0 unless the window holds toxic material, and
grows with the length of what it shares with it.  A fixed start and end that
both dictionaries hold put every window into one compressed block, where single
bytes count.

A document's differences, over its whole text, form a histogram.  Its log
likelihood ratio between toxic and ordinary texts, the number of windows over a
threshold and their share go through a logistic curve fitted on the labelled
sample, set to the share of toxic texts among all labels.

Dictionaries and curve are fitted on at most ``FIT_TOXIC`` toxic and
``FIT_ORDINARY`` ordinary documents (the first by a hash of the id).  Labels,
language, source and id are no input of a score.  Without labels every score is
0; an empty or null text has no windows and gets the score of that.  Repeated
labels of a document count as toxic if one of them is.
"""
from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, ship, stored, table

FIT_TOXIC, FIT_ORDINARY = 1500, 4500
#: Toxic strings: bytes of stems and words, least surroundings (also as a share
#: of the toxic texts), least score against chance, candidates, bytes taken.
SHORTEST, LONGEST = 5, 12
LEAST, LEAST_SHARE, LEAST_Z = 8, 0.04, 8.0
CANDIDATES, TOXIC_BYTES, COMMON_WORDS = 5000, 4096, 800
#: Differences below and above are taken as these.
LOW, HIGH = -2, 9
#: Difference from which a window counts as a hit.
HIT = 3
CACHE_WORDS = 400_000
#: What stands before and after each window (signs that texts don't hold).
FRAME = bytes((i * 37 + 11) % 128 + 128 for i in range(64))
_EDGE = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    return [w.strip(_EDGE) for w in text.lower().encode().split()]


def strings_of(word: bytes) -> Iterator[bytes]:
    """Stems of a word, and the whole word, with the blank before it."""
    word = b" " + word
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]
    if SHORTEST <= len(word) + 1 <= LONGEST + 2:
        yield word + b" "


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    ratio: np.ndarray
    curve: np.ndarray


class Meter:
    """Differences of words, each distinct one compressed once per filling."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as zs

        def compressor(content: bytes):
            params = zs.ZstdCompressionParameters(
                window_log=16, hash_log=14, chain_log=14, search_log=6, min_match=6, target_length=64,
                strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content + FRAME, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)

        # what both hold lies equally far back, so that it costs the same
        self.toxic = compressor(toxic + ordinary).compress
        self.ordinary = compressor(bytes(len(toxic)) + ordinary).compress
        self.known: dict[bytes, int] = {}

    def difference(self, word: bytes) -> int:
        window = FRAME + b" " + word + b" " + FRAME[:32]
        return max(LOW, min(HIGH, len(self.ordinary(window)) - len(self.toxic(window)))) - LOW

    def histogram(self, text: str) -> np.ndarray:
        found = words_of(text)
        new = set(found).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set(found)
        for w in new:
            self.known[w] = self.difference(w)
        return np.bincount(np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)), minlength=HIGH - LOW + 1)


def signals(histograms: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    n = np.maximum(histograms.sum(axis=1), 1)
    hits = histograms[:, HIT - LOW:].sum(axis=1)
    return np.stack([np.ones(len(n)), np.clip(histograms @ ratio, -20, 40), np.log1p(hits), hits / np.sqrt(n), np.log1p(histograms.sum(axis=1))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a little shrinkage."""
    w = np.zeros(x.shape[1])
    shrink = 1e-2 * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w = w + np.clip(step, -5, 5)
    return w


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = (labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if not counts:
        return None
    by = F.xxhash64("doc_id")
    ids = (known.where("toxic = 1").orderBy(by).limit(FIT_TOXIC)
           .unionByName(known.where("toxic = 0").orderBy(by).limit(FIT_ORDINARY)))  # bounded, so it may be broadcast
    sample = stored(docs.join(F.broadcast(ids), "doc_id").select("toxic", "text").dropDuplicates(["text"]), "labelled").repartition(16)

    def surroundings(wanted):
        def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for text in batch.column(0):
                    seen = set()
                    found = words_of(text.as_py())
                    for i, w in enumerate(found):
                        around = (found[i - 1] if i else b"") + b" " + (found[i + 1] if i + 1 < len(found) else b"")
                        for s in strings_of(w):
                            if wanted is None or s in wanted.value:
                                seen.add((s, around))
                    pairs = list(seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[0] for p in pairs], pa.binary()), pa.array([xxhash.xxh3_64_intdigest(p[1]) - (1 << 63) for p in pairs], pa.int64())],
                        names=["s", "around"])

        return lambda rows: rows.select("text").mapInArrow(emitted, "s binary, around long").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))

    toxic, ordinary = sample.where("toxic = 1"), sample.where("toxic = 0")
    texts = toxic.count()
    least = max(LEAST, int(LEAST_SHARE * texts))
    a = {bytes(r["s"]): r["n"] for r in surroundings(None)(toxic).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(CANDIDATES).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(a))
    b = {bytes(r["s"]): r["n"] for r in surroundings(wanted)(ordinary).collect()} if a else {}
    size = F.sum(F.size(F.split(F.col("text"), r"\s+")))
    share = (toxic.agg(size).first()[0] or 0) / max(1, ordinary.agg(size).first()[0] or 1)
    ranked = []
    for s, n in a.items():
        chance = (b.get(s, 0) + 0.5) * share
        if n > 4 * chance and (n - chance) / chance ** 0.5 > LEAST_Z:
            ranked.append((-n * (len(s) - SHORTEST + 1.5), s))
    taken: list[bytes] = []
    for _, s in sorted(ranked):
        if not any(s in t for t in taken) and sum(map(len, taken)) + len(s) <= TOXIC_BYTES:
            taken.append(s)
    word = F.explode(F.split(F.lower("text"), r"\s+")).alias("w")
    common = [r["w"] for r in ordinary.select(word).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "w").limit(COMMON_WORDS).collect()]
    # the best last: the nearest is found first
    material = b"".join(reversed(taken))
    base = " ".join(reversed(common)).encode()[-32768:] + b" "
    rows = sample.select("toxic", "text").mapInArrow(
        _histograms(spark.sparkContext.broadcast((material, base))), "toxic int, histogram array<long>").collect()
    if not rows:  # no labelled document is there
        return None
    h, y = np.array([r["histogram"] for r in rows], float), np.array([r["toxic"] for r in rows], float)
    sides = [(h[y == k].sum(axis=0) + 0.5) / (h[y == k].sum() + 0.5 * h.shape[1]) for k in (1, 0)]
    ratio = np.log(sides[0] / sides[1])
    curve = fit_curve(signals(h, ratio), y)
    there, all_ = (y == 1).sum() / max(1, (y == 0).sum()), counts.get(1, 0) / max(1, counts.get(0, 0))
    curve[0] += np.log(max(all_, 1e-6) / max(there, 1e-6))
    return Model(material, base, ratio, curve)


def _histograms(dictionaries):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(*dictionaries.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([meter.histogram(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.int64()))],
                names=["toxic", "histogram"])

    return measured


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row (columns doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        meter = Meter(m.toxic, m.ordinary)
        for batch in batches:
            h = np.array([meter.histogram(t.as_py()) for t in batch.column(1)], float).reshape(batch.num_rows, HIGH - LOW + 1)
            p = 1 / (1 + np.exp(-np.clip(signals(h, m.ratio) @ m.curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    ship(docs.sparkSession)
    texts = doc_texts(docs)
    model = fit(texts, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")))
    return score(texts, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
