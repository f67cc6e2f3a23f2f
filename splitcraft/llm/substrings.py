"""Removing repeated passages: 50-byte strings that a document with a smaller
doc_id holds as well.

1. **Anchors.**  Every 50-byte window has an anchor, its least 24-byte gram by a
   hash.  Equal windows have equal anchors, so a window whose anchor stands in
   one document only can't be a repeat.  Anchors are a fourteenth of all
   positions; a task packs them by slices of their hash, with the first and the
   last document of each within a piece of text, and a slice is sorted at once.
2. **Shards.**  Around each anchor of several documents, the bytes of all windows
   that hold it go to the shard of that anchor.  A shard sorts the suffixes of
   its bytes by external induced sorting (``induced.py``); windows with a common
   prefix of 50 bytes are one string, repeated for all documents but its first.
   A shard has about ``SHARD_BYTES``; its queues go to disk beyond a bound.
3. **Hot anchors** with more rows than a shard are no shard: their windows are
   dealt by their own hashes, the first document of each is found by an
   aggregation that every task starts on its own, and joined back.
4. Each document's repeated windows are removed from its bytes.

Whole copies of an earlier text skip the steps: all of their bytes go, if there
are 50.  Strings are judged on the input.  Null and empty texts have no windows.
Rows with one doc_id don't remove each other.  A missing doc_id is larger than
every other.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import ship, stored, table
from splitcraft.llm.induced import DEPTH as WIDTH
from splitcraft.llm.induced import equal_runs, keys_at, sorted_suffixes
from splitcraft.llm.tokencount import rounds

GRAM = 24
#: Bytes of text that are looked at together, bytes of a shard, anchors in a
#: slice, and anchors up to which their keys are sent to all workers.
PIECE_BYTES, SHARD_BYTES, SLICE_ANCHORS, SENT_KEYS = 1_000_000, 2_000_000, 400_000, 8_000_000
#: Rows of an anchor from which it is hot: four shards, which a task still sorts
#: in about 200 MB.
HOT_ROWS = 4 * SHARD_BYTES // (2 * WIDTH - GRAM)
LAST_ID = (1 << 63) - 1

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    n, y = 1, x
    while 2 * n <= width:
        y, n = op(y[:-n], y[n:]), 2 * n
    return op(y[:len(y) - (width - n)], y[width - n:]) if n < width else y


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of the windows of ``data``; ``ends``
    holds the end of the document of each byte."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, _MULT, np.uint64))
        undo = np.cumprod(np.full(n, _INVERSE, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        h = _mix((total[GRAM:] - total[:-GRAM]) * undo[:n - GRAM + 1])
    rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    span = WIDTH - GRAM + 1
    least = _sliding(rank, span, np.minimum)
    inside = np.arange(n - WIDTH + 1) + WIDTH <= ends[:n - WIDTH + 1]
    least = np.where(inside, least, np.uint32(0))
    edge = np.zeros(span - 1, np.uint32)
    chosen = _sliding(np.concatenate([edge, least, edge]), span, np.maximum) == rank
    at = np.flatnonzero(chosen)
    return at, h[at]


def _pieces(batches: Iterator[pa.RecordBatch], columns: int):
    """Documents in groups of about ``PIECE_BYTES``: (columns of lists, bytes,
    the lengths of the documents)."""
    rows, texts, held = [], [], 0

    def piece():
        sizes = np.array([len(t) for t in texts], np.int64)
        return list(zip(*rows)), np.frombuffer(b"".join(texts), np.uint8), sizes

    for batch in batches:
        lists = [batch.column(i) for i in range(columns)]
        for i in range(batch.num_rows):
            rows.append(tuple(c[i].as_py() for c in lists[:-1]))
            texts.append(lists[-1][i].as_py().encode())
            held += len(texts[-1])
            if held >= PIECE_BYTES:
                yield piece()
                rows, texts, held = [], [], 0
    if rows:
        yield piece()


def shared_anchors(texts: DataFrame, slices: int) -> DataFrame:
    """``slice, keys, rows``: packed anchors (32 bits below the slice's number)
    of several documents, and in how many rows each stands."""
    bits = slices.bit_length() - 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, _), data, sizes in _pieces(batches, 3):
            at, h = anchors(data, np.repeat(np.cumsum(sizes), sizes))
            if not len(at):
                continue
            key = h >> np.uint64(32 - bits)
            doc = np.array(ids, np.int64)[np.searchsorted(np.cumsum(sizes), at, side="right")]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.concatenate([first[1:], [len(key)]]) - 1
            n = (last - first + 1).astype(np.uint32)
            more = doc[last] != doc[first]
            # first document of each anchor with the count; the last one with none
            k = np.concatenate([key[first], key[last[more]]])
            d = np.concatenate([doc[first], doc[last[more]]])
            c = np.concatenate([n, np.zeros(more.sum(), np.uint32)])
            part = (k >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((d, part))
            k, d, c, part = k[order].astype(np.uint32), d[order], c[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays([
                pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (k, d, c))], names=["slice", "key", "doc", "n"])

    def met(group: pd.DataFrame) -> pd.DataFrame:
        k = np.frombuffer(b"".join(group["key"]), np.uint32)
        d = np.frombuffer(b"".join(group["doc"]), np.int64)
        c = np.frombuffer(b"".join(group["n"]), np.uint32)
        order = np.argsort(k, kind="stable")
        k, d, c = k[order], d[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        n = np.add.reduceat(c, first)[several]
        return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "keys": [k[first][several].tobytes()], "rows": [n.tobytes()], "n": [int(n.sum())], "keys_n": [len(n)]})

    packed_rows = texts.select("doc_id", "row", "text").mapInArrow(packed, "slice int, key binary, doc binary, n binary")
    return stored(packed_rows.groupBy("slice").applyInPandas(met, "slice int, keys binary, rows binary, n long, keys_n long"), "anchors")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], np.uint32).astype(np.uint64) | np.uint64(row["slice"] << 32)
    return keys, np.frombuffer(row["rows"], np.int64)


def contexts(texts: DataFrame, slices: int, wanted) -> DataFrame:
    """``key, context, doc_id, row, start``: for every anchor whose key is
    wanted, the bytes of all windows that hold it.  ``wanted`` is a broadcast
    sorted array, or None if the rows bring their own in ``keys``."""
    bits = slices.bit_length() - 1
    span = WIDTH - GRAM

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, data, sizes in _pieces(batches, 3 if wanted is not None else 4):
            ids, rows = columns[:2]
            stops = np.cumsum(sizes)
            at, h = anchors(data, np.repeat(stops, sizes))
            key = (h >> np.uint64(32 - bits)).astype(np.int64)
            doc = np.searchsorted(stops, at, side="right")
            if wanted is not None:
                sent = wanted.value
                place = np.minimum(np.searchsorted(sent, key), max(len(sent) - 1, 0))
                there = sent[place] == key if len(sent) else np.zeros(len(key), bool)
            else:
                there = np.zeros(len(key), bool)
                for i in np.unique(doc):
                    mine = doc == i
                    there[mine] = np.isin(key[mine], np.array(columns[2][i], np.int64))
            at, key, doc = at[there], key[there], doc[there]
            low = np.maximum(at - span, (stops - sizes)[doc])
            high = np.minimum(at + WIDTH, stops[doc])
            raw = data.tobytes()
            for a in range(0, len(at), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[s], pa.int64()), pa.array([raw[x:y] for x, y in zip(low[s].tolist(), high[s].tolist())], pa.binary()),
                    pa.array(np.array(ids, np.int64)[doc[s]], pa.int64()), pa.array(np.array(rows, np.int32)[doc[s]], pa.int32()),
                    pa.array((low[s] - (stops - sizes)[doc[s]]), pa.int64())], names=["key", "context", "doc_id", "row", "start"])

    take = ["doc_id", "row", "text"] if wanted is not None else ["doc_id", "row", "keys", "text"]
    return texts.select(*take).mapInArrow(around, "key long, context binary, doc_id long, row int, start long")


def repeats_in(group: pd.DataFrame) -> pd.DataFrame:
    """One shard: for each row the windows that an earlier document holds, as
    the bits of ``windows`` (bit j: the one that starts j bytes into it)."""
    which, found = pd.factorize(group["context"])
    docs = group["doc_id"].to_numpy()
    first = np.full(len(found), LAST_ID, np.int64)
    np.minimum.at(first, which, docs)
    sizes = np.array([len(c) for c in found], np.int64)
    # anchors that always stand in the same bytes need no sorting
    pairs = pd.DataFrame({"key": group["key"].to_numpy(), "which": which}).drop_duplicates()
    several = pairs.groupby("key")["which"].transform("size").to_numpy() > 1
    sorted_too = np.unique(pairs["which"].to_numpy()[several])
    data = np.frombuffer(b"".join(found[sorted_too]), np.uint8)
    own_sizes = sizes[sorted_too]
    begin = np.cumsum(own_sizes) - own_sizes
    of = np.repeat(np.arange(len(sorted_too)), own_sizes)
    offset = np.arange(len(data)) - begin[of] if len(data) else np.zeros(0, np.int64)
    starts = sorted_suffixes(data)
    starts = starts[offset[starts] + WIDTH <= own_sizes[of[starts]]]
    run = equal_runs(data, starts)
    of = sorted_too[of[starts]]
    own = first[of]
    least = np.full(run[-1] + 1 if len(run) else 0, LAST_ID, np.int64)
    np.minimum.at(least, run, own)
    again = least[run] < own
    bits = np.zeros(len(found), np.int64)
    np.bitwise_or.at(bits, of[again], np.int64(1) << offset[starts[again]])
    every = (np.int64(1) << (sizes - WIDTH + 1)) - 1
    windows = np.where(docs > first[which], every[which], bits[which])
    out = group.loc[windows != 0, ["doc_id", "row", "start"]]
    return out.assign(windows=windows[windows != 0])


def _hot_windows(rows: DataFrame) -> DataFrame:
    """The same for hot anchors, by an aggregation over their windows."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                part = batch.slice(a, 5000)
                found = part.column(1).to_pylist()
                sizes = np.array([len(c) for c in found], np.int64)
                data = np.frombuffer(b"".join(found), np.uint8)
                each = sizes - WIDTH + 1
                of = np.repeat(np.arange(len(found)), each)
                offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                place = (np.cumsum(sizes) - sizes)[of] + offset
                w = [np.zeros(len(place), np.uint64), np.ones(len(place), np.uint64)]
                with np.errstate(over="ignore"):
                    for word in keys_at(data, place):
                        w = [_mix(x * np.uint64(_MULT) + word) for x in w]
                take = lambda i: part.column(i).to_numpy(zero_copy_only=False)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[0].view(np.int64)), pa.array(w[1].view(np.int64)), pa.array(take(2)), pa.array(take(3)), pa.array(take(4) + offset)],
                    names=["w1", "w2", "doc_id", "row", "start"])

    each = rows.mapInArrow(windows, "w1 long, w2 long, doc_id long, row int, start long")
    # stored, so that the join has both sides' rows freshly dealt and Spark can split
    # a window with very many places
    first = stored(each.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                   .where("first < last").drop("last"), "windows")
    return each.join(first, ["w1", "w2"]).where("doc_id > first").select("doc_id", "row", "start", F.lit(1).cast("long").alias("windows"))


def repeated_windows(texts: DataFrame, size: int) -> DataFrame:
    """``doc_id, row, start, windows`` for ``texts`` (doc_id, row, text) of
    about ``size`` bytes."""
    spark = texts.sparkSession
    slices = 1 << max(0, int(np.ceil(np.log2(max(1, size / (WIDTH - GRAM + 2) * 2 / SLICE_ANCHORS)))))
    shared = shared_anchors(texts, slices)
    total, keys = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("keys_n"), F.lit(0))).first()
    shards = max(1, -(-total * (2 * WIDTH - GRAM) // SHARD_BYTES))

    # hot anchors are few: each has more than HOT_ROWS rows
    hot_rows = HOT_ROWS

    def hot_of(group_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in group_rows:
            for row in batch.to_pylist():
                k, n = _unpacked(row)
                yield pa.RecordBatch.from_arrays([pa.array(k[n > hot_rows].astype(np.int64), pa.int64())], names=["key"])

    hot = np.sort(np.array([r["key"] for r in shared.mapInArrow(hot_of, "key long").collect()], np.int64))
    sent_hot = spark.sparkContext.broadcast(hot)
    if keys <= SENT_KEYS:
        sent = np.sort(np.concatenate([np.zeros(0, np.int64), *(_unpacked(r)[0].astype(np.int64) for r in shared.toLocalIterator())]))
        rows = contexts(texts, slices, spark.sparkContext.broadcast(np.setdiff1d(sent, hot)))
    else:
        def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    k = _unpacked(row)[0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.setdiff1d(k, sent_hot.value), pa.int64())], names=["key"])

        bits = slices.bit_length() - 1

        def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (ids, own), data, sizes in _pieces(batches, 3):
                stops = np.cumsum(sizes)
                at, h = anchors(data, np.repeat(stops, sizes))
                doc = np.searchsorted(stops, at, side="right")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(ids, np.int64)[doc], pa.int64()), pa.array(np.array(own, np.int32)[doc], pa.int32()),
                    pa.array((h >> np.uint64(32 - bits)).astype(np.int64), pa.int64())], names=["doc_id", "row", "key"])

        mine = (texts.select("doc_id", "row", "text").mapInArrow(own_keys, "doc_id long, row int, key long").distinct()
                .join(shared.mapInArrow(as_rows, "key long"), "key", "left_semi").groupBy("doc_id", "row").agg(F.collect_list("key").alias("keys")))
        rows = contexts(texts.join(mine, ["doc_id", "row"]), slices, None)
    out = (rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
           .groupBy("shard").applyInPandas(repeats_in, "doc_id long, row int, start long, windows long"))
    if len(hot):
        out = out.unionByName(_hot_windows(stored(contexts(texts, slices, sent_hot), "hot")))
    return out


def covered(sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each byte of some documents, one after the other, is in one of
    the windows; a negative start stands for all bytes."""
    begin = np.cumsum(sizes) - sizes
    part = start >= 0
    at, bits = begin[doc[part]] + start[part], windows[part]
    at = np.concatenate([at[(bits >> j) & 1 == 1] + j for j in range(WIDTH - GRAM + 1)])
    n = sizes.sum() + WIDTH + 1
    gone = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + WIDTH, minlength=n))[:sizes.sum()] > 0
    whole = np.zeros(len(sizes), bool)
    whole[doc[start < 0]] = True
    return gone | np.repeat(whole, sizes)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the removed runs (start, stop in
    bytes) and the bytes that stay, for every row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.hash(text).alias("row"), text.alias("text"))
    long = F.octet_length("text") >= WIDTH
    # whole copies of an earlier text
    mark = [F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(7), "text").alias("m2")]
    marks = stored(texts.where(long).select("doc_id", "row", F.octet_length("text").cast("long").alias("size"), *mark), "marks")
    firsts = stored(marks.groupBy("m1", "m2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .where("first < last").drop("last"), "firsts")
    copies = stored(marks.join(firsts, ["m1", "m2"]).where("doc_id > first").select("doc_id", "row").distinct(), "copies")
    size = marks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    windows = repeated_windows(texts.where(long).join(copies, ["doc_id", "row"], "left_anti"), size)
    parts = windows.unionByName(copies.select("doc_id", "row", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("windows")))
    gone = parts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows")).alias("parts"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in rounds(pc.binary_length(batch.column(1)).to_pylist(), 4 * PIECE_BYTES):
                ids, texts, parts = (batch.column(i).slice(a, b - a) for i in range(3))
                texts = [t.encode() for t in texts.to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                flat = parts.flatten()
                doc = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
                gone = covered(sizes, doc, *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)))
                spans, kept = [], []
                for text, stop in zip(texts, np.cumsum(sizes)):
                    mine = gone[stop - len(text):stop]
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]))).tolist() if mine.any() else []
                    spans.append([{"start": x, "stop": y} for x, y in zip(flips[::2], flips[1::2])])
                    kept.append(b"".join(text[x:y] for x, y in zip([0, *flips[1::2]], [*flips[::2], len(text)])) if flips else text)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"])

    out = (texts.join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "parts")
           .mapInArrow(removed, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and a digest of what stays."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
