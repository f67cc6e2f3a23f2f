"""Repeated passages of words by fixed-block anchors.

Every document is cut into non-overlapping blocks of ten words, counted from
its first word; they are the index.  Every rolling window of ten words probes
it.  A passage of twenty words that stands elsewhere covers a whole block there,
wherever the blocks begin, so no repeat is missed.  Hits are then extended: the
windows of twenty words round a hit are compared as a whole, the smallest
document that holds each is found, and windows that start earlier elsewhere run
together to maximal repeats.  A hit is not paired with each of its copies, which
would grow with the square of a group; copies meet in a minimum instead.

How it is laid out.  The texts are written once, in chunks of about 2 MB, to a
table in the shared folder that is bucketed by chunk, so that answers come back
to the chunks without moving the texts.  A chunk sends its distinct probe
hashes, sorted and as differences, dealt by hash; the answer is one bit for each of
them (a block of this hash exists, and another window has it).  For
the windows round hits it sends 80-bit hashes with the smallest document id it
has for each; the answer is again a bit (a smaller id holds it).  Only hits and their surroundings
reach the second exchange.  A frequent passage is sent once per chunk, never once per
place, and the exchange keys are hash ranges, which no passage can fill.

A probe hash has 32 bits and those of its range: chance agreement only makes a
window a candidate.  Twenty-word windows are taken as equal by their 80 bits.

A null text is an empty one, without words.  A null id is smaller than all
others.  Rows that share an id are not earlier than one another, so repeated
rows are all kept, each judged against smaller ids and itself.  Other columns
are not looked at.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, ship, stored, table
from splitcraft.llm.words import batches_by_bytes, packed, word_bounds
from splitcraft.session import ensure_checkpoint_dir

#: Bytes of text in a chunk, and of the chunks that one bucket of the table holds on average.
CHUNK_BYTES, BUCKET_BYTES = 2_000_000, 16_000_000
#: Hash ranges (bits) at least, and windows in one of them on average at most.
RANGE_BITS, RANGE_WINDOWS = 9, 2_000_000
#: Bytes up to which words are hashed as arrays.
ARRAY_WORD = 256
NO_ID = -(1 << 63)
#: Odd factors for two independent rolling hashes, and one for mixing.
FACTORS, MIX = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time."""
    length = stop - start
    bytes8 = np.concatenate((data, np.zeros(8, np.uint8)))
    load = np.ndarray((len(data) + 1,), "<u8", bytes8, strides=(1,))
    out = mixed(length.astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(length <= ARRAY_WORD)
    j = 0
    while len(at):
        out[at] = mixed(out[at] ^ (load[start[at] + j] & _MASK[np.minimum(length[at] - j, 8)]))
        j += 8
        at = at[length[at] > j]
    for i in np.flatnonzero(length > ARRAY_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:stop[i]], digest_size=8).digest(), "little")
    return out


def rolling(x: np.ndarray, k: int, factor: int) -> np.ndarray:
    """Polynomial hashes of every ``k`` neighbours, put together from those of
    powers of two; entry i is the window that begins at i."""
    out, size, power, width = None, 0, x, 1
    while k:
        if k & 1:
            if out is None:
                out = power
            else:  # width more neighbours behind those of out
                n = len(x) - size - width + 1
                out = out[:max(n, 0)] * np.uint64(pow(factor, width, 1 << 64)) + power[size:size + max(n, 0)]
            size += width
        k >>= 1
        if k:
            n = max(len(x) - 2 * width + 1, 0)
            power = power[:n] * np.uint64(pow(factor, width, 1 << 64)) + power[width:width + n]
            width *= 2
    return out


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each entry among them."""
    order = np.argsort(values)
    sorted_ = values[order]
    new = np.ones(len(values), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return sorted_[new], place


def both_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order by ``a`` and ``b``; ``b`` matters where 64 bits agree by chance."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    return np.lexsort((b, a)) if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any() else order


class Chunk:
    """The words of some documents and the hashes of their windows."""

    def __init__(self, data: bytes, sizes, block: int, bits: int):
        self.data = np.frombuffer(data, np.uint8)
        begins = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
        self.start, self.stop, self.first = word_bounds(WORD[self.data], begins)
        self.begins, self.block = begins, block
        self.count = np.diff(self.first)
        self.words = word_hashes(self.data, self.start, self.stop)
        self.left = np.repeat(self.first[1:], self.count) - np.arange(len(self.words))  # words up to the text's end
        #: places with a whole block behind them, and the block hash there
        self.at = np.flatnonzero(self.left >= block)
        h = mixed(rolling(self.words, block, FACTORS[0])[self.at]) if len(self.at) else np.zeros(0, np.uint64)
        #: the distinct probes in order, and which of them each place has
        self.probe, self.place = numbered(h >> np.uint64(32 - bits))

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Which probes are a block of the index, and which occur again here."""
        in_doc = self.at - np.repeat(self.first[:-1], self.count)[self.at]
        indexed = np.zeros(len(self.probe), bool)
        indexed[self.place[in_doc % self.block == 0]] = True
        return indexed, np.bincount(self.place, minlength=len(self.probe)) > 1

    def candidates(self, shared: np.ndarray, span: int) -> None:
        """Windows of ``span`` words round a hit, their hashes, and the distinct
        ones in order (``shared``: one flag for each probe)."""
        hit = np.zeros(len(self.words) + self.block, bool)
        hit[self.at[shared[self.place]]] = True
        near = np.zeros(len(self.words), bool)
        for o in range(self.block):
            near |= hit[o:o + len(near)]
        self.window = np.flatnonzero(near & (self.left >= span))
        if len(self.window):
            a, b = (mixed(rolling(self.words, span, f)[self.window]) for f in FACTORS)
        else:
            a = b = np.zeros(0, np.uint64)
        b = b >> np.uint64(48)
        order = both_sorted(a, b)
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b = a[new], b[new].astype(np.uint16)
        self.of = np.empty(len(order), np.int64)  # of each window its distinct one
        self.of[order] = np.cumsum(new) - 1

    def smallest(self, ids: np.ndarray) -> np.ndarray:
        """The smallest id that holds each distinct window."""
        self.row = np.searchsorted(self.first, self.window, side="right") - 1
        # texts without words share their begin with the next; the last of them holds the word
        self.id = ids[self.row]
        out = np.full(len(self.a), (1 << 63) - 1, np.int64)
        np.minimum.at(out, self.of, self.id)
        return out

    def covered(self, ids: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Words in windows that start earlier too (``earlier``: a smaller id than
        any here holds the distinct window)."""
        least = self.smallest(ids)
        order = np.lexsort((self.window, self.of))
        again = np.zeros(len(order), bool)  # the same row has it further in front
        again[1:] = (self.of[order][1:] == self.of[order][:-1]) & (self.row[order][1:] == self.row[order][:-1])
        marked = earlier[self.of] | (self.id > least[self.of])
        marked[order] |= again
        return self.window[marked]


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest ones and so on: the high ones are
    mostly zeros and vanish when the exchange is compressed."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def gaps(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=values[:1] * 0))


def ungaps(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unplanes(data, kind), dtype=kind)


def by_range(values: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes."""
    of = (values >> np.uint64(shift)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            yield int(of[a]), a, b


def flags_of(masks, kind: int, values: np.ndarray, shift: int) -> np.ndarray:
    """The answers of all ranges put together: a flag for each sorted hash."""
    out = np.zeros(len(values), bool)
    got = {m["range"]: m["mask"] for m in masks or () if m["kind"] == kind}
    if got:
        for r, a, b in by_range(values, shift):
            if r in got:
                out[a:b] = np.unpackbits(np.frombuffer(got[r], np.uint8), count=b - a).astype(bool)
    return out


def pack_chunks(texts: DataFrame) -> DataFrame:
    """``chunk, ids, sizes, data, n_words``: some documents in each row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def out():
            nonlocal n
            ids = np.concatenate([i for i, _, _ in held])
            sizes = np.concatenate([s for _, s, _ in held])
            data = np.concatenate([d for _, _, d in held])
            start, _, _ = word_bounds(WORD[data], np.concatenate(([0], np.cumsum(sizes))))
            n += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n - 1], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([data.tobytes()], pa.binary()), pa.array([len(start)], pa.int64())],
                names=["chunk", "ids", "sizes", "data", "n_words"])

        for batch in batches:
            for part in batches_by_bytes(batch, 1, CHUNK_BYTES):
                data, begins = packed(part.column(1))
                if held and size + len(data) > CHUNK_BYTES:
                    yield out()
                    held, size = [], 0
                held.append((part.column(0).fill_null(NO_ID).to_numpy(), np.diff(begins), data))
                size += len(data)
        if held:
            yield out()

    return texts.mapInArrow(pack, "chunk long, ids array<long>, sizes array<long>, data binary, n_words long")


def store_chunks(texts: DataFrame) -> tuple[DataFrame, int]:
    """The chunks as a table bucketed by chunk, in the shared folder."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    name = f"word_chunks_{uuid.uuid4().hex}"
    (pack_chunks(texts).write.bucketBy(min(buckets, 100_000), "chunk").option("parquet.block.size", 16 << 20).option("compression", "zstd")
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name), min(buckets, 100_000)


def repeats(docs: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` of every row: ``spans`` are the
    maximal runs of words covered by a passage of ``span`` words that also
    starts earlier (``start`` to ``stop``, end exclusive), ``kept`` the other words
    joined by blanks."""
    spark = docs.sparkSession
    ship(spark)
    block = (span + 1) // 2
    chunks, buckets = store_chunks(doc_texts(docs, id_col, text_col))
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(30, max(RANGE_BITS, (max(words, 1) // RANGE_WINDOWS).bit_length()))

    def answered(*answers: DataFrame) -> DataFrame:
        """The chunks with the answers that came back; only these move."""
        all_ = answers[0]
        for a in answers[1:]:
            all_ = all_.unionByName(a)
        masks = all_.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("kind", "range", "mask")).alias("masks"))
        return chunks.join(masks.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "sizes", "data", "masks")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in one_by_one(batches):
            x = Chunk(c["data"], c["sizes"], block, bits)
            indexed, again = x.probes()
            rows = [(r, gaps((x.probe[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")),
                     np.packbits(indexed[a:b]).tobytes(), np.packbits(again[a:b]).tobytes()) for r, a, b in by_range(x.probe, 32)]
            if rows:
                r, v, i, m = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([c["chunk"]] * len(r), pa.int64()),
                                                  *(pa.array(y, pa.binary()) for y in (v, i, m))],
                                                 names=["range", "chunk", "probes", "indexed", "again"])

    def answer(rows: pa.Table, kind: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
        ends = np.cumsum(sizes).tolist()
        masks = [np.packbits(flags[e - n:e]).tobytes() if flags[e - n:e].any() else None for n, e in zip(sizes, ends)]
        keep = [i for i, m in enumerate(masks) if m is not None]
        return pa.table({"chunk": rows.column("chunk").take(pa.array(keep, pa.int64())), "kind": pa.array([kind] * len(keep), pa.int32()),
                         "range": rows.column("range").take(pa.array(keep, pa.int64())), "mask": pa.array([masks[i] for i in keep], pa.binary())})

    def matched(rows: pa.Table) -> pa.Table:
        values = [ungaps(v, "<u4") for v in rows.column("probes").to_pylist()]
        sizes = [len(v) for v in values]
        bits_of = lambda name: np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(rows.column(name).to_pylist(), sizes)])
        value = np.concatenate(values)
        order = np.argsort(value)
        new = np.ones(len(value), bool)
        new[1:] = value[order][1:] != value[order][:-1]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        indexed = np.maximum.reduceat(bits_of("indexed")[order], first) > 0
        again = (np.maximum.reduceat(bits_of("again")[order], first) > 0) | (np.bincount(run) > 1)
        flags = np.empty(len(value), bool)
        flags[order] = (indexed & again)[run]
        return answer(rows, 1, flags, sizes)

    mask_schema = "chunk long, kind int, range int, mask binary"
    hits = stored(chunks.select("chunk", "sizes", "data").mapInArrow(probe, "range int, chunk long, probes binary, indexed binary, again binary")
                  .groupBy("range").applyInArrow(matched, mask_schema), "hits")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << (64 - bits)) - 1)
        for c in one_by_one(batches):
            if not c["masks"]:
                continue
            x = Chunk(c["data"], c["sizes"], block, bits)
            x.candidates(flags_of(c["masks"], 1, x.probe, 32), span)
            least = x.smallest(np.asarray(c["ids"], np.int64))
            rows = [(r, gaps(x.a[a:b] & low), planes(x.b[a:b]), planes(least[a:b])) for r, a, b in by_range(x.a, 64 - bits)]
            if rows:
                r, v, w, i = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([c["chunk"]] * len(r), pa.int64()),
                                                  *(pa.array(y, pa.binary()) for y in (v, w, i))],
                                                 names=["range", "chunk", "windows", "more", "least"])

    def earliest(rows: pa.Table) -> pa.Table:
        values = [ungaps(v, "<u8") for v in rows.column("windows").to_pylist()]
        sizes = [len(v) for v in values]
        a = np.concatenate(values)
        b = np.concatenate([unplanes(v, "<u2") for v in rows.column("more").to_pylist()])
        least = np.concatenate([unplanes(v, "<i8") for v in rows.column("least").to_pylist()])
        order = both_sorted(a, b)
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        flags = np.empty(len(a), bool)
        flags[order] = least[order] > smallest[np.cumsum(new) - 1]
        return answer(rows, 2, flags, sizes)

    earlier = stored(answered(hits).mapInArrow(extend, "range int, chunk long, windows binary, more binary, least binary")
                     .groupBy("range").applyInArrow(earliest, mask_schema), "earlier")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in one_by_one(batches):
            ids = np.asarray(c["ids"], np.int64)
            x = Chunk(c["data"], c["sizes"], block, bits)
            gone = np.zeros(len(x.words), bool)
            if c["masks"]:
                x.candidates(flags_of(c["masks"], 1, x.probe, 32), span)
                at = x.covered(ids, flags_of(c["masks"], 2, x.a, 64 - bits))
                edge = np.zeros(len(x.words) + 1, np.int64)
                edge[at] += 1
                edge[at + span] -= 1
                gone = np.cumsum(edge)[:-1] > 0
            yield without(x, ids, gone)

    return answered(hits, earlier).mapInArrow(removed, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string")


def without(x: Chunk, ids: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of a chunk after the words flagged as ``gone`` are taken out."""
    # every kept word with one place behind it for a blank
    length = (x.stop - x.start + 1)[~gone]
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    into = np.ones(len(out), bool)
    into[ends - 1] = False
    edge = np.zeros(len(x.data) + 1, np.int8)
    edge[x.start[~gone]] += 1
    edge[x.stop[~gone]] -= 1
    out[into] = x.data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    n_kept = np.concatenate(([0], np.cumsum(~gone)))[x.first]
    byte_of = np.concatenate(([0], ends))[n_kept]
    lo, hi = byte_of[:-1], byte_of[1:]
    blob = out.tobytes()
    kept = [blob[a:max(a, b - 1)] for a, b in zip(lo.tolist(), hi.tolist())]
    # runs of removed words, none across documents
    cut = np.zeros(len(gone) + 1, bool)
    cut[x.first] = True
    run_start = np.flatnonzero(gone & (~np.concatenate(([False], gone[:-1])) | cut[:-1])) if len(gone) else np.zeros(0, np.int64)
    run_stop = np.flatnonzero(gone & (~np.concatenate((gone[1:], [False])) | cut[1:])) + 1 if len(gone) else np.zeros(0, np.int64)
    per = np.searchsorted(run_start, x.first)
    base = np.repeat(x.first[:-1], np.diff(per))
    spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(run_start - base, pa.int64()), pa.array(run_stop - base, pa.int64())], names=["start", "stop"]))
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[x.first])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(x.count, pa.int64()), pa.array(removed, pa.int64()), spans,
         pa.array(kept, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


#: Words of a passage in the registered query.
SPAN = 20


def op12_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier passage of 20 words covers."""
    made = repeats(table(spark, sf_dir, "documents"), SPAN)
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, r, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM d),
k AS (SELECT doc_id, r, i, array_to_string(list_slice(w, i, i + {SPAN - 1}), ' ') AS k FROM s),
f AS (SELECT doc_id, r, i, min(coalesce(doc_id, {NO_ID})) OVER (PARTITION BY k) AS least, min(i) OVER (PARTITION BY k, r) AS first_here FROM k),
g AS (SELECT DISTINCT r, unnest(range(i, i + {SPAN})) AS i FROM f WHERE coalesce(doc_id, {NO_ID}) > least OR i > first_here),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.r = g.r AND u.i = g.i GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r
"""
