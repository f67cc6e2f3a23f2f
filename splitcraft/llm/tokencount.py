"""Token counts: lengths only, by Arrow batches of bounded bytes.

The counts are those of a sentencepiece model.  A long text is cut at safe
boundaries before it is encoded: in front of a blank that follows something
else.  The cut is safe when no piece of the model holds such a pair, which is
tested for every piece as the model is loaded; a model that fails the test
gets its texts whole.  The parts between cuts are mostly single words, so a
worker encodes each distinct one once per cache filling and adds up lengths.

Null and empty texts count 0 tokens.  Repeated rows each get their own count.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, ship, table

#: Bytes of text that one round of a worker holds as Python strings.
ROUND_BYTES = 2_000_000
#: Parts whose counts a worker remembers before it starts anew.
CACHE_PARTS = 300_000

_PART = re.compile(r" +[^ ]*")
_BLANK = "▁"
_models: dict[bytes, tuple] = {}


def load_model(model: bytes):
    """(processor, safe, counts so far, counts to start from); safe if cutting
    in front of blanks loses nothing."""
    import sentencepiece

    if model not in _models:
        _models.clear()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        crossing = any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)
        # the blank in front of a text, and blanks kept as they are
        plain = "".join(sp.encode("a  b ", out_type=str)) == f"{_BLANK}a{_BLANK}{_BLANK}b{_BLANK}"
        blank = len(sp.encode("a ")) - len(sp.encode("a"))  # a last blank; alone it would be an empty text
        _models[model] = (sp, plain and not crossing, {" ": blank}, {" ": blank})
    return _models[model]


def rounds(sizes: list[int], most: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes; a longer row is alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def count_batch(texts: list[str], model: bytes) -> list[int]:
    """Tokens of each text."""
    sp, safe, known, first = load_model(model)
    if not safe:
        return [len(x) for x in sp.encode(texts, num_threads=1)]
    # the processor puts a blank before what it encodes, so the part " ab" is
    # encoded as "ab"; the blank before the whole text makes its first part one
    # (the model's own blank sign in a text counts as a blank for it)
    parts = [_PART.findall(" " + t.replace(_BLANK, " ")) if t else [] for t in texts]
    new = list(set().union(*parts).difference(known))
    if len(known) + len(new) > CACHE_PARTS:
        known.clear()
        known.update(first)
        new = list(set().union(*parts).difference(known))
    start = 0
    while start < len(new):  # balanced by bytes: a few long parts or many short ones
        stop, held = start, 0
        while stop < len(new) and (stop == start or held + len(new[stop]) <= 250_000):
            held += len(new[stop])
            stop += 1
        group = new[start:stop]
        known.update(zip(group, map(len, sp.encode([p[1:] for p in group], num_threads=1))))
        start = stop
    get = known.__getitem__
    return [sum(map(get, p)) for p in parts]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row.  The model file is read by
    the driver and sent to the workers once; it has the fixed size of its
    vocabulary."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for start, stop in rounds(sizes):
                tokens = count_batch(texts.slice(start, stop - start).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), pa.array(sizes[start:stop], pa.int64()), pa.array(tokens, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])

    return doc_texts(docs, id_col, text_col).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


#: Tokens above which a document is reported as over the limit.
TOKEN_LIMIT = 4096


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model, and whether they
    are more than 4096.  Null or empty text: 0 bytes, 0 tokens."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
