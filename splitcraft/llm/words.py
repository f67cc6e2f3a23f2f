"""Words of a batch of texts as arrays, for operators that hash words in bulk."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from splitcraft.llm.tokencount import rounds


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array one after another, and where each
    text begins; the last entry is the end."""
    large = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, stop, first)``: the runs of flagged bytes, none of which goes
    across the begin of a text, and the first word of each text (the last entry
    is the number of words)."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[begins] = True
    cut[-1] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False]))
    stop = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, stop, np.searchsorted(start, begins)


def batches_by_bytes(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of its column ``text``; a
    longer text is alone."""
    _, begins = packed(batch.column(text))
    for start, stop in rounds(np.diff(begins).tolist(), most):
        yield batch.slice(start, stop - start)
