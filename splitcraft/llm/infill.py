"""Fill-in-middle: texts cut in three and put together with the middle last.

Where a text may be cut is a set of byte offsets, one in front of every unit (a
code point, or a word with the blanks after it) and one at the end.  The set is
held as a Roaring bitmap holds its numbers: containers for 65,536 offsets each,
whichever is smallest of a sorted array, a bitmap and a list of runs, with the
number of offsets before each container.  The k-th cut is found by a search over
those numbers and a selection inside one container, so that a cut never walks
over the text in front of it, and a plain ASCII text costs one run a container.

Which form a row gets and where it is cut follows from its id and the seed
alone, so that a repeated run, or a task run again after a lost executor, gives
the same rows.  ``restore`` is the way back.

A null text counts as the empty one; an empty text, and one that holds a
separator, stays plain.  Rows with one id have the same draws, applied to each
row's own text; repeated rows give repeated results; a null id has the key
text ``''``.  Other columns are not looked at.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, ship, table
from splitcraft.llm.tokencount import rounds

#: Offsets that one container covers, and bytes of a bitmap for all of them.
BOX, BITMAP_BYTES = 1 << 16, 8192
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ArrayBox:
    """Few offsets: a sorted array; the r-th is at place r."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, r: np.ndarray) -> np.ndarray:
        return self.low[r].astype(np.int64)


class BitmapBox:
    """Many scattered offsets: a bit each, and the bits set before every word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(BOX, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, r: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, r, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(len(r), 8), axis=1, bitorder="little")
        nth = np.cumsum(bits, axis=1) == (r - self.before[word] + 1)[:, None]
        return word * 64 + nth.argmax(axis=1)


class RunBox:
    """Offsets in runs: where each begins, and how many stand before it."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start, self.before = low[first].astype(np.uint16), first.astype(np.int64)

    def select(self, r: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, r, side="right") - 1
        return self.start[run].astype(np.int64) + (r - self.before[run])


def container(low: np.ndarray):
    """The smallest container for sorted offsets below 65,536."""
    first = np.concatenate(([0], np.flatnonzero(np.diff(low) != 1) + 1))
    runs, array = 4 * len(first), 2 * len(low)
    if runs <= min(array, BITMAP_BYTES):
        return RunBox(low, first)
    return ArrayBox(low) if array <= BITMAP_BYTES else BitmapBox(low)


class Boundaries:
    """A set of offsets, given as flags of places, from which the k-th can be
    taken; the numbers before each container are cumulative cardinalities."""

    def __init__(self, flags: np.ndarray):
        self.keys, self.boxes, sizes = [], [], []
        for key, at in enumerate(range(0, len(flags), BOX)):
            low = np.flatnonzero(flags[at:at + BOX])
            if len(low):
                self.keys.append(key)
                self.boxes.append(container(low))
                sizes.append(len(low))
        self.before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks) -> np.ndarray:
        """The offsets with these ranks, counted from 0."""
        ranks = np.asarray(ranks, np.int64)
        box = np.searchsorted(self.before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for b in set(box.tolist()):
            here = box == b
            out[here] = self.keys[b] * BOX + self.boxes[b].select(ranks[here] - self.before[b])
        return out


def char_flags(text: np.ndarray) -> np.ndarray:
    """Offsets in front of each code point of UTF-8 bytes, and the end."""
    flags = np.ones(len(text) + 1, bool)
    np.not_equal(text & 0xC0, 0x80, out=flags[:-1])
    return flags


def word_flags(text: np.ndarray) -> np.ndarray:
    """Offsets in front of each word that follows a blank; begin and end."""
    blank = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    flags = np.ones(len(text) + 1, bool)
    flags[1:-1] = blank[:-1] & ~blank[1:]
    return flags


UNITS = {"char": char_flags, "word": word_flags}


def check_separators(separators) -> None:
    """Separators must not run into one another: then each stands exactly once
    in an output, wherever the cuts are."""
    for i, a in enumerate(separators):
        for j, b in enumerate(separators):
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j)))
            if not a or overlap or (i != j and a in b):
                raise ValueError(f"separators {a!r} and {b!r} overlap")


def draws(seed, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def rearranged(text: bytes, doc_id: int | None, seed, flags_of, marks: tuple[bytes, bytes, bytes], plain: int, spm: int):
    """(units, form, units of prefix, units of middle, output) of one text."""
    if not text:
        return 0, "plain", None, None, text
    cuts = Boundaries(flags_of(np.frombuffer(text, np.uint8)))
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if h3 % 100 >= 100 - plain or any(m in text for m in marks):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.select([lo, hi]).tolist()
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", lo, hi - lo, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", lo, hi - lo, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, seed: int | str = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = "char",
                   separators: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix, middle, output`` of every row: number of units,
    ``plain``, ``psm`` or ``spm``, the units of prefix and middle, and the text
    as it goes into training.  ``separators`` are those of prefix, suffix and
    middle."""
    check_separators(separators)
    flags_of, marks = UNITS[unit], tuple(s.encode() for s in separators)
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).view(pa.binary())
            for start, stop in rounds(pc.binary_length(texts).to_pylist()):
                part = ids.slice(start, stop - start)
                rows = [rearranged(t, i, seed, flags_of, marks, plain_percent, spm_percent)
                        for i, t in zip(part.to_pylist(), texts.slice(start, stop - start).to_pylist())]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", "prefix", "middle", "output"])

    return doc_texts(docs, id_col, text_col).mapInArrow(
        cut, "doc_id long, n long, form string, prefix long, middle long, output string")


def restore(output: Column, form: Column, separators: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of.  Each separator stands in it once."""
    p, s, m = separators

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, m, -1)
    return (F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two code points; one in ten stays plain, of the
    others one in five has its suffix first."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = [f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (
  SELECT doc_id, t, n, least({_H[0]} % (n + 1), {_H[1]} % (n + 1)) AS a, greatest({_H[0]} % (n + 1), {_H[1]} % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {_H[2]} % 100 >= 90 THEN 'plain'
              WHEN {_H[3]} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                        WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
