"""Byte-pair encoding and decoding by a tokenization automaton.

**Compiling.**  The automaton starts as one state in which every byte may
follow.  The merges are applied to it one after the other, each by the merge
gadget: for the merge ``u v -> w``, the state that ``u`` leads to is copied
without its arc ``v``, ``u`` now leads to the copy, and wherever ``u`` could be
read ``w`` can be, leading where ``v`` led.  What the automaton accepts in the
end are exactly the token sequences that the merges make, one for each word,
and it is deterministic in its labels.  All arcs of a label lead to one state,
and the copies that ``u`` went through differ by one arc each, so the state
behind a label is kept as the label and a time: the copies made for it before
that time, below them the state that its right half led to when it was made.
Whether a state has an arc is read off the tables in as many steps as the two
labels have halves: an arc taken away by a copy is missing; a label made after
a copy is there if its left half is; any other is asked of the state below.

**Encoding.**  A word's path is found from left to right over its bytes: the
arc that ends at a byte is the one label among those that end there which the
state before it allows.  Words up to ``SHORT`` bytes go through the tables
together, as arrays; longer ones one at a time with the same tables, in time
linear in their bytes.

**Decoding** emits the labels of the arcs.

Null and empty texts have no tokens and decode to the empty text.  Strings of
special tokens in a text become their ids, as the tokenizers library does by
default.  Repeated rows are each encoded.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitcraft.llm.common import doc_texts, ship, table

#: How words are split off before the merges (a fixed value of the vocabulary),
#: with the classes of letters and numbers left open.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\p{White_Space}{l}{n}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words of at most so many bytes are encoded as arrays.
SHORT = 48
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 250_000
#: Bytes of text in one round of a worker.
ROUND_BYTES = 1_500_000


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: printable
    Latin-1 signs for themselves, the other bytes for 256 onwards in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_pattern(without: str = ""):
    """The split; ``without`` are signs that count neither as letters nor as numbers."""
    import regex

    if not without:
        classes = {"{L}": r"\p{L}", "{N}": r"\p{N}", "[^\\p{White_Space}{l}{n}]": r"[^\p{White_Space}\p{L}\p{N}]"}
    else:
        odd = f"[{without}]"
        classes = {"{L}": rf"[\p{{L}}--{odd}]", "{N}": rf"[\p{{N}}--{odd}]",
                   "[^\\p{White_Space}{l}{n}]": rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||{odd}]"}
    pattern = SPLIT
    for name, chars in classes.items():
        pattern = pattern.replace(name, chars)
    return regex.compile(pattern, regex.V1)


def newer_signs() -> str:
    """Signs that the regex module takes for letters or numbers and the
    tokenizers library, with older tables, does not; as ranges of a class."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    signs = regex.compile(r"[\p{L}\p{N}]").findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    odd = [ord(c) for c in signs if len(split("!" + c)) == 1]
    runs: list[list[int]] = []
    for c in odd:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


class Table:
    """Integers by non-negative integer keys, looked up for whole arrays (open
    addressing, at most an eighth full)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(10, (len(keys) * 8).bit_length())
        self.shift, self.missing = np.uint64(64 - bits), missing
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int32)
        for key, value, slot in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(self.missing))
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def as_dict(self) -> dict[int, int]:
        there = self.keys >= 0
        return dict(zip(self.keys[there].tolist(), self.values[there].tolist()))


class Automaton:
    """The compiled tables; ids are those of the vocabulary."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        signs = byte_signs()
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(signs[c] for c in token)
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self._compile(vocab, merges, size, signs)
        self.newer = newer_signs()
        self._index()

    def _compile(self, vocab: dict[str, int], merges: list[list[str]], size: int, signs: dict[str, int]) -> None:
        never = len(merges) + 1
        left, right, made, first = [-1] * size, [-1] * size, [-2] * size, [never] * size
        for sign in signs:
            if sign in vocab:
                made[vocab[sign]] = -1
        gadgets: dict[tuple[int, int], int] = {}

        def has(u: int, label: int) -> bool:
            before = never
            while True:
                if gadgets.get((u, label), never) < before:
                    return False
                if first[u] < before and first[u] <= made[label]:
                    before = min(before, made[label] + 1)
                    label = left[label]
                elif right[u] < 0:
                    return True
                else:
                    before = made[u]
                    u = right[u]

        for time, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if made[u] < -1 or made[v] < -1 or made[w] > -2 or not has(u, v):
                continue  # never read: this merge makes nothing
            gadgets[u, v] = time
            first[u] = min(first[u], time)
            left[w], right[w], made[w] = u, v, time
        self.never = never
        self.left, self.right, self.made, self.first = (np.array(x, np.int32) for x in (left, right, made, first))
        self.gadgets = Table(np.array([u << 32 | v for u, v in gadgets], np.int64), np.fromiter(gadgets.values(), np.int32, len(gadgets)), never)

    def _index(self) -> None:
        """Trie of the labels that can be read, as an open hash table of
        (node, byte) -> node, and the label that ends at each node."""
        nodes: dict[int, int] = {}
        ends = [-1]
        for label in np.flatnonzero(self.made > -2).tolist():
            node = 0
            for byte in self.labels[label]:
                key = node << 8 | byte
                nxt = nodes.get(key)
                if nxt is None:
                    nxt = nodes[key] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = label
        self.ends = np.array(ends, np.int32)
        self.trie = Table(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)), -1)

    def allows(self, u: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state behind each label ``u`` (-1: the start of a word)
        has an arc of ``label``."""
        out = u < 0
        on = np.flatnonzero(~out)
        u, label = u[on], label[on]
        before = np.full(len(on), self.never, np.int32)
        while len(on):
            kept = self.gadgets.get(u.astype(np.int64) << 32 | label) >= before
            first, made = self.first[u], self.made[label]
            later = (first < before) & (first <= made)
            below = self.right[u]
            out[on[kept & ~later & (below < 0)]] = True
            go = kept & (later | (below >= 0))
            before = np.where(later, np.minimum(before, made + 1), self.made[u])[go]
            u, label = np.where(later, u, below)[go], np.where(later, self.left[label], label)[go]
            on = on[go]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none of them empty), as little-endian 32-bit integers."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self._long(w)
        if short:
            for i, ids in zip(short, self._short([words[i] for i in short])):
                out[i] = ids
        return out

    def _short(self, words: list[bytes]) -> list[bytes]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lens) - lens
        stop = np.repeat(first + lens, lens)
        # every label that starts at every byte, by length
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        starts, stops, labels = [], [], []
        depth = 0
        while len(at):
            node = self.trie.get(node.astype(np.int64) << 8 | data[at + depth])
            live = node >= 0
            at, node = at[live], node[live]
            depth += 1
            label = self.ends[node]
            is_label = label >= 0
            starts.append(at[is_label])
            stops.append(at[is_label] + depth)
            labels.append(label[is_label])
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        # those that end at the same byte together, the longest first
        begin, end, label = (np.concatenate(x[::-1]) for x in (starts, stops, labels))
        order = np.argsort(end, kind="stable")
        begin, end, label = begin[order], end[order], label[order]
        rows = np.concatenate(([0], np.cumsum(np.bincount(end, minlength=len(data) + 1))))
        # last label and its start for each prefix, all words one byte further at a time
        last = np.zeros(len(data) + 1, np.int32)
        came = np.zeros(len(data) + 1, np.int64)
        by_len = np.argsort(-lens, kind="stable")
        longest = -lens[by_len]
        before = np.full(len(data), -1, np.int32)  # the last label before each byte
        for p in range(1, int(lens.max()) + 1):
            here = first[by_len[:np.searchsorted(longest, -p, side="right")]] + p
            pick = rows[here]
            open_ = np.arange(len(here))
            while len(open_):  # at most as often as labels end here; one of them fits
                row = pick[open_]
                if not np.array_equal(end[row], here[open_]):
                    raise ValueError("no label ends where one has to")
                b, lab = begin[row], label[row]
                fits = self.allows(before[b], lab)
                yes = open_[fits]
                came[here[yes]], last[here[yes]] = b[fits], lab[fits]
                open_ = open_[~fits]
                pick[open_] += 1
            going = here[stop[here - 1] > here]  # words that have a next byte
            before[going] = last[going]
        # walk back from the ends, all words at once
        place, ids, owner = first + lens, [], []
        who = np.arange(len(words))
        while len(who):
            ids.append(last[place[who]])
            owner.append(who)
            place[who] = came[place[who]]
            who = who[place[who] > first[who]]
        ids, owner = np.concatenate(ids[::-1]), np.concatenate(owner[::-1])
        flat = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _long(self, word: bytes) -> bytes:
        """One long word: the labels from each byte on, tried where they end."""
        if not hasattr(self, "_dicts"):
            self._dicts = self.trie.as_dict(), self.gadgets.as_dict()
            self._lists = [x.tolist() for x in (self.ends, self.left, self.right, self.made, self.first)]
        (trie, gadgets), never = self._dicts, self.never
        ends, left, right, made, first = self._lists

        def allowed(u: int, label: int) -> bool:
            before = never
            while u >= 0:
                if gadgets.get(u << 32 | label, never) < before:
                    return False
                if first[u] < before and first[u] <= made[label]:
                    before = min(before, made[label] + 1)
                    label = left[label]
                else:
                    before = made[u]
                    u = right[u]
            return True

        n = len(word)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            u, node, j = last[i], 0, i
            while j < n:
                node = trie.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                j += 1
                label = ends[node]
                if label >= 0 and last[j] < 0 and allowed(u, label):
                    last[j], came[j] = label, i
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = came[at]
        return np.array(ids[::-1], "<u4").tobytes()


class Coder:
    """Whole texts to ids and back, with a bounded memory of words."""

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton = automaton
        self.plain = split_pattern().findall
        self.newer = re.compile(f"[{automaton.newer}]").search if automaton.newer else lambda text: None
        self.without = split_pattern(automaton.newer).findall
        special = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")  # has none of them, and is quickly seen
            except UnicodeEncodeError:
                if self.newer(text):
                    return self.without(text)
        return self.plain(text)

    def _parts(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.automaton.special):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        parts = [self._parts(t) for t in texts]
        known = self.known
        new = set().union(*parts).difference(known) if parts else set()
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set().union(*parts)
        for text, i in self.automaton.special.items():
            if text in new:
                new.discard(text)
                known[text] = np.array([i], "<u4").tobytes()
        words = list(new)
        for start in range(0, len(words), 50_000):
            group = words[start:start + 50_000]
            ids = self.automaton.encode_words([w.encode() for w in group])
            known.update(zip(group, ids))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after the other."""
        labels = self.automaton.labels
        return b"".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


_coders: dict[str, Coder] = {}


def coder(automaton: Automaton, key: str) -> Coder:
    """The worker's coder of this vocabulary."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(automaton)
    return _coders[key]


def _compiled(spark: SparkSession, vocabulary_path: str):
    """Compile on the driver (the size of the vocabulary) and send the tables."""
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast(Automaton(text)), hashlib.sha256(text.encode()).hexdigest()


def _rounds(texts: pa.Array) -> Iterator[tuple[int, int]]:
    from splitcraft.llm.tokencount import rounds

    yield from rounds(pc.binary_length(texts).to_pylist(), ROUND_BYTES)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row; with ``check`` also
    ``n_tokens`` and ``intact``, whether the ids decode to the text again."""
    tables, key = _compiled(docs.sparkSession, vocabulary_path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _rounds(batch.column(1)):
                one = coder(tables.value, key)
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                ids = one.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                columns = {"doc_id": batch.column(0).slice(start, stop - start), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
                if check:
                    columns["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
                    columns["intact"] = pa.array([one.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())
                yield pa.RecordBatch.from_pydict(columns)

    more = ", n_tokens long, intact boolean" if check else ""
    return doc_texts(docs, id_col, text_col).mapInArrow(encoded, "doc_id long, ids array<int>" + more)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text."""
    tables, key = _compiled(encoded.sparkSession, vocabulary_path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = coder(tables.value, key)
            texts = [one.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text is encoded,
    its ids decoded again, in one pass that keeps neither."""
    tables, key = _compiled(docs.sparkSession, vocabulary_path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _rounds(batch.column(1)):
                one = coder(tables.value, key)
                ids = one.encode(batch.column(1).slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(one.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs, id_col, text_col).mapInArrow(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the 50k byte vocabulary, and the text that
    they decode to, as digests.  Null or empty text: no ids, the empty text."""
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
