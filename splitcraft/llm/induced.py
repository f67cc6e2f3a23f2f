"""External induced sorting of suffixes.

The suffixes that start at a local minimum (S*) are sorted as tuples of their
first ``DEPTH`` symbols; all others are induced from them: one sweep over the
first symbols upwards for the suffixes larger than their successor, one
downwards for the smaller ones.  What a sweep finds is put into the queue of its
first symbol.  Keys arrive there in order, so a queue is a priority queue that
only appends; it holds its newest entries in memory and writes older ones to an
unlinked file (as Spark spills), and each queue is read once, from its start.

Order counts up to ``DEPTH`` symbols, so that sorting the S* tuples takes one
level and no recursion has to name them.
"""
from __future__ import annotations

import tempfile

import numpy as np

DEPTH = 50
#: Entries that all queues of a sweep hold in memory before they go to disk.
HELD = 4_000_000


class Queues:
    """A queue of positions for each first symbol."""

    def __init__(self, symbols: int, held: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.file = held, 0, None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.parts[symbol].append(positions)
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for queue in self.parts:
            for i, part in enumerate(queue):
                if isinstance(part, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(part.tobytes())
                    queue[i] = (at, len(part))
        self.held = 0

    def take(self, symbol: int) -> np.ndarray:
        """All that the queue holds, in order; it is empty then."""
        out, self.parts[symbol] = self.parts[symbol], []
        read = []
        for part in out:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                read.append(np.frombuffer(self.file.read(8 * part[1]), np.int64))
            else:
                self.held -= len(part)
                read.append(part)
        return np.concatenate(read) if read else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def keys_at(data: np.ndarray, positions: np.ndarray, last_first: bool = False):
    """The ``DEPTH`` bytes from each position on, as one array of big-endian
    words after the other; beyond the end stand zeros."""
    padded = np.concatenate([data, np.zeros(DEPTH + 8, np.uint8)])
    # the word from every byte on, gathered where it is asked for
    whole = np.lib.stride_tricks.sliding_window_view(padded, 8)
    starts = range(0, DEPTH, 8)
    for start in reversed(starts) if last_first else starts:
        word = np.ascontiguousarray(whole[positions + start]).view(">u8").reshape(-1).astype(np.uint64)
        if DEPTH - start < 8:
            word >>= np.uint64(8 * (8 - (DEPTH - start)))
        yield word


def _larger(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than the next one (L); the last is not."""
    n = len(text)
    step = np.sign(text[:-1].astype(np.int16) - text[1:].astype(np.int16))
    place = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(place[::-1])[::-1]  # where the next difference is
    out = np.zeros(n, bool)
    there = following < n
    out[:-1][there] = step[following[there]] > 0
    return out


def sorted_suffixes(data: np.ndarray, held: int = HELD) -> np.ndarray:
    """Start positions of all suffixes of the bytes ``data``, ordered by their
    first ``DEPTH`` bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    text = np.concatenate([data.astype(np.int16) + 1, np.zeros(1, np.int16)])  # a last, smallest symbol
    n = len(text)
    larger = _larger(text)
    star = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    inner = star[star < n - 1]
    # a shorter suffix comes before those it starts: zeros beyond the end stand
    # for the last symbol, so of equal words the later one comes first; then by
    # one word after the other, the last one first, each pass a stable sort
    order = np.arange(len(inner))[::-1]
    for word in keys_at(data, inner, last_first=True):
        order = order[np.argsort(word[order], kind="stable")]
    star = np.concatenate([[n - 1], inner[order]]).astype(np.int64)
    first = text[star]
    star_at = np.searchsorted(first, np.arange(259)) if (np.diff(first) >= 0).all() else None
    if star_at is None:
        raise AssertionError("tuples have to be in order of their first symbols")

    # upwards: the suffixes larger than their successor
    up, found_larger = Queues(258, held), [None] * 258
    for c in range(258):
        done = []
        part = up.take(c)
        while len(part):
            done.append(part)
            _induce(up, text, larger, part, True)
            part = up.take(c)
        found_larger[c] = np.concatenate(done) if done else np.zeros(0, np.int64)
        seeds = star[star_at[c]:star_at[c + 1]]
        if len(seeds):
            _induce(up, text, larger, seeds, True)
    up.close()

    # downwards: the smaller ones, each queue filled from its end
    down, out = Queues(258, held), []
    for c in range(257, -1, -1):
        done = []
        part = down.take(c)
        while len(part):
            done.append(part)
            _induce(down, text, larger, part, False)
            part = down.take(c)
        if c == 0:
            done.append(np.array([n - 1], np.int64))
        if len(found_larger[c]):
            back = found_larger[c][::-1]
            _induce(down, text, larger, back, False)
            done.append(back)
        found_larger[c] = None
        out += done
    down.close()
    suffixes = np.concatenate(out)[::-1]
    return suffixes[suffixes < n - 1]


def _induce(queues: Queues, text: np.ndarray, larger: np.ndarray, positions: np.ndarray, upwards: bool) -> None:
    """Push the predecessors of one kind, in order, to the queues of their
    first symbols."""
    before = positions[positions > 0] - 1
    before = before[larger[before] == upwards]
    if not len(before):
        return
    symbols = text[before]
    order = np.argsort(symbols, kind="stable")
    before, symbols = before[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(before, cuts):
        queues.push(int(text[part[0]]), part)


def equal_runs(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For sorted suffix starts: a number for each, equal where the common
    prefix with the one before reaches ``DEPTH`` bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.zeros(len(starts), bool)
    new[0] = True
    for word in keys_at(data, starts):
        new[1:] |= word[1:] != word[:-1]
    return np.cumsum(new) - 1
