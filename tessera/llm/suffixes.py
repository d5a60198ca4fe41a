"""Suffix sorting of a shard by induction, with disk-backed queues.

A suffix is of type S if it is smaller than the next one, L if larger; S* are
the S suffixes behind an L.  The order of the S* suffixes induces that of all
others: scanning buckets (first characters) upwards gives the L suffixes,
scanning downwards the S suffixes.  Each bucket has a queue of suffixes in the
order of those that induced them, so first in, first out is their priority;
a scan takes them in blocks, a vector at a time.  Queues keep a bounded number
of suffixes in memory and write the rest to a temporary file of the task,
which is gone when it is closed, as Spark's own spill files are.

The S* suffixes are sorted by the same induction on their substrings, which
get names; where names repeat, the shorter string of names decides.  That
reduced string, a third as long, is sorted in memory by doubling of ranks, only
as far as the asked length needs.

``repeated`` yields which places start a string of ``length`` bytes that
starts elsewhere too: neighbours in the sorted order with a common prefix of
at least that length.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from tessera.llm.shingles import Powers, prefix_hash

MEMORY_SUFFIXES = 1 << 16      # held in memory by each bucket's queue


class Queue:
    """First in, first out, of suffix vectors; what exceeds ``most`` lies on disk."""

    def __init__(self, most: int):
        self.most, self.parts, self.held = most, [], 0
        self.file, self.written, self.taken = None, 0, 0

    def put(self, block: np.ndarray) -> None:
        if len(block):
            self.parts.append(block)
            self.held += len(block)
            if self.held > self.most:
                if self.file is None:
                    self.file = tempfile.TemporaryFile()
                self.file.seek(self.written * 8)
                for p in self.parts:
                    self.file.write(np.ascontiguousarray(p, np.int64).tobytes())
                self.written += self.held
                self.parts, self.held = [], 0

    def take(self) -> np.ndarray:
        """The next suffixes; an empty vector if there are none."""
        if self.taken < self.written:
            n = min(self.written - self.taken, 4 * self.most)
            self.file.seek(self.taken * 8)
            self.taken += n
            return np.frombuffer(self.file.read(n * 8), np.int64)
        if not self.parts:
            return np.zeros(0, np.int64)
        block = np.concatenate(self.parts)
        self.parts, self.held = [], 0
        return block

    def blocks(self, backwards: bool = False) -> Iterator[np.ndarray]:
        """All suffixes put so far, without taking them."""
        step = 4 * self.most
        cuts = range(0, self.written, step)
        tail = [np.concatenate(self.parts)] if self.parts else []
        if backwards:
            for t in tail:
                yield t[::-1]
        for at in reversed(cuts) if backwards else cuts:
            self.file.seek(at * 8)
            block = np.frombuffer(self.file.read(min(step, self.written - at) * 8), np.int64)
            yield block[::-1] if backwards else block
        if not backwards:
            yield from tail

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last character, the least of all, is S."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    # a run of equal characters has the type of its last one
    change = np.where(step != 0, np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = np.append(step, 1)[change] > 0
    return s


def _deal(queues: list[Queue], chars: np.ndarray, suffixes: np.ndarray) -> None:
    """Put each suffix into its character's queue, in the given order."""
    if len(suffixes):
        order = np.argsort(chars, kind="stable")
        chars, suffixes = chars[order], suffixes[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for c, part in zip(chars[np.concatenate([[0], cuts])].tolist(), np.split(suffixes, cuts)):
            queues[c].put(part)


def induce(text: np.ndarray, s_type: np.ndarray, stars: np.ndarray, n_chars: int,
           most: int = MEMORY_SUFFIXES) -> Iterator[np.ndarray]:
    """All suffixes in order, in blocks, induced from the S* suffixes in theirs."""
    make = lambda: [Queue(most) for _ in range(n_chars)]
    star, up, large, down, small = make(), make(), make(), make(), make()
    _deal(star, text[stars], stars)

    def before(block: np.ndarray, wanted: bool, queues: list[Queue]) -> None:
        """The suffixes one place earlier, if of the wanted type."""
        prev = block[block > 0] - 1
        prev = prev[s_type[prev] == wanted]
        _deal(queues, text[prev], prev)

    for c in range(n_chars):
        while len(block := up[c].take()):
            large[c].put(block)
            before(block, False, up)
        for block in star[c].blocks():
            before(block, False, up)
    for c in range(n_chars - 1, -1, -1):
        while len(block := down[c].take()):
            small[c].put(block)
            before(block, True, down)
        for block in large[c].blocks(backwards=True):
            before(block, True, down)
    # the last suffix is the least; nothing induces it
    yield np.array([len(text) - 1])
    for c in range(n_chars):
        yield from large[c].blocks()
        yield from small[c].blocks(backwards=True)
    for queues in (star, up, large, down, small):
        for q in queues:
            q.close()


def _hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prefix_hash(text, Powers())


def sort_stars(text: np.ndarray, s_type: np.ndarray, n_chars: int, length: int, most: int) -> np.ndarray:
    """The S* suffixes in order, at least of their first ``length`` characters."""
    star = np.zeros(len(text), bool)
    star[1:] = s_type[1:] & ~s_type[:-1]
    places = np.flatnonzero(star)
    if len(places) < 2:
        return places
    ordered = np.concatenate([b[star[b]] for b in induce(text, s_type, places, n_chars, most)])
    # equal substrings get equal names
    number = np.zeros(len(text), np.int64)
    number[places] = np.arange(len(places))
    ends = np.append(places[1:] + 1, len(text))
    s, down = _hashes(text)
    sub = (s[ends] - s[places]) * down[places]
    at = number[ordered]
    size = (ends - places)[at]
    new = np.ones(len(at), bool)
    new[1:] = (sub[at[1:]] != sub[at[:-1]]) | (size[1:] != size[:-1])
    rank = np.empty(len(at), np.int64)
    rank[at] = np.cumsum(new) - 1
    step = 1
    # each name covers a character more than nothing, so ``length`` names cover the asked characters
    while step <= length and rank.max() + 1 < len(rank):
        then = np.full(len(rank), -1, np.int64)
        then[:-step] = rank[step:] if step < len(rank) else -1
        key = rank * (len(rank) + 1) + then + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
    return places[np.argsort(rank, kind="stable")]


def suffix_order(text: np.ndarray, length: int, n_chars: int = 258, most: int = MEMORY_SUFFIXES) -> Iterator[np.ndarray]:
    """Suffixes in order of their first ``length`` characters at least; the text's last one must be its unique least."""
    s_type = types(text)
    return induce(text, s_type, sort_stars(text, s_type, n_chars, length, most), n_chars, most)


def shard_text(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings in one text (bytes from 2 on, 1 behind each string, 0 at the end) and where each begins."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    raw = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
    text = raw.astype(np.uint16) + 2
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text[begins[1:] - 1] = 1
    text[-1] = 0
    return text, begins[:-1]


def repeated(strings: list[bytes], length: int, most: int = MEMORY_SUFFIXES) -> np.ndarray:
    """Places of the shard's text at which a string of ``length`` bytes starts that starts elsewhere in it too."""
    if not strings:
        return np.zeros(0, bool)
    text, begins = shard_text(strings)
    ends = np.append(begins[1:] - 1, len(text) - 2)
    # characters left in a place's own string
    owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(text) - 1)))
    left = np.append(ends[owner] - np.arange(len(text) - 1), 0)
    s, down = _hashes(text)
    found = np.zeros(len(text), bool)
    last = None
    for block in suffix_order(text, length, most=most):
        block = block[left[block] >= length]
        if not len(block):
            continue
        if last is not None:
            block = np.concatenate([[last], block])
        window = (s[block + length] - s[block]) * down[block]
        same = window[1:] == window[:-1]
        for i in np.flatnonzero(same)[:1]:       # the hash is trusted beyond a first look
            a, b = block[i], block[i + 1]
            same[i] = np.array_equal(text[a:a + length], text[b:b + length])
        found[block[1:][same]] = True
        found[block[:-1][same]] = True
        last = block[-1]
    return found
