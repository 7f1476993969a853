"""Suffix and common-prefix order of one text by external induced sorting.

Queues of (suffix, common prefix) tuples, one for each first symbol and read in
symbol order, act as the priority queue of induced sorting: a batch of tuples
that stands in final order is taken, and each tuple passes its left neighbour
suffix on to the queue of that suffix's first symbol. Tuples reach a queue in
their final order, so a first-in-first-out file is enough; a queue that outgrows
its share of memory moves to disk. The common prefix of two neighbours in a
queue is one more than the least one between their sources, taken by range
minima over the batch. Left-most S suffixes are sorted by the same induction on
their substrings, named, and the string of names is sorted recursively (while it
has few symbols; a string of many symbols is sorted by doubling).
Common prefixes are cut at ``cap``, all that a repeat of ``cap`` symbols needs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np

#: Symbols up to which a string of names is sorted by induction.
FEW_SYMBOLS = 1024
#: Tuples handled at once, and tuples a queue holds before it moves to disk.
BATCH = 1 << 17
HELD = 1 << 14


class DiskQueue:
    """First-in-first-out tuples (suffix, common prefix with the tuple before)."""

    def __init__(self, held: int = HELD):
        self.held, self.count = held, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.stored: list[tuple[int, int]] = []  # place in the file and length of each stored part
        self.file: BinaryIO | None = None

    def push(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.parts.append((suffixes, common))
        self.count += len(suffixes)
        if self.count > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            suffixes, common = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.file.write(suffixes.astype(np.int64).data)
            self.file.write(common.astype(np.int16).data)
            self.stored.append((at, len(suffixes)))
            self.parts, self.count = [], 0

    def _read(self, at: int, start: int, stop: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at + 8 * start)
        suffixes = np.frombuffer(self.file.read(8 * (stop - start)), np.int64)
        self.file.seek(at + 8 * total + 2 * start)
        return suffixes, np.frombuffer(self.file.read(2 * (stop - start)), np.int16)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches in order, among them what is pushed meanwhile; the queue is empty afterwards."""
        while self.stored or self.parts:
            stored, parts = self.stored, self.parts
            self.stored, self.parts, self.count = [], [], 0
            for at, total in stored:
                for start in range(0, total, BATCH):
                    yield self._read(at, start, min(total, start + BATCH), total)
            if parts:
                suffixes, common = (np.concatenate(x) for x in zip(*parts, strict=True))
                for start in range(0, len(suffixes), BATCH):
                    yield suffixes[start : start + BATCH], common[start : start + BATCH]

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches from the last tuple to the first; each common prefix is with the tuple that follows in this order."""
        if self.parts:
            suffixes, common = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            yield suffixes[::-1], common[::-1]
        for at, total in reversed(self.stored):
            for stop in range(total, 0, -BATCH):
                suffixes, common = self._read(at, max(0, stop - BATCH), stop, total)
                yield suffixes[::-1], common[::-1]


#: Items of an array from which on it lies in a scratch file.
IN_MEMORY = 1 << 20
#: Items of a pass over an array that does not lie in memory.
STRIDE = 1 << 20


def scratch_array(n: int, kind) -> np.ndarray:
    """Zeros; large arrays are memory-mapped scratch files, which the system writes out when memory is short."""
    if n <= IN_MEMORY:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:  # the mapping keeps it
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


def _place(n: int) -> type:
    """The narrowest type for places of a text."""
    return np.int32 if n < (1 << 31) - 1 else np.int64


def s_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last is not. From the end, a stretch at a time."""
    n = len(text)
    out = scratch_array(n, bool)
    after = False  # type of the suffix that follows the stretch
    for stop in range(n, 0, -STRIDE):
        at = max(0, stop - STRIDE)
        own = text[at : min(stop + 1, n)]
        size = stop - at
        rising, differs = np.zeros(size, bool), np.zeros(size, bool)
        rising[: len(own) - 1], differs[: len(own) - 1] = own[:-1] < own[1:], own[:-1] != own[1:]
        if stop == n:
            differs[-1] = True
        following = np.where(differs, np.arange(size), size)[::-1]
        following = np.minimum.accumulate(following)[::-1]
        out[at:stop] = np.append(rising, after)[following]
        after = bool(out[at])
    return out


class Induction:
    """Passes tuples on from sorted batches to the queues of their left neighbours."""

    def __init__(self, text: np.ndarray, symbols: int, is_s: np.ndarray, cap: int):
        self.text, self.symbols, self.is_s, self.cap = text, symbols, is_s, cap
        self.least = np.zeros(symbols, np.int16)

    def next_bucket(self) -> None:
        self.least[:] = 0  # sources that begin differently share nothing

    def pass_on(self, suffixes: np.ndarray, common: np.ndarray, queues: list[DiskQueue], to_s: bool) -> None:
        """``common`` of a tuple is with the one before it in this order."""
        left = suffixes - 1
        wanted = (left >= 0) & (self.is_s[left] == to_s)
        chosen = np.flatnonzero(wanted)
        symbol = self.text[left[chosen]]
        order = np.argsort(symbol, kind="stable")
        symbol, chosen = symbol[order], chosen[order]
        groups = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else []
        ends = np.append(groups[1:], len(symbol)) if len(symbol) else []
        if self.cap == 1:  # order alone is asked for
            for a, b in zip(groups, ends, strict=True):
                queues[symbol[a]].push(left[chosen[a:b]], np.ones(b - a, np.int16))
            return
        before = self.least.copy()
        np.minimum(self.least, common.min(initial=self.cap), out=self.least)
        for a, b in zip(groups, ends, strict=True):
            own, c = chosen[a:b], symbol[a]
            lows = np.minimum.reduceat(common[: own[-1] + 1], np.append(0, own[:-1] + 1)).astype(np.int16)
            lows[0] = min(lows[0], before[c])
            queues[c].push(left[own], np.minimum(lows + 1, self.cap).astype(np.int16))
            self.least[c] = common[own[-1] + 1 :].min(initial=self.cap)


def in_words(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The 8 bytes that begin at each symbol, and a symbol's width in bytes."""
    width = 1 if text.dtype.itemsize == 1 else 2 if text.dtype.itemsize == 2 or len(text) and int(text.max()) < 1 << 16 else 4
    padded = scratch_array(len(text) + 8, f"<u{width}")
    for at in range(0, len(text), STRIDE):
        padded[at : at + STRIDE][: len(text) - at] = text[at : at + STRIDE]
    return np.ndarray((len(text),), "<u8", buffer=padded, strides=(width,)), width


def first_difference(words: tuple[np.ndarray, int], a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, at most ``cap``, of pairs of suffixes, by comparing symbols, 8 bytes at a time."""
    words, width = words
    out = np.zeros(len(a), np.int64)
    n, open_ = len(words), np.arange(len(a))
    while open_.size:
        i, j = a[open_] + out[open_], b[open_] + out[open_]
        odd = words[np.minimum(i, n - 1)] ^ words[np.minimum(j, n - 1)]
        run = np.bitwise_count((odd & (~odd + np.uint64(1))) - np.uint64(1)).astype(np.int64) // (8 * width)
        room = n - np.maximum(i, j)
        out[open_] += np.minimum(run, room)
        open_ = open_[(odd == 0) & (run < room) & (out[open_] < cap)]
    return np.minimum(out, cap)


def induce(text: np.ndarray, symbols: int, is_s: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, cap: int, pair: Callable[[np.ndarray, np.ndarray, np.ndarray], None] | None) -> np.ndarray:
    """Induce all suffixes from the left-most S suffixes ``seeds``, given in order.

    ``pair`` gets each neighbouring pair (two arrays) with its common prefix.
    Returns the left-most S suffixes in their induced order.
    """
    bounds = np.searchsorted(text[seeds], np.arange(symbols + 1))
    l_queues, l_kept, s_queues = ([DiskQueue() for _ in range(symbols)] for _ in range(3))
    last_l: dict[int, int] = {}
    work = Induction(text, symbols, is_s, cap)
    l_queues[int(text[-1])].push(np.array([len(text) - 1]), np.zeros(1, np.int16))

    def one(i: int, j: int) -> int:
        room = min(cap, len(text) - max(i, j))
        odd = text[i : i + room] != text[j : j + room]
        return int(odd.argmax()) if odd.any() else room

    for c in range(symbols):
        work.next_bucket()
        last = -1
        for suffixes, common in l_queues[c].drain():
            work.pass_on(suffixes, common, l_queues, False)
            l_kept[c].push(suffixes, common)
            if pair:
                pair(np.append(last, suffixes[:-1]), suffixes, common)
            last = int(suffixes[-1])
        last_l[c] = last
        own = seeds[bounds[c] : bounds[c + 1]]
        if len(own):
            common = seed_common[bounds[c] : bounds[c + 1]].copy()
            common[0] = one(last, int(own[0])) if last >= 0 else 0
            for at in range(0, len(own), BATCH):
                work.pass_on(own[at : at + BATCH], common[at : at + BATCH], l_queues, False)

    sorted_lms, left = scratch_array(len(seeds), seeds.dtype), len(seeds)
    for c in range(symbols - 1, -1, -1):
        work.next_bucket()
        last = -1
        for suffixes, common in s_queues[c].drain():
            work.pass_on(suffixes, common, s_queues, True)
            if pair:
                pair(np.append(last, suffixes[:-1]), suffixes, common)
            lms = suffixes[(suffixes > 0) & ~is_s[suffixes - 1]]
            sorted_lms[left - len(lms) : left] = lms[::-1]
            left -= len(lms)
            last = int(suffixes[-1])
        if last_l[c] >= 0:
            above = one(last_l[c], last) if last >= 0 else 0
            if pair and last >= 0:
                pair(np.array([last_l[c]]), np.array([last]), np.array([above]))
            for suffixes, common in l_kept[c].backwards():
                # Here a tuple's common prefix is with the next in this order: shift by one.
                shifted = np.append(np.int16(above), common[:-1]).astype(np.int16)
                above = int(common[-1])
                work.pass_on(suffixes, shifted, s_queues, True)
    return sorted_lms[left:]


def doubled(names: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Suffixes of a string in order, by doubling the compared length; only suffixes that still tie are sorted again.

    With ``enough``, ties that agree in that many names keep any order.
    """
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_run(names[order])
    tied = order
    while step < min(n, enough or n):
        tied = tied[_tie(rank[tied])]
        if not len(tied):
            break
        after = tied + step
        key = rank[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        rank[tied] = old + _first_of_run(key) - _first_of_run(old)
        step *= 2
    return np.argsort(rank, kind="stable")


def _first_of_run(values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with the same value."""
    new = np.append(True, values[1:] != values[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _tie(values: np.ndarray) -> np.ndarray:
    """Which places of a sorted array have an equal neighbour."""
    same = values[1:] == values[:-1]
    return np.append(same, False) | np.append(False, same)


def leftmost(is_s: np.ndarray) -> np.ndarray:
    """Places of the left-most S suffixes."""
    parts = [np.flatnonzero(is_s[at : at + STRIDE] & ~np.append(True if at == 0 else is_s[at - 1], is_s[at : at + STRIDE][:-1])) + at for at in range(0, len(is_s), STRIDE)]
    out, at = scratch_array(sum(map(len, parts)), _place(len(is_s))), 0
    for part in parts:
        out[at : at + len(part)] = part
        at += len(part)
    return out


def by_first_symbol(text: np.ndarray, places: np.ndarray, symbols: int) -> np.ndarray:
    """Places in the order of their symbols, those of one symbol as they are."""
    strides = [places[at : at + STRIDE] for at in range(0, len(places), STRIDE)]
    ends = np.cumsum(sum((np.bincount(text[x], minlength=symbols) for x in strides), np.zeros(symbols, np.int64)))
    out, at = scratch_array(len(places), places.dtype), np.append(0, ends[:-1])
    for x in strides:
        symbol = text[x]
        order = np.argsort(symbol, kind="stable")
        counts = np.bincount(symbol, minlength=symbols)
        into = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(x))
        out[into] = x[order]
        at += counts
    return out


def sorted_lms(text: np.ndarray, symbols: int, is_s: np.ndarray, cap: int | None = None) -> np.ndarray:
    """Left-most S suffixes in order (of their first ``cap`` symbols, if given)."""
    lms = leftmost(is_s)
    if len(lms) < 2:
        return lms
    order = induce(text, symbols, is_s, by_first_symbol(text, lms, symbols), np.broadcast_to(np.int16(0), len(lms)), 1, None)
    # Name equal substrings alike. A substring ends with the next left-most S suffix's first symbol.
    n, words = len(text), in_words(text)
    follow = scratch_array(n, lms.dtype)
    for at in range(0, n, STRIDE):
        follow[at : at + STRIDE] = n
    follow[lms[:-1]] = lms[1:]
    name, names = 0, scratch_array(len(lms), np.int32)
    for at in range(1, len(order), STRIDE):
        a, b = order[at - 1 : at + STRIDE - 1], order[at : at + STRIDE]
        a = a[: len(b)]
        size = np.minimum(follow[b].astype(np.int64) + 1, n) - b
        same = (np.minimum(follow[a].astype(np.int64) + 1, n) - a == size) & (follow[a] < n) & (follow[b] < n)
        check = np.flatnonzero(same)
        same[check] = first_difference(words, a[check], b[check], int(size[check].max(initial=0))) >= size[check]
        names[at : at + STRIDE] = name + np.cumsum(~same)
        name = int(names[at + len(b) - 1])
    if name == len(lms) - 1:
        return order
    del words
    for at in range(0, len(order), STRIDE):
        follow[order[at : at + STRIDE]] = names[at : at + STRIDE]
    reduced = names  # in the order of the text
    for at in range(0, len(lms), STRIDE):
        reduced[at : at + STRIDE] = follow[lms[at : at + STRIDE]]
    del follow
    if name < FEW_SYMBOLS:
        return lms[sorted_suffixes(reduced, name + 1)]
    return lms[doubled(reduced, cap and cap // 2 + 2)]  # a name covers two symbols at least


def sorted_suffixes(text: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes of a string in order (for strings of names)."""
    if len(text) < 2:
        return np.arange(len(text))
    rising: dict[int, list[np.ndarray]] = {}
    is_s = s_types(text)

    def pair(_: np.ndarray, second: np.ndarray, __: np.ndarray) -> None:
        rising.setdefault(int(text[second[0]]) * 2 + int(is_s[second[0]]), []).append(second)

    def each(first: np.ndarray, second: np.ndarray, common: np.ndarray) -> None:
        if len(second) > 1 or first[0] < 0 or is_s[first[0]] == is_s[second[0]]:  # not the pair where two kinds meet
            pair(first, second, common)

    induce(text, symbols, is_s, sorted_lms(text, symbols, is_s), np.zeros(len(leftmost(is_s)), np.int16), 1, each)
    return np.concatenate([np.concatenate(v)[::-1] if k & 1 else np.concatenate(v) for k, v in sorted(rising.items())])


def neighbours(text: np.ndarray, cap: int, pair: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Call ``pair`` with all neighbouring suffixes of a byte text and their common prefixes, cut at ``cap``.

    A pair whose first is -1 marks the first suffix of a run of the order.
    """
    if not len(text):
        return
    is_s = s_types(text)
    seeds, words = sorted_lms(text, 256, is_s, cap), in_words(text)
    common = scratch_array(len(seeds), np.int16)
    for at in range(1, len(seeds), 1 << 18):
        upto = min(len(seeds), at + (1 << 18))
        common[at:upto] = first_difference(words, seeds[at - 1 : upto - 1], seeds[at:upto], cap)
    induce(text, 256, is_s, seeds, common, cap, pair)
