"""Suffix sorting by induction, with queues that spill to disk.

Suffixes are ranked from their successors: tuples (position, run, rank of the successor) wait in the
queue of the first character they start with and come out block of characters by block. Only
the suffixes at local minima are sorted first: their substrings are named by the same induction and
the string of names, at most half as long, is sorted recursively.

Every array over the whole string comes from a ``Scratch``, which maps large ones to files, and queues write
what exceeds their share of memory; a block of characters is sorted in memory.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


class Scratch:
    """Arrays in memory up to ``limit`` bytes each, else in files of a folder that lives as long as this does."""

    def __init__(self, limit: int = 64 << 20):
        self.limit, self.folder = limit, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder:
            self.folder.cleanup()

    def file(self):
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        return tempfile.TemporaryFile(dir=self.folder.name)

    def empty(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.limit:
            return np.empty(n, kind)
        return np.memmap(self.file(), kind, "w+", shape=(n,))


TUPLE = np.dtype([("at", np.int64), ("run", np.int64), ("next", np.int64)])


class Queue:
    """Tuples by block; what is held beyond ``limit`` bytes goes to the file, block after block."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.blocks, self.parts, self.out = scratch, 0, defaultdict(list), defaultdict(list), None

    def push(self, block: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        for which, part in zip(block[np.concatenate(([0], cuts))] if len(block) else (), np.split(rows, cuts)):
            self.blocks[int(which)].append(part)
            self.held += part.nbytes
        if self.held > self.scratch.limit:
            self.out = self.out or self.scratch.file()
            for which, parts in self.blocks.items():
                for part in parts:
                    self.parts[which].append((self.out.tell(), len(part)))
                    part.tofile(self.out)
            self.blocks.clear()
            self.held = 0

    def pop(self, block: int) -> np.ndarray:
        parts = []
        for at, n in self.parts.pop(block, ()):
            self.out.seek(at)
            parts.append(np.fromfile(self.out, TUPLE, n))
        if parts:
            self.out.seek(0, 2)
        inside = self.blocks.pop(block, [])
        self.held -= sum(p.nbytes for p in inside)
        return np.concatenate([*parts, *inside, np.zeros(0, TUPLE)])


def suffix_order(text: np.ndarray, scratch: Scratch, block: int = 1 << 15) -> np.ndarray:
    """Positions of all suffixes of ``text`` in order. ``text`` holds integers from 0 and ends with its only 0.

    ``block`` is the number of suffixes that are handled together where they start with different characters.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    levels = _Level(text, scratch, block)
    stars = levels.stars
    if len(stars) == 1:
        return levels.induce(stars)
    # names of the substrings between local minima, from an induction that starts with them in any order
    order = levels.induce(stars)
    order = order[levels.is_star[order]]
    name_of = scratch.empty(n, np.int64)
    name_of[order] = _names(text, order, stars)
    names = name_of[stars]
    if names.max() + 1 == len(stars):
        return levels.induce(order)
    return levels.induce(stars[suffix_order(names, scratch, block)])


def _names(text: np.ndarray, order: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """A number per substring in ``order``, equal for equal ones (by length and 64-bit hash)."""
    power = np.cumprod(np.full(len(text) + 1, RADIX))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    inverse = np.uint64(pow(int(RADIX), -1, 1 << 64))
    back = np.cumprod(np.full(len(text), inverse))
    following = np.append(stars[1:], len(text) - 1)
    end = np.minimum(following[np.searchsorted(stars, order)] + 1, len(text))
    key = (total[end] - total[order]) * back[order]
    size = end - order
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
    return np.cumsum(new) - 1


class _Level:
    """Types, runs and blocks of one string."""

    def __init__(self, text: np.ndarray, scratch: Scratch, block: int):
        n = len(text)
        self.text, self.scratch = text, scratch
        starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        sizes = np.diff(np.append(starts, n))
        up = np.append(text[starts[:-1]] < text[starts[1:]], True)  # a run's type is that of its last place
        self.small = scratch.empty(n, bool)
        self.small[:] = np.repeat(up, sizes)
        self.run_start = scratch.empty(n, np.int64)
        self.run_start[:] = np.repeat(starts, sizes)
        self.is_star = scratch.empty(n, bool)
        self.is_star[0] = False
        self.is_star[1:] = self.small[1:] & ~self.small[:-1]
        self.stars = np.flatnonzero(self.is_star)
        counts = np.bincount(text)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # slots of a character
        large = np.bincount(text[~self.small], minlength=len(counts))
        self.base = np.stack((self.first[:-1], self.first[:-1] + large))  # first slot by kind (0: descends, 1: ascends)
        # blocks of characters: up to ``block`` suffixes, or a single character
        self.block_of = np.zeros(len(counts), np.int64)
        chunk = self.first[:-1] // block
        big = counts > block
        edge = np.concatenate(([False], (np.diff(chunk) > 0) | big[1:] | big[:-1]))
        self.block_of = np.cumsum(edge)
        self.blocks = int(self.block_of[-1]) + 1

    def induce(self, stars: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the local minima in the order ``stars``."""
        text, n = self.text, len(self.text)
        out = self.scratch.empty(n, np.int64)
        by_block = stars[np.argsort(self.block_of[text[stars]], kind="stable")]
        cuts = np.searchsorted(self.block_of[text[by_block]], np.arange(self.blocks + 1))
        queue = Queue(self.scratch)
        for b in range(self.blocks):  # descending suffixes, from their smaller successors
            fixed = by_block[cuts[b] : cuts[b + 1]]
            at, rank, kind = self._settle(b, queue, fixed, np.arange(len(fixed)), 0)
            out[rank[kind == 0]] = at[kind == 0]
        lows, highs = self.base[0], self.base[1]
        queue = Queue(self.scratch)
        block_first = np.searchsorted(self.block_of, np.arange(self.blocks))
        block_last = np.searchsorted(self.block_of, np.arange(self.blocks), "right") - 1
        for b in range(self.blocks - 1, -1, -1):  # ascending ones, from their larger successors
            chars = np.arange(block_first[b], block_last[b] + 1)
            sizes = highs[chars] - lows[chars]
            slots = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lows[chars], sizes)
            at, rank, kind = self._settle(b, queue, out[slots], slots, 1)
            out[rank[kind == 1]] = at[kind == 1]
        return out

    def _settle(self, b: int, queue: Queue, fixed: np.ndarray, fixed_key: np.ndarray, kind: int):
        """Ranks in block ``b``; its predecessors in other blocks go to the queue.

        ``kind`` is what is being ranked (0 or 1); ``fixed`` are the block's suffixes of the other kind, in order.
        Suffixes whose successor is in the block are ranked again until their order stands.
        """
        text, waiting = self.text, queue.pop(b)
        if b == 0 and kind == 1:  # the last place has no successor
            waiting = np.concatenate((waiting, np.array([(len(text) - 1, 1, -1)], TUPLE)))
        at = np.concatenate((waiting["at"], fixed))
        run = np.concatenate((waiting["run"], np.zeros(len(fixed), np.int64)))
        key = np.concatenate((waiting["next"], fixed_key))
        kinds = np.concatenate((np.full(len(waiting), kind, np.int8), np.full(len(fixed), 1 - kind, np.int8)))
        parent = np.full(len(at), -1)
        fresh, gone = 0, []
        while True:
            # predecessors of what is new
            source = np.arange(fresh, len(at))
            fresh = len(at)
            before, behind = at[source] - 1, at[source]
            good = before >= 0
            source, before, behind = source[good], before[good], behind[good]
            right = (text[before] > text[behind]) if kind == 0 else (text[before] < text[behind])
            source, before = source[right], before[right]
            sizes = before - self.run_start[before] + 1
            here = self.block_of[text[before]] == b
            gone.append((source[~here], before[~here], sizes[~here]))
            source, before, sizes = source[here], before[here], sizes[here]
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.concatenate((at, np.repeat(before, sizes) - step))
            run = np.concatenate((run, step + 1))
            parent = np.concatenate((parent, np.repeat(source, sizes)))
            kinds = np.concatenate((kinds, np.full(len(step), kind, np.int8)))
            key = np.concatenate((key, np.zeros(len(step), np.int64)))
            if len(at) == fresh:
                break
        inside = np.flatnonzero(parent >= 0)
        char = text[at].astype(np.int64)
        signed = run if kind == 0 else -run
        rank = None
        while True:
            order = np.lexsort((key, signed, kinds, char))
            sorted_char, sorted_kind = char[order], kinds[order]
            slot = self.base[sorted_kind, sorted_char]
            new = np.concatenate(([True], slot[1:] != slot[:-1]))[: len(slot)]
            begin = np.flatnonzero(new)
            index = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            now = np.empty(len(order), np.int64)
            now[order] = slot + index
            if rank is not None and np.array_equal(now, rank) or not len(inside):
                rank = now
                break
            rank = now
            key[inside] = rank[parent[inside]]
        source, before, sizes = (np.concatenate(x) for x in zip(*gone))
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = np.empty(len(step), TUPLE)
        rows["at"], rows["run"] = np.repeat(before, sizes) - step, step + 1
        rows["next"] = np.repeat(rank[source], sizes)
        queue.push(self.block_of[text[rows["at"]]], rows)
        return at, rank, kinds
