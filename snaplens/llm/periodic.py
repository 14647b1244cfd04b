"""Runs of periodic words within documents, by seeds that are extended along diagonals.

A run of period q and length L is a diagonal at lag q on which L - q words in a row equal
the word q further on; L - q is at least ``max(shortest - q, q)``. Lags are classed so
that all lags of a class share a guaranteed overlap:

* lags below ``shortest``: the overlap is ``shortest / 2`` at least. Every word gram of
  that length is indexed, and all occurrence pairs at such lags are seeds;
* lags from 2g to 4g - 1 (g = ``shortest / 2``, doubled class by class): the overlap is 2g
  or more, so the diagonal covers a whole gram of g words that starts at a multiple of g.
  Only those grams ask for their occurrences 2g to 4g - 1 words on.

A gram asks for at most 2g places and only every g-th gram asks, so a class has at most two
pairs a word, whatever repeats. Pairs in order of lag and place are the furthest-covered
table: a seed that follows its neighbour on the same lag lies in what that one covers and is
not extended again. Extension takes gram identities of halving length, never word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from snaplens.llm.common import add_columns, mix

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("runs", T.ArrayType(RUN, False), False),
    T.StructField("collapsed", T.StringType(), False),
])
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a stretch of words of smallest period q and length ``max(shortest, 2 * q)`` or more
    which no neighbouring word extends. ``collapsed`` holds the words that no run contains after its
    first q words, joined by one space. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows are independent: repeated rows repeat their results, and columns of the
    three result names are replaced. Whole texts are read; memory is some 40 times the longest text.
    """
    if shortest < 4 or shortest % 4:
        raise ValueError("shortest must be a multiple of four")
    return add_columns(docs, text, FIELDS, lambda: lambda texts: _batch(texts, shortest), chars=2 << 20)


def split_words(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array that ends with a space."""
    change = np.flatnonzero(np.diff(SPACE[joined].view(np.int8), prepend=np.int8(1)))
    return change[::2], change[1::2]


def word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash per word: the sum of scrambled (place, byte) pairs, scrambled with its length."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), block):
        s, e = starts[a : a + block], ends[a : a + block]
        lengths = e - s
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        byte = joined[place + np.repeat(s, lengths)]
        part = mix((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(1))
        out[a : a + block] = mix(np.add.reduceat(part, first) + lengths.astype(np.uint64)) if len(part) else 0
    return out


def find_runs(word: np.ndarray, longest: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run; ``word`` holds ids that differ between documents of the batch.

    ``longest`` is the number of words of the longest document.
    """
    n, g = len(word), shortest // 2
    none = np.zeros(0, np.int64)
    if n < shortest:
        return none, none, none
    wide = 2 * n + 1
    gram = np.full(n - g + 1, g, np.uint64)
    for i in range(g):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + word[i : n - g + 1 + i])
    place, ids, kinds = _repeated(gram, np.arange(len(gram)))
    del gram
    found, tables, size = [], {}, g
    while len(place):
        table = np.full(n, -1, np.int64)
        table[place] = ids
        tables[size] = table
        keys = np.sort(ids * wide + place)  # occurrences of each gram in order
        if size == g:
            found.append(_near_pairs(keys, wide, shortest, size))
        if 4 * size > longest:
            break
        found.append(_far_pairs(keys, wide, place, ids, size, word, tables))
        both = place[place + size < n]
        both = both[table[both + size] >= 0]
        place, ids, kinds = _repeated(table[both] * kinds + table[both + size], both)
        size *= 2
    if not found:
        return none, none, none
    start, stop, lag = (np.concatenate(x) for x in zip(*found))
    kept = stop - start >= np.maximum(shortest - lag, lag)
    start, length, lag = start[kept], (stop - start + lag)[kept], lag[kept]
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    # multiples of the smallest period cover the same words
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    return start[first], length[first], lag[first]


def _repeated(grams: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places whose gram occurs more than once, the grams' ids, and the number of ids."""
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    again = again[np.flatnonzero(np.diff(again, prepend=again[:1] + again.dtype.type(1)))] if len(again) else again
    if not len(again):
        return place[:0], np.zeros(0, np.int64), 0
    at = np.minimum(np.searchsorted(again, grams), len(again) - 1)
    hit = again[at] == grams
    return place[hit], at[hit], len(again)


def _chains(lag: np.ndarray, place: np.ndarray, wide: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last seed of each chain of seeds ``step`` apart on one lag, and the lag."""
    keys = np.sort(lag * wide + place)
    cut = np.flatnonzero(np.diff(keys) != step)
    first, last = keys[np.concatenate(([0], cut + 1))], keys[np.concatenate((cut, [len(keys) - 1]))]
    return first % wide, last % wide, first // wide


def _near_pairs(keys, wide, shortest, size):
    """Diagonals at lags below ``shortest``: each of their grams is a seed, so chains are whole."""
    lags, places = [], []
    for t in range(1, shortest):
        if t >= len(keys):
            break
        lag = keys[t:] - keys[:-t]
        near = np.flatnonzero(lag < shortest)
        if not len(near):
            break
        lags.append(lag[near])
        places.append(keys[near] % wide)
    if not lags:
        return (np.zeros(0, np.int64),) * 3
    first, last, lag = _chains(np.concatenate(lags), np.concatenate(places), wide, 1)
    return first, last + size, lag


def _far_pairs(keys, wide, place, ids, size, word, tables):
    """Diagonals at lags from 2 * size to 4 * size - 1, from the grams at multiples of ``size``."""
    asks = place % size == 0
    place, ids = place[asks], ids[asks]
    low = np.searchsorted(keys, ids * wide + place + 2 * size)
    count = np.searchsorted(keys, ids * wide + place + 4 * size) - low
    total = int(count.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    seed = np.repeat(place, count)
    first, last, lag = _chains(keys[at] % wide - seed, seed, wide, size)
    return _extended(first, last + size, lag, size, word, tables)


def _extended(start, stop, lag, size, word, tables):
    """Both ends moved as far as the words agree; less than ``size`` words, or a seed would have been there."""
    n = len(word)
    while size // 2 in tables:
        size //= 2
        table = tables[size]
        to = np.maximum(start - size, 0)
        start = np.where((start >= size) & (table[to] >= 0) & (table[to] == table[to + lag]), to, start)
        far = np.minimum(stop + lag, n - 1)
        same = (stop + lag < n) & (table[far - lag] >= 0) & (table[far - lag] == table[far])
        stop = np.where(same, stop + size, stop)
    for _ in range(size - 1):
        to = np.maximum(start - 1, 0)
        start = np.where((start > 0) & (word[to] == word[to + lag]), to, start)
        far = np.minimum(stop + lag, n - 1)
        stop = np.where((stop + lag < n) & (word[far - lag] == word[far]), stop + 1, stop)
    return start, stop, lag


def _batch(texts: list[str | None], shortest: int) -> list:
    joined = np.frombuffer(b"".join((t or "").encode() + b" " for t in texts), np.uint8).copy()
    sizes = np.fromiter((len((t or "").encode()) + 1 for t in texts), np.int64, len(texts))
    starts, ends = split_words(joined)
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(sizes))))  # words of each text
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    word = mix(word_hashes(joined, starts, ends) + mix(owner.astype(np.uint64) + np.uint64(1)))
    start, length, period = find_runs(word, int(counts.max(initial=0)), shortest)

    depth = np.zeros(len(word) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth)[:-1] == 0

    # each kept word with the space after it
    edge = np.zeros(len(joined) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept] + 1] -= 1
    joined[ends] = 0x20
    out = joined[np.cumsum(edge, dtype=np.int8)[:-1] > 0]
    held = np.zeros(len(texts), np.int64)
    np.add.at(held, owner[kept], (ends - starts + 1)[kept])
    upto = np.concatenate(([0], np.cumsum(held)))
    body = out.tobytes()
    collapsed = [body[a : max(a, b - 1)] for a, b in zip(upto, upto[1:])]

    by_text = np.lexsort((period, start))
    start, length, period = start[by_text], length[by_text], period[by_text]
    whose = owner[start] if len(start) else start
    offsets = np.searchsorted(whose, np.arange(len(texts) + 1)).astype(np.int32)
    fields = [pa.array(x, pa.int64()) for x in (start - bounds[whose], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(counts), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
