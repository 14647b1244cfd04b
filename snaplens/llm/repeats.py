"""Removal of byte strings that occur earlier in the corpus, by suffix sorting of content shards.

1. Every window of ``length`` bytes picks the smallest hash among its byte grams as its anchor;
   windows in a row with one anchor are a segment. Equal windows pick equal anchors, so all copies
   of a window meet under one anchor.
2. Segments meet by anchor. Equal segments become one: the first keeps its place, the others are
   removed as a whole. An anchor with a single segment left is unique; the rest go on.
3. Segments of the anchors that go on are read from their first occurrence and dealt to shards by
   anchor. Each shard is suffix-sorted by induction (see ``induced``); adjacent suffixes with a common
   prefix of ``length`` bytes form classes, and all but the earliest of a class are removed.
4. Removed windows meet their document again.

Texts move only for documents that a fixed-size bit set of wanted keys lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.llm.common import bucket_count, mix, pieces, plain, saved, text_bytes
from snaplens.llm.induced import RADIX, Scratch, suffix_order

GRAM = 24
UNRADIX = np.uint64(pow(int(RADIX), -1, 1 << 64))
LAST = np.iinfo(np.int64).max  # a null id comes last
WORDS = 1 << 17  # longs of the bit set: one megabyte, whatever the corpus

RESULT = [
    T.StructField("n_bytes", T.LongType(), False),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])), False),
    T.StructField("kept", T.BinaryType(), False),
]
SEGMENTS = ["doc", "key", "lo", "n", "anchor"]


def remove_repeats(
    docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, shard_bytes: int = 4 << 20
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (start and length of maximal removed byte runs) and ``kept`` (the other bytes).

    Removed is every byte that a string of ``length`` bytes covers which also starts earlier: in a document of smaller
    id (null last; documents of one id by a hash of id and text), or earlier in the same one. Rows equal in id
    and text are copies of one another: one of them counts as the first. Null texts are empty; texts shorter
    than ``length`` lose nothing. Other columns stay; columns of the three result names are replaced.
    ``length`` is at least 48. ``bucket_bytes`` and ``shard_bytes`` are the text that a task aims to hold; larger shards spill.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    kept_names = [f.name for f in docs.schema if f.name not in {r.name for r in RESULT}]
    total = text_bytes(docs, text)
    buckets = bucket_count(total, bucket_bytes)
    keyed = docs.select(
        *[plain(c) for c in kept_names],
        plain(doc_id).cast("long").alias("__doc"),
        F.xxhash64(F.coalesce(plain(doc_id).cast("string"), F.lit("-")), F.coalesce(plain(text), F.lit(""))).alias("__key"),
        F.coalesce(plain(text), F.lit("")).alias("__text"))

    local = keyed.filter(F.octet_length("__text") >= length).select("__doc", "__key", "__text")
    anchors = local.mapInArrow(lambda batches: _anchors(batches, length, buckets), "bucket int, " + _arrays("doc key lo n anchor segment mark_doc mark_key mark_lo mark_n"))
    met = saved(anchors.groupBy("bucket").applyInArrow(
        lambda table: _meet(table, length, buckets), "dealt int, size long, " + _arrays("doc key lo n anchor mark_doc mark_key mark_lo mark_n")), "met")

    wanted = met.filter("size(key) > 0")
    shards = bucket_count(met.agg(F.sum("size")).first()[0], shard_bytes)
    asked = _through(keyed, _bits(wanted.select(F.explode("key").alias("key")))).select(
        F.pmod("__key", F.lit(buckets)).cast("int").alias("dealt"), "__key", "__text")
    segments = wanted.select("dealt", *SEGMENTS).groupBy("dealt").cogroup(asked.groupBy("dealt")).applyInArrow(
        lambda rows, texts: _cut(rows, texts, length, shards), "shard int, bytes binary, " + _arrays("doc key lo n"))
    sorted_ = saved(
        segments.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
            lambda batches: _shards(batches, length, buckets), "dealt int, " + _arrays("mark_doc mark_key mark_lo mark_n")), "sorted")

    marks = met.select("dealt", "mark_key", "mark_lo", "mark_n").unionByName(sorted_.select("dealt", "mark_key", "mark_lo", "mark_n"))
    marks = marks.filter("size(mark_key) > 0")
    twins = keyed.groupBy("__key").count().filter("count > 1").select(F.col("__key").alias("key"))
    bits = _bits(marks.select(F.explode("mark_key").alias("key")).unionByName(twins))
    flagged = _flag(keyed, bits)
    schema = T.StructType([docs.schema[c] for c in kept_names] + RESULT)
    hit = flagged.filter("__hit").drop("__hit").withColumn("dealt", F.pmod("__key", F.lit(buckets)).cast("int"))
    mended = hit.groupBy("dealt").cogroup(marks.groupBy("dealt")).applyInArrow(lambda rows, found: _mend(rows, found, length, schema), schema)
    whole = flagged.filter("NOT __hit").select(
        *[plain(c) for c in kept_names], F.octet_length("__text").cast("long").alias("n_bytes"),
        F.array().cast(RESULT[1].dataType).alias("removed"), F.col("__text").cast("binary").alias("kept"))
    return mended.unionByName(whole)


def _arrays(names: str) -> str:
    return ", ".join(f"{n} array<{'int' if n in ('lo', 'n', 'mark_lo', 'mark_n') else 'long'}>" for n in names.split())


def _word(key: str) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(WORDS)).cast("int")


def _bits(keys: DataFrame) -> DataFrame:
    """A bit set of ``key`` as at most ``WORDS`` rows."""
    one = F.expr("shiftleft(1L, cast(key & 63 as int))")
    return keys.groupBy(_word("key").alias("__word")).agg(F.bit_or(one).alias("__bits"))


def _flag(keyed: DataFrame, bits: DataFrame) -> DataFrame:
    """``keyed`` with ``__hit``: true for every key in the set, and for a few others."""
    joined = keyed.withColumn("__word", _word("__key")).join(F.broadcast(bits), "__word", "left")
    hit = F.coalesce(F.expr("bit_get(__bits, cast(__key & 63 as int)) = 1"), F.lit(False))
    return joined.withColumn("__hit", hit).drop("__word", "__bits")


def _through(keyed: DataFrame, bits: DataFrame) -> DataFrame:
    return _flag(keyed, bits).filter("__hit")


def _flat(table, name: str) -> np.ndarray:
    column = table.column(name)
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _dealt(target: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Columns ordered by target, the targets, and where each begins (and the last ends)."""
    order = np.argsort(target, kind="stable")
    which, first = np.unique(target[order], return_index=True)
    return which, np.append(first, len(target)), {k: v[order] for k, v in columns.items()}


def _kind(name: str) -> pa.DataType:
    return pa.int32() if name.split("_")[-1] in ("lo", "n") else pa.int64()


def _rows(number: str, parts: list[tuple[np.ndarray, dict[str, np.ndarray]]], extra=None) -> pa.RecordBatch:
    """One row per target over several groups of list columns, each dealt by its own targets."""
    every = np.unique(np.concatenate([t for t, _ in parts])) if parts else np.zeros(0, np.int64)
    columns, names = [pa.array(every, pa.int32())], [number]
    for target, group in parts:
        which, cuts, ordered = _dealt(target, group)
        ends = np.searchsorted(np.repeat(which, np.diff(cuts)), every, "right")
        for name, values in ordered.items():
            columns.append(_lists(values, np.concatenate(([0], ends)), _kind(name)))
            names.append(name)
    for name, values in (extra(every) if extra else {}).items():
        columns.insert(1, values)
        names.insert(1, name)
    return pa.RecordBatch.from_arrays(columns, names=names)


def window_anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """Segments of the windows of ``length`` bytes of texts laid end to end: start, windows, anchor, content hash."""
    n = len(data)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, RADIX))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, UNRADIX))))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    del power
    gram = mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    # the high half of the hash, then the place: the least is the leftmost of the smallest
    gram = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    wide, held = length - GRAM + 1, 1
    least = gram
    while held * 2 <= wide:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    least = np.minimum(least[: n - length + 1], least[wide - held : wide - held + n - length + 1])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = sizes >= length
    inside[starts[long]] += 1
    inside[(starts + sizes - length + 1)[long]] -= 1
    window = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: n - length + 1])
    if not len(window):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    at = at[window]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(window) != 1))))
    lo, count = window[new], np.diff(np.append(new, len(window)))
    stop = lo + count + length - 1
    anchor = mix((total[at[new] + GRAM] - total[at[new]]) * back[at[new]])
    content = mix((total[stop] - total[lo]) * back[lo] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return lo, count, anchor, content


def _firsts(anchor, segment, doc, key, lo):
    """Order by segment, then document and place; which begin a segment, and which begin an anchor."""
    order = np.lexsort((lo, key, doc, segment, anchor))
    a, s = anchor[order], segment[order]
    other = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
    return order, other | np.concatenate(([True], s[1:] != s[:-1]))[: len(a)], other


def _merged(doc, key, lo, n):
    """Windows in a row of one document as one."""
    order = np.lexsort((lo, key, doc))
    doc, key, lo, n = doc[order], key[order], lo[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != (lo + n)[:-1])))[: len(lo)])
    return doc[new], key[new], lo[new], np.add.reduceat(n, new) if len(new) else n


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2 << 20, 1 << 16):
        data, sizes = _bytes(batch.column(2))
        starts = np.cumsum(sizes) - sizes
        if len(data) < length:
            continue
        lo, n, anchor, segment = window_anchors(data, starts, sizes, length)
        which = np.searchsorted(starts, lo, "right") - 1
        doc, key, lo = _ids(batch.column(0))[which], batch.column(1).to_numpy()[which], lo - starts[which]
        anchor, segment = anchor.view(np.int64), segment.view(np.int64)
        order, first, _ = _firsts(anchor, segment, doc, key, lo)
        again = order[~first]
        order = order[first]
        target = np.mod(anchor[order], buckets)
        mark = _merged(doc[again], key[again], lo[again], n[again])
        yield _rows("bucket", [
            (target, {"doc": doc[order], "key": key[order], "lo": lo[order], "n": n[order], "anchor": anchor[order], "segment": segment[order]}),
            (np.mod(mark[1], buckets), dict(zip(("mark_doc", "mark_key", "mark_lo", "mark_n"), mark)))])


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and their sizes."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def _meet(table: pa.Table, length: int, buckets: int) -> pa.Table:
    doc, key, lo, n, anchor, segment = (_flat(table, c) for c in ("doc", "key", "lo", "n", "anchor", "segment"))
    order, first, other = _firsts(anchor, segment, doc, key, lo)
    again = order[~first]
    same = np.concatenate(([False], (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1]) & (lo[order][1:] == lo[order][:-1])))
    again = order[~first & ~same[: len(order)]]  # a row equal in id and text is no earlier document
    group = np.cumsum(other) - 1
    several = np.bincount(group, weights=first, minlength=len(group) and group[-1] + 1) > 1
    asked = order[first & several[group]] if len(group) else order
    mark = [np.concatenate((_flat(table, f"mark_{c}"), values[again])) for c, values in (("doc", doc), ("key", key), ("lo", lo), ("n", n))]
    mark = _merged(*mark)
    picked = {c: v[asked] for c, v in (("doc", doc), ("key", key), ("lo", lo), ("n", n), ("anchor", anchor))}
    batch = _rows("dealt", [
        (np.mod(key[asked], buckets), picked),
        (np.mod(mark[1], buckets), dict(zip(("mark_doc", "mark_key", "mark_lo", "mark_n"), mark)))],
        lambda every: {"size": pa.array(_sizes(every, np.mod(picked["key"], buckets), picked["n"] + length), pa.int64())})
    return pa.Table.from_batches([batch])


def _sizes(every: np.ndarray, target: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(every), np.int64)
    np.add.at(out, np.searchsorted(every, target), n)
    return out


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data``, end to end."""
    return data[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)]


def _cut(rows: pa.Table, texts: pa.Table, length: int, shards: int) -> pa.Table:
    doc, key, lo, n, anchor = (_flat(rows, c) for c in SEGMENTS)
    data, sizes = _bytes(texts.column("__text").combine_chunks())
    keys = texts.column("__key").to_numpy()
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    begin = starts[order[np.searchsorted(keys[order], key)]] + lo if len(key) else lo
    target = np.mod(mix(anchor.view(np.uint64)).view(np.int64), shards)
    which, cuts, held = _dealt(target, {"doc": doc, "key": key, "lo": lo, "n": n, "begin": begin})
    sizes = held["n"] + length - 1
    out = _gather(data, held["begin"], sizes).tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes)))[cuts]
    columns = [pa.array(which, pa.int32()), pa.array([out[a:b] for a, b in zip(ends, ends[1:])], pa.binary())]
    columns += [_lists(held[c], cuts, _kind(c)) for c in ("doc", "key", "lo", "n")]
    return pa.table(columns, names=["shard", "bytes", "doc", "key", "lo", "n"])


def _shards(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    held, at = [], None
    for batch in batches:
        for i, shard in enumerate(batch.column(0).to_pylist()):
            if shard != at and held:
                yield from _sorted(held, length, buckets)
                held = []
            at = shard
            held.append(batch.slice(i, 1))
    if held:
        yield from _sorted(held, length, buckets)


def _sorted(rows: list[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of a shard that an earlier document, or place, has too."""
    doc, key, lo, n = (np.concatenate([_flat(r, c) for r in rows]) for c in ("doc", "key", "lo", "n"))
    sizes = n.astype(np.int64) + length  # with one separator
    starts = np.cumsum(sizes) - sizes
    with Scratch() as scratch:
        text = scratch.empty(int(sizes.sum()) + 1, np.int16)
        done = 0
        filled = np.ones(len(text), bool)
        filled[starts + sizes - 1] = False
        filled[-1] = False
        places = np.flatnonzero(filled)
        text[starts + sizes - 1], text[-1] = 1, 0
        for r in rows:
            data = np.frombuffer(r.column("bytes")[0].as_buffer(), np.uint8)
            text[places[done : done + len(data)]] = data.astype(np.int16) + 2
            done += len(data)
        del places, filled
        by_document = np.lexsort((key, doc))
        other = (np.diff(doc[by_document], prepend=doc[by_document[:1]]) != 0) | (np.diff(key[by_document], prepend=key[by_document[:1]]) != 0)
        rank = np.empty(len(doc), np.int64)
        rank[by_document] = np.cumsum(other)
        which = np.repeat(np.arange(len(doc)), sizes)
        order = suffix_order(text, scratch)
        order = order[1:]  # without the end
        within = order - starts[which[order]]
        order = order[within < n[which[order]]]
        prefix = _prefixes(text, length)[order]
        new = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        place = (order - starts[which[order]]) + lo[which[order]]
        earliest = rank[which[order]] * (1 << 32) + place  # by document, then by place
        first = np.minimum.reduceat(earliest, new)
        again = earliest != np.repeat(first, np.diff(np.append(new, len(order))))
        mark = _merged(doc[which[order[again]]], key[which[order[again]]], place[again], np.ones(again.sum(), np.int64))
    yield _rows("dealt", [(np.mod(mark[1], buckets), dict(zip(("mark_doc", "mark_key", "mark_lo", "mark_n"), mark)))])


def _prefixes(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` symbols from each place on (fewer at the end)."""
    n = len(text)
    total = np.zeros(n + 1, np.uint64)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, RADIX))))
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    stop = np.minimum(np.arange(n) + length, n)
    return (total[stop] - total[:n]) * np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, UNRADIX))))


def _mend(rows: pa.Table, found: pa.Table, length: int, schema: T.StructType) -> pa.Table:
    key, lo, n = (_flat(found, c) for c in ("mark_key", "mark_lo", "mark_n"))
    data, sizes = _bytes(rows.column("__text").combine_chunks())
    keys = rows.column("__key").to_numpy()
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    spot = np.searchsorted(ordered, key)
    hit = np.minimum(spot, len(ordered) - 1)
    own = (ordered[hit] == key) if len(ordered) else np.zeros(len(key), bool)
    begin = starts[order[hit[own]]] + lo[own]
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n[own] + length - 1, -1)
    # a further row equal in id and text is a copy of the first
    twin = order[1:][ordered[1:] == ordered[:-1]]
    twin = twin[sizes[twin] >= length]
    np.add.at(edge, starts[twin], 1)
    np.add.at(edge, (starts + sizes)[twin], -1)
    gone = np.cumsum(edge)[:-1] > 0
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    inner = starts[sizes > 0]
    head[inner] = gone[inner]
    first = np.flatnonzero(head)
    tail = gone.copy()
    tail[:-1] &= ~gone[1:]
    tail[(starts + sizes)[sizes > 0] - 1] = gone[(starts + sizes)[sizes > 0] - 1]
    size = np.flatnonzero(tail) - first + 1
    whose = np.searchsorted(starts + sizes, first, "right")
    cuts = np.searchsorted(whose, np.arange(len(sizes) + 1))
    spans = pa.StructArray.from_arrays([pa.array(first - starts[whose]), pa.array(size)], ["start", "length"])
    left = data[~gone].tobytes()
    upto = np.concatenate(([0], np.cumsum(~gone)))
    edges = np.concatenate((starts, [len(data)]))
    kept = [left[upto[a] : upto[b]] for a, b in zip(edges, edges[1:])]
    names = [f.name for f in schema][: -len(RESULT)]
    columns = [rows.column(c) for c in names] + [
        pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), pa.array(kept, pa.binary())]
    return pa.table(columns, names=[f.name for f in schema])
