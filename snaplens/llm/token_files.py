"""Token ids in binary shards with a minimal perfect hash index.

A shard holds the ids of a run of documents, in order of their keys, as raw
little-endian integers, followed by its index and a footer:

    payload       ids, 2 bytes each if the vocabulary allows it, else 4
    starts        uint64 per document and one more: where its ids start, in ids
    seeds         int32 per bucket of the hash function
    fingerprints  uint32 per slot (slots = different keys, no gap)
    first, count  uint32 each per slot: the key's first document in the shard, and how many
    footer        id width, documents, documents without key, keys, buckets, ids, magic

A key's slot comes from two hashes and one seed, so a look-up takes constant time and
reads no other key; a key that is not there is told by its fingerprint.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from snaplens.llm.bpe import read_spec
from snaplens.llm.common import Remembered, bucket_count, mix, new_folder, pieces, plain, saved, table, text_bytes, worker_state

SHARD_BYTES = 24 << 20  # of text
READERS = 20_000  # tasks that read shards back, at most; each then reads several
FOOTER = "<6Q8s"
MAGIC = b"TOKENS01"
# Of each line: letters whose lower case and normal form no neighbour changes, then perhaps ASCII signs; else nothing.
WORD_AND_STOPS = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|[^\n]*)$", re.M).findall
CACHED = 300_000  # chunks, and words, whose ids a worker remembers at least


class LibraryEncoder:
    """Whole texts through the tokenizers library, each different chunk between spaces once.

    The tokenizer must drop white space and never join across it, as word-end BPE does.
    Words of Latin-1 letters skip the normaliser once lower-cased, which leaves them as they are;
    signs after them are a word of their own.
    """

    def __init__(self, spec: str):
        self.full = Tokenizer.from_str(spec)
        self.slim = Tokenizer.from_str(spec)
        self.slim.normalizer = None
        self.slim.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ids = self.full.get_vocab().values()
        self.width = 2 if max(ids) < 1 << 16 else 4
        self.end = (self.full.model.end_of_word_suffix or "") if hasattr(self.full.model, "end_of_word_suffix") else ""
        self.closing = np.zeros(max(ids) + 1, bool)  # ids that end a word
        for token, i in self.full.get_vocab().items():
            self.closing[i] = bool(self.end) and token.endswith(self.end)
        self.known = Remembered(CACHED)
        self.plain = Remembered(CACHED)
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds = self.full.normalizer is not None and self.full.normalizer.normalize_str(capitals) == capitals.lower()

    def pack(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def cut(self, ids, ends: np.ndarray) -> list[bytes]:
        """The packed ids up to each of ``ends``."""
        raw, at = self.pack(ids), (ends * self.width).tolist()
        return [raw[i:j] for i, j in zip([0, *at], at)]

    def learn(self, chunks: list[bytes]) -> None:
        # Chunks hold no line breaks, so they are told apart in one go; words with signs are two words to the library.
        found = WORD_AND_STOPS(b"\n".join(chunks).decode().lower())
        heads = [(chunk, head, tail) for chunk, (head, tail) in zip(chunks, found, strict=True) if head]
        rest = [chunk for chunk, (head, _) in zip(chunks, found) if not head]
        new = self.plain.missing({head for _, head, _ in heads} | {tail for _, _, tail in heads if tail})
        tails = [w for w in new if not w.isalpha()]
        new = [w for w in new if w.isalpha()]
        for i in range(0, len(new), 512):
            some = new[i : i + 512]
            ids = np.array(self.slim.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                self.plain.update(zip(some, self.cut(ids, ends)))
            else:
                self.plain.update((w, self.pack(e.ids)) for w, e in zip(some, self.slim.encode_batch(some, add_special_tokens=False)))
        for tail in tails:
            self.plain[tail] = self.pack(self.full.encode(tail, add_special_tokens=False).ids)
        word = self.plain
        self.known.update((chunk, word[head] + word[tail] if tail else word[head]) for chunk, head, tail in heads)
        # the others together too, cut by where each token starts; special tokens may take spaces with them
        odd = {c for c in rest if any(t in c for t in self.special)}
        rest = [c for c in rest if c not in odd]
        for i in range(0, len(rest), 512):
            some = [c.decode() for c in rest[i : i + 512]]
            ends = np.cumsum([len(c) + 1 for c in some])
            coded = self.full.encode(" ".join(some), add_special_tokens=False)
            at = np.searchsorted([a for a, _ in coded.offsets], ends)
            self.known.update(zip(rest[i : i + 512], self.cut(coded.ids, at)))
        odd = list(odd)
        for chunk, e in zip(odd, self.full.encode_batch([c.decode() for c in odd], add_special_tokens=False)):
            self.known[chunk] = self.pack(e.ids)

    def fold(self, raw: bytes) -> bytes:
        """A text with A-Z in lower case where its ids stay the same, so that fewer chunks differ.

        Letters may join the marks U+0300 to U+036F in one case only, and a special token is told by its case.
        """
        if not self.folds or b"\xcc" in raw or b"\xcd" in raw:
            return raw
        low = raw.lower()
        return raw if any(t in low for t in self.special) else low

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; a null text has none."""
        split = [self.fold(t.encode()).split() if t else [] for t in texts]
        new = self.known.missing(set().union(*split))
        if new:
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


def slots_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Where the hash function puts ``keys`` among ``n`` slots."""
    h = mix(keys.view(np.uint64) + np.uint64(0x51ED27))
    seed = seeds[(h % np.uint64(len(seeds))).astype(np.int64)]
    placed = mix(h ^ seed.astype(np.uint64)) % np.uint64(n)
    return np.where(seed < 0, -1 - seed, placed.astype(np.int64)).astype(np.int64)


def perfect_seeds(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of different ``keys``; large buckets choose first.

    A bucket of one key names its slot outright (as a negative seed).
    """
    n = len(keys)
    buckets = max(1, -(-n // 2))
    h = mix(keys.view(np.uint64) + np.uint64(0x51ED27))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    seeds, free = np.zeros(buckets, np.int32), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        mine, first = h[order[begins[b] : begins[b + 1]]], 1
        while True:
            trial = np.arange(first, first + 256, dtype=np.uint64)
            at = (mix(mine[None] ^ trial[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[at].all(axis=1)
            for i in np.flatnonzero(good):
                if len(set(at[i].tolist())) == len(mine):
                    break
            else:
                first += 256
                continue
            seeds[b], free[at[i]] = trial[i], False
            break
    single = np.flatnonzero(sizes == 1)
    seeds[single] = -1 - np.flatnonzero(free)[: len(single)]
    return seeds


def fingerprints_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xF1A6)) >> np.uint64(32)).astype(np.uint32)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, path: str):
        system, place = open_fs(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        self.width, rows, self.no_key, keys, buckets, ids, magic = struct.unpack(FOOTER, self.file.read_at(length := struct.calcsize(FOOTER), size - length))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        at = ids * self.width
        parts = []
        for kind, n in (("<u8", rows + 1), ("<i4", buckets), ("<u4", keys), ("<u4", keys), ("<u4", keys)):
            length = n * np.dtype(kind).itemsize
            parts.append(np.frombuffer(self.file.read_at(length, at), kind))
            at += length
        self.starts, self.seeds, self.prints, self.first, self.count = parts

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key (0 if the shard has none)."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = slots_of(keys, self.seeds, len(self.prints))
        here = self.prints[slot] == fingerprints_of(keys)
        return self.first[slot].astype(np.int64), np.where(here, self.count[slot], 0).astype(np.int64)

    def ids(self, document: int) -> np.ndarray:
        """Token ids of the shard's ``document``-th text."""
        start, end = int(self.starts[document]), int(self.starts[document + 1])
        raw = self.file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        if key is None:
            return [self.ids(i) for i in range(self.no_key)]
        first, count = self.find(np.array([key], np.int64))
        return [self.ids(int(first[0]) + i) for i in range(int(count[0]))]


def write_shard(path: str, width: int, keys: Iterator[tuple[list, list[bytes]]]) -> tuple:
    """Write batches of (keys, packed ids) in key order; returns the shard's manifest row."""
    system, place = open_fs(path)
    sizes, held = [], []
    with system.open_output_stream(place) as out:
        for some, packed in keys:
            held += some
            sizes += [len(p) // width for p in packed]
            out.write(b"".join(packed))
        no_key = held.count(None)
        key = np.array([k for k in held if k is not None], np.int64)
        different, first, count = np.unique(key, return_index=True, return_counts=True)
        seeds = perfect_seeds(different) if len(different) else np.zeros(0, np.int32)
        prints, firsts, counts = (np.zeros(len(different), np.uint32) for _ in range(3))
        if len(different):
            slot = slots_of(different, seeds, len(different))
            prints[slot], firsts[slot], counts[slot] = fingerprints_of(different), first + no_key, count
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        for part in (starts, seeds.astype("<i4"), prints, firsts, counts):
            out.write(part.tobytes())
        out.write(struct.pack(FOOTER, width, len(held), no_key, len(different), len(seeds), int(starts[-1]), MAGIC))
    low, high = (int(different[0]), int(different[-1])) if len(different) else (None, None)
    return path, low, high, no_key, len(held), int(starts[-1])


@dataclass(frozen=True)
class TokenFiles:
    """``manifest``: one row per shard, in key order: path, low, high, no_key, documents, ids, start."""

    manifest: DataFrame
    shards: list

    def get(self, key: int | None) -> list[np.ndarray]:
        """Token ids of a key's documents, from any place that reaches the files."""
        return [x for s in self.shards if holds(s, key) for x in ShardReader(s["path"]).get(key)]


def holds(shard, key: int | None) -> bool:
    return shard["no_key"] > 0 if key is None else shard["low"] is not None and shard["low"] <= key <= shard["high"]


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None
) -> TokenFiles:
    """Encode whole texts and write them in ascending order of key, null keys first.

    A null or empty text has only the end id. Rows with one key stand together, by the
    hash of their text; if a key has more rows than a shard holds, it runs over several
    shards. A shard is about ``SHARD_BYTES`` of text whatever the total. A task writes
    to a name of its own and only the manifest of finished tasks counts, so lost and
    repeated tasks leave no trace in the result. An empty table has no shards. Other
    columns are not read. The driver holds the manifest: one row per shard.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    system, place = open_fs(folder)
    system.create_dir(place, recursive=True)
    h = F.xxhash64("text")
    base = docs.select(plain(doc_id).cast("long").alias("key"), plain(text).alias("text"))
    shards = bucket_count(text_bytes(base) + 64 * base.count(), SHARD_BYTES)
    ordered = base.repartitionByRange(shards, "key", h).sortWithinPartitions("key", h)
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
                        ("no_key", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        state = worker_state("token_files")
        if state.get("library_of") != tokenizer:
            state["library_of"], state["library"] = tokenizer, LibraryEncoder(spec.value)
        coder = state["library"]
        end = coder.pack([end_id])
        some = next((b for b in batches if b.num_rows), None)
        if some is None:
            return

        def encoded():
            for piece in pieces(iter_after(some, batches), 4 << 20):
                yield piece.column(0).to_pylist(), [x + end for x in coder.encode(piece.column(1).to_pylist())]

        part = TaskContext.get().partitionId()
        row = write_shard(f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.bin", coder.width, encoded())
        yield table(schema, [part], *[[x] for x in row])

    manifest = saved(ordered.mapInArrow(write, "part int, path string, low long, high long, no_key long, documents long, ids long"), "manifest")
    rows, start = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append(r.asDict() | {"start": start})
        start += r["ids"]
    return TokenFiles(manifest, rows)


def iter_after(first, rest):
    yield first
    yield from rest


def read_tokens(files: TokenFiles, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Look up all different ``keys`` (null among them): one row per document found.

    Columns ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (binary,
    little-endian unsigned 32-bit). Keys go to the shards whose range holds them; each
    shard's index is then read by one task.
    """
    shards = files.shards
    lows = np.array([s["low"] for s in shards if s["low"] is not None], np.int64)
    highs = np.array([s["high"] for s in shards if s["low"] is not None], np.int64)
    keyed = [i for i, s in enumerate(shards) if s["low"] is not None]
    nulls = [i for i, s in enumerate(shards) if s["no_key"]]

    def place(batches):
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            some = found[~missing].astype(np.int64)
            a, b = np.searchsorted(highs, some, "left"), np.searchsorted(lows, some, "right")
            n = np.maximum(b - a, 0)
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            yield table(placed, [*[keyed[i] for i in at], *(nulls if missing.any() else [])],
                        [*np.repeat(some, n).tolist(), *([None] * len(nulls) if missing.any() else [])])

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        shard = shards[int(frame["shard"].iloc[0])]
        reader = ShardReader(shard["path"])
        wanted = frame["key"].dropna().astype("int64").to_numpy()
        first, count = reader.find(wanted)
        rows = [(None, i) for i in range(reader.no_key)] if frame["key"].isna().any() else []
        rows += [(int(k), f + i) for k, f, c in zip(wanted, first.tolist(), count.tolist()) for i in range(c)]
        rows.sort(key=lambda r: r[1])
        return pd.DataFrame({
            "doc_id": pd.array([k for k, _ in rows], dtype="Int64"),
            "start": [shard["start"] + int(reader.starts[i]) for _, i in rows],
            "ids": [reader.ids(i).tobytes() for _, i in rows],
        })

    placed = pa.schema([("shard", pa.int32()), ("key", pa.int64())])
    # The keys are few bytes, the payloads they call for are not: the tasks are numbered by shards.
    tasks = min(max(1, len(shards)), READERS)
    wanted = (
        keys.select(plain(key).cast("long").alias("key")).distinct().mapInArrow(place, "shard int, key long")
        .repartition(tasks, "shard").distinct()
    )
    return wanted.groupBy("shard").applyInPandas(read, "doc_id long, start long, ids binary")
