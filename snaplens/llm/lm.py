"""Language-model scores from a log-frequency Bloom filter.

The corpus is dealt into pieces by the hash of each row. A piece counts its words and
word pairs and asks for each different one once, however often it holds it, so a very
common word costs one entry a piece. Counts meet in the segment of their hash. A
segment adds them up, quantises them on a log scale and puts them into its part of the
Bloom filter: an n-gram of level l is entered once for every level up to l, and a
reader probes level after level until one is missing. The whole filter grows with the
corpus, so it is not broadcast: each segment answers the probes of all pieces, with one
byte for each n-gram. The pieces then score their texts; probabilities smooth the pair
counts with the word counts. Exact word counts, for the base score, come back the same
way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplens.llm.common import WordHashes, bucket_count, mix, plain, saved, table, text_bytes, words

STEP = 2**0.5  # ratio of neighbouring count levels
PROBES = 4  # bits per entry
BITS_PER_ENTRY = 10
PRIOR = 32.0  # weight of the word model against the pair counts
ADD = 0.1  # pseudo-count of a word
PIECE = 8 << 20  # bytes of text counted together
SEGMENT_BYTES = 32 << 20  # of text for each segment of the filter
END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
WORDS, PAIRS = 0, 1


def token_hashes(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each closed by ``END``, and tokens per text."""
    parts, sizes = [], []
    for text in texts:
        found = hashes.of(words(text))
        parts += [found, np.array([END])]
        sizes.append(len(found) + 1)
    return np.concatenate(parts), np.array(sizes)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(STEP) + 1e-9).astype(np.int64)


def level_value(level: np.ndarray) -> np.ndarray:
    """The count a level stands for; 0 for none."""
    return np.where(level > 0, np.maximum(1.0, STEP ** (level - 0.75)), 0.0)


def _bits(grams: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mix(grams + np.uint64((level << 40) ^ (probe + 1) * 0x1B54A32D192ED03))


def filter_segment(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one segment, holding each n-gram once per level of its (positive) count."""
    top = levels(counts)
    size = 1 << max(6, int(np.ceil(np.log2(max(1, int(top.sum()) * BITS_PER_ENTRY)))))
    bits = np.zeros(size, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        held = grams[top >= level]
        for probe in range(PROBES):
            bits[_bits(held, level, probe) & np.uint64(size - 1)] = True
    return bits


def probed_levels(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Level of each n-gram, read by probing one level after the other."""
    level, mask = np.zeros(len(grams), np.uint8), np.uint64(len(bits) - 1)
    alive, now = np.arange(len(grams)), 0
    while len(alive):
        now += 1
        for probe in range(PROBES):
            alive = alive[bits[_bits(grams[alive], now, probe) & mask]]
        level[alive] = now
    return level


def steps(grams: np.ndarray) -> bytes:
    """The lower halves of pair hashes, which tell a segment's pairs apart, in ascending order.

    Written as differences, all lowest bytes first: the high bytes are nearly all zero.
    """
    low = (grams & np.uint64(0xFFFFFFFF)).astype("<u4")
    return np.diff(low, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_steps(raw: bytes) -> np.ndarray:
    moved = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(moved, dtype=np.uint32)


class Piece:
    """The different words and pairs of some texts, in an order that a second reading finds again."""

    def __init__(self, texts: list[str | None], segments: int):
        tokens, self.sizes = token_hashes(texts, WordHashes())
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        words_, self.word = np.unique(tokens, return_inverse=True)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.starts] = np.searchsorted(words_, END)  # a text follows an end
        self.before = before
        pairs, self.pair = np.unique(mix(mix(words_)[before] + tokens * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
        self.grams = {WORDS: words_, PAIRS: pairs}
        self.number = {WORDS: self.word, PAIRS: self.pair}
        self.by_segment = {kind: self._dealt(g, segments) for kind, g in self.grams.items()}

    @staticmethod
    def _dealt(grams: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments that hold some of the n-grams, the n-grams' order by segment, and where each begins."""
        segment = ((grams >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
        order = np.lexsort((grams & np.uint64(0xFFFFFFFF), segment))
        found, begins = np.unique(segment[order], return_index=True)
        return found, order, begins

    def questions(self, train: np.ndarray):
        """Rows kind, segment, n-grams, counts in training texts."""
        learn = np.repeat(train, self.sizes)
        for kind, grams in self.grams.items():
            counts = np.bincount(self.number[kind][learn], minlength=len(grams)).astype("<u4")
            segment, order, begins = self.by_segment[kind]
            for s, mine in zip(segment.tolist(), np.split(order, begins[1:])):
                yield kind, s, grams[mine].tobytes() if kind == WORDS else steps(grams[mine]), counts[mine].tobytes()

    def in_place(self, kind: int, answers: np.ndarray) -> np.ndarray:
        """Answers in the order of segments, put where their n-grams stand."""
        out = np.empty(len(answers), answers.dtype)
        out[self.by_segment[kind][1]] = answers
        return out


QUESTIONS = "kind int, part int, piece long, grams binary, counts binary"
_QUESTIONS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("piece", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
ANSWERS = "kind int, part int, piece long, levels binary, totals binary, tokens long, vocabulary long"
_ANSWERS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("piece", pa.int64()), ("levels", pa.binary()), ("totals", pa.binary()),
                      ("tokens", pa.int64()), ("vocabulary", pa.int64())])
SCORES = "doc_id long, n_tokens long, n_known long, base double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def answer_segment(kind: int, part: int, rows: pa.Table) -> pa.Table:
    """Build one segment of the filter and answer every piece's questions from it."""
    asked = [np.frombuffer(x, "<u8") if kind == WORDS else from_steps(x) for x in rows.column("grams").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()]
    different, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype("<i8")
    grams = mix(different.astype(np.uint64) + np.uint64(kind))
    seen = total > 0
    level = probed_levels(filter_segment(grams[seen], total[seen]), grams)
    ends = np.cumsum([len(a) for a in asked])[:-1]
    numbers = np.split(at, ends)
    n = len(asked)
    exact = [total[i].tobytes() for i in numbers] if kind == WORDS else [None] * n
    stats = [int(total.sum()), int(seen.sum())] if kind == WORDS else [0, 0]
    first = [[x] + [0] * (n - 1) for x in stats]
    return pa.Table.from_batches([table(_ANSWERS, [kind] * n, [part] * n, rows.column("piece").to_pylist(), [level[i].tobytes() for i in numbers], exact, *first)])


def score_piece(piece: Piece, level: dict[int, np.ndarray], total: np.ndarray, denominator: float):
    """Known tokens, base sum (without the denominator) and model score of each text."""
    held = level_value(np.arange(256))
    word, pair = held[level[WORDS]], held[level[PAIRS]]
    one = np.minimum((word + ADD) / denominator, 1.0)[piece.word]
    context = word[piece.before]
    both = np.minimum(pair[piece.pair], context)
    log = np.log10((both + PRIOR * one) / (context + PRIOR))
    known = np.add.reduceat((total > 0)[piece.word].astype(np.int64), piece.starts)
    base = np.add.reduceat(np.log10(total + ADD)[piece.word], piece.starts)
    return known, base, np.add.reduceat(log, piece.starts)


def lm_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words between ASCII spaces, A-Z lower-cased, and an end. The model
    learns from the rows where ``train`` holds, each as often as it occurs. A null text
    counts as empty: only the end is scored. Without training rows all counts are 0.
    ``score`` is the base-10 logarithm of the model's probability of the text. Null and
    repeated ids are rows like any other; other columns are not read. Two numbers reach
    the driver. A task holds one piece or one segment; the longest text is the only
    other thing that its size depends on.
    """
    size = text_bytes(docs, text) + 64 * docs.count()
    pieces, segments = bucket_count(size, PIECE), bucket_count(size, SEGMENT_BYTES)
    whole = F.coalesce(plain(text), F.lit(""))
    placed = docs.select(
        F.pmod(F.xxhash64(plain(doc_id), whole), F.lit(pieces)).alias("piece"), plain(doc_id).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"), whole.alias("text"))

    def ask(key, rows):
        piece = Piece(rows.column("text").to_pylist(), segments)
        flags = rows.column("train").to_numpy().astype(bool)
        kind, part, grams, counts = zip(*piece.questions(flags))
        return pa.Table.from_batches([table(_QUESTIONS, kind, part, [key[0].as_py()] * len(kind), grams, counts)])

    def answer(key, rows):
        return answer_segment(key[0].as_py(), key[1].as_py(), rows)

    asked = placed.groupBy("piece").applyInArrow(ask, QUESTIONS)
    answers = saved(asked.groupBy("kind", "part").applyInArrow(answer, ANSWERS), "answers")
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    denominator = n + ADD * (v + 1)

    def score(rows, found):
        piece = Piece(rows.column("text").to_pylist(), segments)
        kind, part = found.column("kind").to_numpy(), found.column("part").to_numpy()

        def read(of, name, dtype):
            column = found.column(name).to_pylist()
            mine = np.flatnonzero(kind == of)
            raw = b"".join(column[i] for i in mine[np.argsort(part[mine])])
            return piece.in_place(of, np.frombuffer(raw, dtype))

        level = {of: read(of, "levels", np.uint8) for of in (WORDS, PAIRS)}
        known, base, log = score_piece(piece, level, read(WORDS, "totals", "<i8"), denominator)
        return pa.Table.from_batches([table(_SCORES, rows.column("doc_id").to_pylist(), piece.sizes, known, base, log)])

    back = answers.select("piece", "kind", "part", "levels", "totals")
    scored = placed.select("piece", "doc_id", "text").groupBy("piece").cogroup(back.groupBy("piece")).applyInArrow(score, SCORES)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(denominator))).alias("base_score"), "score",
    )
