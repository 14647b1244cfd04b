"""Byte-pair encoding of whole texts by walking a trie of their distinct words.

The last token of a prefix's encoding is the one token that ends the prefix and may
follow the last token of what stands before it (two tokens may be neighbours if
encoding their joint text gives just these two). So the words are put in order, which
is a depth-first walk of their trie; each node gets its last token from its
ancestors', and a prefix shared by many words is worked out once.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from snaplens.llm.common import Remembered, add_columns, worker_state

CACHED = 250_000  # chunks, and words, whose ids a worker remembers at least


class Bpe:
    """Encoder and decoder for a tokenizer file of the word-end BPE kind (NFC, lower case).

    Without ``decode`` no text is kept or returned.
    """

    def __init__(self, spec: str, decode: bool = True):
        self.decode = decode
        data = json.loads(spec)
        model = data["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.made: dict[str, int] = {}  # which merge makes a token, and of what
        self.parts_of: dict[str, tuple[str, str]] = {}
        for i, (a, b) in enumerate(pairs):
            if a + b not in self.made:
                self.made[a + b], self.parts_of[a + b] = i, (a, b)
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        # the longest token of three letters or more that ends in these three (and perhaps in a word's end)
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            body = token.removesuffix(self.end) if token != self.end else token
            key = token[len(body) - 3 :] if len(body) >= 3 else ""
            self.reach[key] = max(self.reach.get(key, 0), len(body))
        self.alone: dict[str, bool] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.chunks = Remembered(CACHED)  # ids and their text of what stands between spaces
        self.words = Remembered(CACHED)  # ids of a word
        self.byte_name = _byte_names()
        self.split = regex.compile(next(_patterns(data["pre_tokenizer"])))
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")

    def parts(self, chunk: bytes) -> list[str]:
        """The pieces of a chunk: special tokens as they are, words as byte names."""
        head = chunk.rstrip(b".,")
        if head and head.isalpha():  # ASCII letters, then perhaps stops
            head, stops = head.decode().lower(), chunk[len(head) :].decode()
            return [head, stops] if stops else [head]
        found = []
        for text in self.special.split(chunk.decode()):
            if text in self.specials:
                found.append(text)
            else:
                text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
                found += ["".join(map(self.byte_name.__getitem__, w.encode())) for w in self.split.findall(text)]
        return found

    def learn(self, chunks: set[bytes]) -> None:
        """Encode chunks not seen so far: one walk over the trie of their words."""
        parts = {c: self.parts(c) for c in chunks}
        words = {p for found in parts.values() for p in found if p not in self.specials}
        self.words |= self.walk(sorted(self.words.missing(words)))
        known = self.words.__getitem__
        for chunk, found in parts.items():
            if len(found) == 1 and found[0] not in self.specials:
                self.chunks[chunk] = known(found[0])
            else:
                both = [(array("i", [self.specials[p]]).tobytes(), p) if p in self.specials else known(p) for p in found]
                self.chunks[chunk] = b"".join([c for c, _ in both]), " ".join([t for _, t in both]) if self.decode else ""

    def walk(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids of ordered words, and their tokens' names. ``path[i]`` is the last token of the first ``i`` letters."""
        path: list[str] = [""]
        before, done = "", {}
        for word in words:
            inner = len(word) - 1  # the last letter carries the word's end and is a leaf
            shared, most = 0, min(inner, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for i in range(shared + 1, inner + 1):
                path.append(self.last(word, i, "", path))
            tokens, at = [], len(word)
            token = self.last(word, at, self.end, path)
            tokens.append(token)
            at -= len(token) - len(self.end)
            while at:
                tokens.append(path[at])
                at -= len(path[at])
            tokens.reverse()
            done[word] = array("i", map(self.vocab.__getitem__, tokens)).tobytes(), " ".join(tokens) if self.decode else ""
            before = word
        return done

    def last(self, word: str, at: int, end: str, path: list[str]) -> str:
        """The last token of ``word[:at]`` + ``end``, given those of all shorter prefixes."""
        vocab, follows = self.vocab, self.follows
        for start in range(max(0, at - self.reach.get(word[max(0, at - 3) : at] + end, 2)), at):
            token = word[start:at] + end
            if token in vocab:
                if start == 0:
                    if self.is_alone(token):
                        return token
                else:
                    pair = (path[start], token)
                    fits = follows.get(pair)
                    if fits is None:
                        fits = follows[pair] = self.fits(*pair)
                    if fits:
                        return token
        raise ValueError(f"no token of the vocabulary ends {word[:at]!r}")

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens stay apart when their joint text is encoded.

        Their merges are undone from the last one on. What stands at the seam then would have been merged
        across it had that merge come before the one undone; of equal merges the left one comes first.
        """
        until = len(self.ranks)
        while True:
            if self.ranks.get((a, b), until) < until:
                return False
            left, right = self.made.get(a, -1), self.made.get(b, -1)
            if left > right:
                until, a = left, self.parts_of[a][1]
            elif right >= 0:
                until, b = right + 1, self.parts_of[b][0]
            else:
                return True

    def is_alone(self, token: str) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merge(self.letters(token)) == [token]
        return self.alone[token]

    def letters(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, lowest rank and leftmost first; for short inputs."""
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """The ids of each text as little-endian integers, and the text they decode to."""
        split = [t.encode().split() if t else [] for t in texts]
        if len(self.follows) > CACHED:
            self.follows.clear()
        new = self.chunks.missing(set().union(*split))
        if new:
            self.learn(new)
        found = [list(map(self.chunks.__getitem__, s)) for s in split]
        decoded = [" ".join([t for _, t in f if t]) for f in found] if self.decode else []
        return [b"".join([c for c, _ in f]) for f in found], decoded


def _byte_names() -> list[str]:
    """A printable character for every byte: itself where it prints, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


def _patterns(node: dict):
    if "pattern" in node:
        yield node["pattern"]["Regex"]
    for below in node.get("pretokenizers", ()):
        yield from _patterns(below)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked for, ``decoded`` (their text).

    ``tokenizer`` is the path of the tokenizer file on the driver; its content travels
    with the tasks and does not grow with the data. Every row is kept; a null, empty or
    blank text has no ids and decodes to an empty text. Columns named ``ids`` or
    ``decoded`` are replaced, others pass through. No rows meet, so nothing is shuffled.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def start():
        state = worker_state("bpe")
        if state.get("bpe_of") != (tokenizer, decode):
            state["bpe_of"], state["bpe"] = (tokenizer, decode), Bpe(spec.value, decode)
        coder = state["bpe"]

        def work(texts):
            ids, decoded = coder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            made = [pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4"))]
            return [*made, decoded] if decode else made

        return work

    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decode:
        fields = fields.add("decoded", T.StringType())
    return add_columns(docs, text, fields, start, chars=2 << 20)
