"""Language identification by nearest centroid over letter trigrams.

Texts become TF-IDF vectors of hashed trigrams of lower-case letters, of length one.
Each language has several centroids from spherical k-means, and a text gets the
language of the centroid with the largest cosine. It is rejected if it lies farther
from that centroid than texts of its length do in training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplens.llm.common import add_columns, plain, worker_state

SIZE = 4096  # hashed trigrams
CENTROIDS = 4  # per language
SAMPLE = 300  # labelled rows per language that the fit may see
LONGEST = 50_000  # characters; longer texts are not drawn for the fit
LENGTHS = 12  # length classes of the rejection distance: 2^k letters
MARGIN = 0.6  # a text may have this share of the smallest cosine seen in training
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    centroids: np.ndarray  # (centroids, SIZE)
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    least: np.ndarray  # (languages, LENGTHS): smallest cosine that is not rejected


def letter_table() -> np.ndarray:
    state = worker_state("langid")
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return state["letters"]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts (texts x SIZE) and letters per text; what is no letter is a space."""
    lower = [" " + (t or "").lower() + " " for t in texts]
    sizes = np.array([len(t) for t in lower])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[points]
    which = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(which[is_letter], minlength=len(texts))
    points = np.where(is_letter, points, 32).astype(np.uint32)
    h = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = (which[:-2] == which[2:]) & is_letter[1:-1]  # within one text, around a letter
    slot = which[:-2] * SIZE + (h >> np.uint32(20))
    found = np.bincount(slot[inside], minlength=len(texts) * SIZE)
    return found.reshape(len(texts), SIZE), letters


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from a farthest-first start; fewer centroids if rows coincide."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        near = (x @ x[start].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        start.append(int(np.argmin(near)))
    centres = x[start]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[near == i].sum(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def draw_sample(docs: DataFrame, train: Column, doc_id: str, text: str, lang: str, per_language: int) -> list:
    """At most ``per_language`` labelled rows of each language, by the hash of their id."""
    usable = docs.select(plain(doc_id).alias("d"), plain(text).alias("t"), plain(lang).alias("l"), train.alias("use"))
    usable = usable.filter("use AND d IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    order = Window.partitionBy("l").orderBy(F.xxhash64("d"), "d")
    picked = usable.select("d", "l").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    ids = sorted({r["d"] for r in picked.select("d").collect()})
    once = Window.partitionBy("d", "l").orderBy(F.xxhash64("t"))  # an id that repeats counts once
    rows = usable.filter(F.col("d").isin(ids) & (F.length("t") <= LONGEST)).withColumn("n", F.row_number().over(once))
    return rows.filter("n = 1").select("d", "l", "t").collect()


def fit(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = SAMPLE, centroids: int = CENTROIDS,
) -> LanguageModel:
    """Fit on a bounded sample: ``per_language`` rows of each label where ``train`` holds.

    Only text and label are learned from. Rows without text or label, texts without a
    letter and texts above ``LONGEST`` characters are not drawn. Without any usable row
    the model has no languages and every text is ``und``.
    """
    rows = sorted(draw_sample(docs, train, doc_id, text, lang, per_language))
    texts = [r["t"] for r in rows]
    if texts:
        found, letters = counts(texts)
    rows = [r for i, r in enumerate(rows) if letters[i]] if texts else []
    if not rows:
        return LanguageModel((), np.zeros((0, SIZE), np.float32), np.zeros(0, int), np.ones(SIZE, np.float32), np.zeros((0, LENGTHS)))
    found = found[letters > 0]
    idf = (np.log((1 + len(rows)) / (1 + (found > 0).sum(axis=0))) + 1).astype(np.float32)
    languages = tuple(sorted({r["l"] for r in rows}))
    label = np.array([languages.index(r["l"]) for r in rows])
    x = vectors(found, idf)
    groups = [kmeans(x[label == i], centroids) for i in range(len(languages))]
    owner = np.repeat(np.arange(len(languages)), [len(g) for g in groups])
    centres = np.concatenate(groups)

    least = np.ones((len(languages), LENGTHS))
    for k in range(LENGTHS):  # every training text, and its opening 2^k letters, set the distance for their length
        cut, n = counts([r["t"][: 1 << (k + 1)] for r in rows])
        sims = vectors(cut, idf) @ centres.T
        for i in range(len(languages)):
            mine = sims[(label == i) & (n >= 1 << k)][:, owner == i]
            if len(mine):
                least[i, k] = mine.max(axis=1).min() * MARGIN
    least = np.minimum.accumulate(np.where(least == 1, np.inf, least)[:, ::-1], axis=1)[:, ::-1]
    return LanguageModel(languages, centres, owner, idf, np.where(np.isinf(least), 0, least))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Whole texts are read. A text that is null or has no letter is ``und`` with score 0
    and rejected. Equal cosines go to the language first by name. Columns with the
    three names are replaced, others pass through. The broadcast model holds
    languages x centroids x ``SIZE`` numbers, whatever the data's size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.centroids, model.owner, model.idf, model.least))

    def start():
        m = LanguageModel(*shipped.value)
        names = np.array([*m.languages, UNKNOWN], dtype=object)

        def work(texts):
            found, letters = counts(texts)
            known = (letters > 0) & bool(m.languages)
            if not m.languages:
                return [[UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)]
            sims = vectors(found, m.idf) @ m.centroids.T
            best = np.argmax(sims, axis=1)
            score = np.where(known, np.clip(sims[np.arange(len(texts)), best].astype(float), 0, 1), 0.0)
            length = np.clip(np.log2(np.maximum(letters, 1)).astype(int), 0, LENGTHS - 1)
            rejected = ~known | (score < m.least[m.owner[best], length])
            return [names[np.where(known, m.owner[best], len(m.languages))].tolist(), score, rejected]

        return work

    fields = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ])
    return add_columns(docs, text, fields, start, chars=1 << 20, rows=512)
