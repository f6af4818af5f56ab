"""Language identification by nearest centroids of TF-IDF vectors.

A text becomes a vector of character trigrams (letters in lower case, all else
a space), hashed into ``DIMS`` places, damped by the logarithm, weighted by
inverse document frequency and scaled to length 1. Each language has several
centroids, found by spherical k-means over a bounded sample of its labelled
rows. A text gets the language of the centroid with the largest cosine; where
even that is below the language's ``reach`` for texts of its length, it is
rejected. The reach comes from a low quantile of the cosines of labelled rows
that had no part in the centroids, so single odd rows don't matter.

* Null texts and texts without a letter are ``und``, with score 0, and rejected.
* Without any labelled row there is nothing to compare with: all is ``und``.
* A language with few rows gets fewer centroids; ties go to the language that
  sorts first. Repeated rows get the same answer. An empty table gives none.
* Only doc_id, text and lang are read; clashing extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.llm.batches import learns_from, map_batches, stored

DIMS = 1 << 13
#: Labelled rows a language's centroids are fitted on, at most, and centroids of a language.
SAMPLE, CENTROIDS = 500, 4
#: Rows of all languages together, at most; with many languages each gets fewer, but one at least, so every language is learned.
TOTAL = 8000
#: Rows of a language that are looked at beyond half as many again as its sample, so that none is missed by chance.
SPARE = 40
#: A text is rejected below this share of this quantile of the held-out cosines among texts of its length.
SLACK, QUANTILE = 0.6, 0.01
#: Parts of the sample that are held out in turn, and rows that a class of lengths has at least.
FOLDS, FEW = 4, 10
#: Classes of lengths: powers of two of the number of different trigrams.
LENGTHS = 14
_SPACE = np.uint32(32)
_letters: np.ndarray | None = None


def letter_codes(text: str) -> np.ndarray:
    """Code points in lower case, with a space for whatever is no letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters[codes], codes, _SPACE)


def trigram_counts(text: str | None) -> np.ndarray | None:
    """How often each hashed trigram occurs; None if there is no letter."""
    if not text:
        return None
    codes = letter_codes(text)
    if not (codes != _SPACE).any():
        return None
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    keep = codes[1:-1] != _SPACE
    hashed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    hashed ^= hashed >> np.uint32(15)
    hashed = (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)
    return np.bincount(hashed[keep], minlength=DIMS)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # of each centroid, its language's number
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray  # of each language and class of lengths

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts.astype(np.float32)) * self.idf
        return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """Of each row the largest cosine to a centroid of each language."""
        to_all = self.vectors(counts) @ self.centroids.T
        return np.stack([to_all[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)


def _centroids(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means that starts from rows far from each other."""
    chosen = [int((rows @ rows.mean(0)).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        if near.min() > 0.999:
            break
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    found = rows[chosen]
    for _ in range(rounds):
        of = (rows @ found.T).argmax(1)
        sums = np.stack([rows[of == j].sum(0) if (of == j).any() else found[j] for j in range(len(found))])
        found = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


def length_class(counts: np.ndarray) -> np.ndarray:
    """Of each row the logarithm of its number of different trigrams, rounded down."""
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(int)


def _held_out(vectors: np.ndarray, of: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Of each row its largest cosine to a centroid, where those of its own language are fitted without it; NaN where none can be."""
    out = np.full(len(vectors), np.nan)
    for language in range(len(model.languages)):
        rows = np.flatnonzero(of == language)
        if len(rows) < 2:
            continue
        elsewhere = model.centroids[model.owner != language]
        folds = min(FOLDS, len(rows))
        for fold in range(folds):
            mine = np.arange(len(rows)) % folds == fold
            near = _centroids(vectors[rows[~mine]], k)
            out[rows[mine]] = (vectors[rows[mine]] @ np.concatenate((near, elsewhere)).T).max(1)
    return out


def _reach(cosines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The reach of each class of lengths; neighbouring classes with few rows are taken together."""
    out = np.zeros(LENGTHS)
    if not len(cosines):
        return out
    groups, first = [], 0
    for j in range(LENGTHS):
        if ((lengths >= first) & (lengths <= j)).sum() >= FEW:
            groups.append((first, j))
            first = j + 1
    if not groups:
        groups = [(0, LENGTHS - 1)]
    groups[-1] = (groups[-1][0], LENGTHS - 1)
    for a, b in groups:
        some = (lengths >= a) & (lengths <= b)
        out[a : b + 1] = SLACK * np.quantile(cosines[some], QUANTILE, method="lower")
    # Of texts shorter than any nothing is known but that cosines fall about with the root of the length.
    shortest = lengths.min()
    out[:shortest] *= np.sqrt(0.5) ** (shortest - np.arange(shortest))
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """A model of rows (doc_id, text, lang); ``sample`` rows of each language are used, spread by a hash of doc_id."""
    rows = labelled.where(F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that its size is known when it is decided whether to broadcast it.
    sizes = stored(sizes, "languages")
    count = sizes.count()
    if not count:
        return None
    sample = max(1, min(sample, TOTAL // count))
    # The share of its rows that gives a language half as many again as the sample and some; the rest goes below.
    # Rows are spread by id and text, so that an id that many rows share is taken as they are.
    place = F.xxhash64("doc_id", "text")
    share = sizes.select("lang", F.ceil(F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(1.5 * sample + SPARE) / F.col("n"))).alias("share"))
    chosen = rows.join(share, "lang").where(F.pmod(place, F.lit(1 << 30)) < F.col("share")).select(place.alias("order"), "text", "lang")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for order, text, lang in zip(batch.column("order"), batch.column("text"), batch.column("lang"), strict=True):
            counts = trigram_counts(text.as_py())
            if counts is not None:
                at = np.flatnonzero(counts)
                out.append((lang.as_py(), order.as_py(), at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "order", "at", "counts"]) if out else None

    # As many rows as the sample allows come to the driver.
    rank = F.row_number().over(W.partitionBy("lang").orderBy("order", "at", "counts"))
    some = map_batches(chosen, features, "lang string, order long, at binary, counts binary").distinct().withColumn("rank", rank).where(F.col("rank") <= sample)
    found = [(r.lang, r.at, r.counts) for r in sorted(some.collect(), key=lambda r: (r.lang, r["rank"]))]
    if not found:
        return None
    counts = np.zeros((len(found), DIMS), np.float32)
    for k, (_, at, n) in enumerate(found):
        counts[k, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    languages = sorted({x[0] for x in found})
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    model = Model(languages, np.zeros(0, int), np.zeros((0, DIMS), np.float32), idf, np.zeros(0, np.float32))
    vectors, of = model.vectors(counts), np.array([languages.index(x[0]) for x in found])
    each = [_centroids(vectors[of == k], centroids) for k in range(len(languages))]
    model.owner, model.centroids = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate(each)
    cosines, lengths = _held_out(vectors, of, model, centroids), length_class(counts)
    known = ~np.isnan(cosines)
    together = _reach(cosines[known], lengths[known])
    # A language with few rows has the reach of all together.
    own = [known & (of == k) for k in range(len(each))]
    model.reach = np.array([_reach(cosines[x], lengths[x]) if x.sum() >= FEW else together for x in own], np.float32)
    return model


def nearest(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the language, the cosine to its nearest centroid, and whether it is rejected."""
    n = len(texts)
    lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
    counts = [trigram_counts(x) for x in texts] if model else []
    at = [k for k, c in enumerate(counts) if c is not None]
    if at:
        found = np.stack([counts[k] for k in at])
        cosines = model.cosines(found)
        best = cosines.argmax(1)
        score[at] = np.clip(cosines[np.arange(len(at)), best], 0, 1)
        rejected[at] = score[at] < model.reach[best, length_class(found)]
        for k, b in zip(at, best, strict=True):
            lang[k] = model.languages[b]
    return lang, score, rejected


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected, with ``lang`` filled in where it is null."""
    at = docs.columns.index("lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, _, rejected = nearest(batch.column("text").to_pylist(), model)
        known = batch.column("lang")
        filled = pc.coalesce(known, pa.array(lang, known.type))
        return batch.set_column(at, "lang", filled).filter(pa.array(~rejected))

    return map_batches(docs, run, docs.schema)


def predict(docs: DataFrame, model: Model | None, also: list[str] | None = None) -> DataFrame:
    """The columns ``also`` (doc_id) with lang_pred, score (the cosine) and rejected, for every row."""
    also = also or ["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = nearest(batch.column("text").to_pylist(), model)
        columns = [batch.column(c) for c in also] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
        return pa.RecordBatch.from_arrays(columns, [*also, "lang_pred", "score", "rejected"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in also) + ", lang_pred string, score double, rejected boolean"
    return map_batches(docs.select(*dict.fromkeys([*also, "text"])), run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, learned from three quarters of the ids."""
    learns = learns_from("doc_id", 4, 2)
    model = fit(docs.where(learns).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(~learns, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
