"""Language identification by nearest centroid.

A text is the bag of the 1-, 2- and 3-grams of the UTF-8 bytes of its lower-case letters (other characters are one space), hashed into
``DIMS`` counts, weighted by log(1 + count) * idf and scaled to length one. Each language has several centroids, found by spherical k-means
on a bounded sample of its labelled texts. A text takes the language of the centroid with the largest cosine. It is
rejected if that cosine is too low for its length: below half of the first percentile that the sample's own texts of
about that many grams reach, or if it holds no letter at all.

Bounds: at most ``SAMPLE`` texts per language are clustered (documented sample, by hash of the id); document frequencies are
counted over all labelled texts. The model is DIMS floats for each language and centroid.

Defined cases: NULL texts, texts without a letter and any text when there is no model get ``und`` and score 0. Ties go to the
language that sorts first. Empty training data gives an empty model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import row_key, staged

DIMS = 4096
SAMPLE = 3000
CENTROIDS = 4
ITERATIONS = 8
#: Share of the sample's first percentile below which a cosine is rejected.
SLACK = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x DIMS
    floors: np.ndarray  # by number of binary digits of the number of grams


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed grams of one whole text; None if it has no letter."""
    import re

    if not text:
        return None
    letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not any(c.isalpha() for c in letters):  # what is left may be signs such as ½ or Ⅷ
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    total = np.zeros(DIMS, np.int64)
    for i in range(0, len(codes), 1 << 18):  # bounds the memory of a very long text
        one = codes[i:i + (1 << 18) + 2]
        two = one[:-1] * 257 + one[1:]
        three = two[:-1] * 257 + one[2:]
        last = i + (1 << 18) >= len(codes)
        own = len(one) if last else 1 << 18
        for salt, grams in ((1, one), (2, two), (3, three)):
            mixed = (grams[:own] + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            total += np.bincount((mixed ^ (mixed >> 15)) % DIMS, minlength=DIMS)
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    length = np.sqrt((values * values).sum())
    return at, (values / length if length > 0 else values)


def _size_class(grams: int) -> int:
    return int(grams).bit_length()


def _frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with letters, and for each gram how many of them hold it; each task sends one vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, total = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts = gram_counts(text)
                if counts is not None:
                    texts += 1
                    total += counts > 0
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "n": np.concatenate(([texts], total))})

    summed = train.select("text").mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    rows = dict(summed.collect())  # DIMS + 1 rows
    return rows.get(-1, 0), np.array([rows.get(i, 0) for i in range(DIMS)], np.float64)


def _cluster(vectors: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Spherical k-means, started from the farthest texts, so that it does not depend on chance."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.array(centres).T, axis=1)
        centres.append(vectors[int(np.argmin(nearest))])
    centres = np.array(centres)
    for _ in range(iterations):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([vectors[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def fit(train: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, iterations: int = ITERATIONS) -> Model:
    """Fit on ``train`` (doc_id, text, lang)."""
    train = train.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    texts, frequency = _frequencies(train)
    idf = (np.log((1 + texts) / (1 + frequency)) + 1).astype(np.float32)
    per_lang = train.groupBy("lang").agg(F.count("*").alias("n"))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # One and a quarter times the share that is wanted, of which each language's task keeps the first ``sample``.
    picked = train.join(F.broadcast(per_lang), "lang").filter(spread < F.lit(1.25 * sample) / F.col("n")).select(
        "lang", spread.alias("at"), "text")

    def cluster(key, group: pd.DataFrame) -> pd.DataFrame:
        rows, sizes = [], []
        for text in group.sort_values(["at", "text"])["text"].head(sample):
            counts = gram_counts(text)
            if counts is not None:
                at, values = vector(counts, idf)
                row = np.zeros(DIMS, np.float32)
                row[at] = values
                rows.append(row)
                sizes.append(_size_class(counts.sum()))
        if not rows:
            return pd.DataFrame({"lang": [], "centroids": [], "width": [], "classes": [], "cosines": []})
        vectors = np.array(rows)
        centres = _cluster(vectors, k, iterations)
        return pd.DataFrame({"lang": [key[0]], "centroids": [centres.astype("<f4").tobytes()], "width": [len(centres)],
                             "classes": [sizes], "cosines": [np.max(vectors @ centres.T, axis=1).astype(float).tolist()]})

    found = sorted(picked.groupBy("lang").applyInPandas(
        cluster, "lang string, centroids binary, width int, classes array<int>, cosines array<double>").collect(),
        key=lambda r: r.lang)
    languages = [r.lang for r in found for _ in range(r.width)]
    centroids = np.concatenate([np.frombuffer(r.centroids, "<f4").reshape(r.width, DIMS) for r in found]) if found else np.zeros(
        (0, DIMS), np.float32)
    classes = np.array([c for r in found for c in r.classes], int)
    cosines = np.array([c for r in found for c in r.cosines], float)
    floors = np.zeros(65)
    for size in range(65):  # a length class with few texts takes the floor of the next shorter one
        own = cosines[classes == size]
        floors[size] = SLACK * np.quantile(own, 0.01) if len(own) >= 20 else floors[size - 1] if size else 0.0
    return Model(idf, languages, centroids, floors)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.idf, model.languages, np.ascontiguousarray(model.centroids.T), model.floors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, languages, columns, floors = shared.value
        for batch in batches:
            out = []
            for value in batch["_text"]:
                counts = gram_counts(value)
                if counts is None or not languages:  # without any labelled language nothing but the absence of letters can be told
                    out.append((UNKNOWN, 0.0, counts is None))
                    continue
                at, values = vector(counts, idf)
                cosine = values.astype(np.float32) @ columns[at]
                best = int(np.argmax(cosine))
                score = float(min(max(cosine[best], 0.0), 1.0))
                out.append((languages[best], score, score < floors[_size_class(counts.sum())]))
            batch = batch.drop(columns="_text")
            batch["lang_pred"], batch["score"], batch["rejected"] = zip(*out) if out else ([], [], [])
            yield batch

    return source.mapInPandas(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with all their columns."""
    key = row_key("doc_id", "text")
    judged = predict(docs.select(key.alias("key"), "text"), model, keep=("key",))
    out = staged(judged.filter("rejected").select("key").distinct(), "rejected")
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(out, "key", "left_anti").select("row.*")


def labelled(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~F.coalesce(held_out, F.lit(False)) & F.col("lang").isNotNull())
