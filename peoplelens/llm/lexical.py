"""Ranked lexical search: the best documents of every item, by groups of documents that match the same terms.

One pass over the texts keeps, for each document, its length and how often it holds each term of the items; document frequencies, the
number of documents and their total length are sums over all of it. A second pass takes these short rows in blocks. For each
item, a bitmap over the block's documents says which of them hold each of its terms; read across the terms, the bits of one document are
its presence mask. Documents with equal masks are a group. The sum of the best contribution of each present term bounds every score
in a group, groups are scored by falling bound, and an item is done with a block once no bound reaches the k-th best score that
the task has seen for it. Tasks return k documents for each item at most, which are ranked once more.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z is lower-cased. A term weighs
floor(1000 ln((2N + 2) / (2 df + 1))); a document that holds it tf times adds weight * (10^9 tf div (1000 tf + 12 m)), with
m = 75 + 25 n N div L for its n terms. All but the logarithm is done in whole numbers.

Items are broadcast in rounds of about ``round_terms`` terms, with both passes for each round, so no number of items is refused; the blocks shrink as
the vocabulary of a round grows.

Defined cases: NULL texts and texts without a term are no documents and no items. Rows with equal item_id and text are one item; different
texts under one item_id are ranked apart. Repeated documents are documents of their own, equal scores go by ascending doc_id
with NULL last. Scores of zero are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

K = 20
ROUND_TERMS = 200_000
#: Cells (vocabulary x documents) of a block, and the most documents in one.
CELLS = 1 << 22
BLOCK = 4096
#: Documents scored at a time.
STEP = 64
#: Found terms that are counted at a time.
COUNTED = 1 << 19

KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
FOLD = bytes(b if b in KEPT else 0x20 for b in range(256)).translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms, repeats) of each different item that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [sorted(Counter(terms(t.as_py())).items()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[t for t, _ in c] for c in counted], pa.list_(pa.binary())),
                pa.array([[n for _, n in c] for c in counted], pa.list_(pa.int64()))], names=["item_id", "terms", "repeats"])

    source = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    return source.mapInArrow(run, "item_id long, terms array<binary>, repeats array<long>").filter(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids, tfs): number of terms of each whole text, and how often it holds each term of the vocabulary, as positions in it."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                start, lengths, found, rows = at, [], [], []
                while at < batch.num_rows and len(found) < COUNTED:
                    own = terms(batch.column(1)[at].as_py() or b"")
                    lengths.append(len(own))
                    before = len(found)
                    found += [v for v in map(get, own) if v is not None]
                    rows.append(len(found) - before)
                    at += 1
                row = np.repeat(np.arange(len(rows)), rows)
                keys, tfs = np.unique(row * size + np.array(found, np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(rows) + 1) * size), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(rows)), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32)))], names=["doc_id", "n", "ids", "tfs"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def group_masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(masks, group): the different columns of ``present`` (terms x documents) as rows, and the mask each document has."""
    bits = np.packbits(present, axis=0)
    packed = np.zeros((present.shape[1], -(-len(bits) // 8) * 8), np.uint8)
    packed[:, :len(bits)] = bits.T
    words = packed.view(np.uint64) if packed.shape[1] == 8 else packed.view(np.dtype((np.void, packed.shape[1])))
    _, first, group = np.unique(words.ravel(), return_index=True, return_inverse=True)
    return present[:, first].T, group


def best_of_block(weights: np.ndarray, gains: np.ndarray, present: np.ndarray, ids: tuple[np.ndarray, np.ndarray], best: tuple[np.ndarray, ...],
                  k: int) -> tuple[np.ndarray, ...]:
    """The best k of ``best`` and the block, as (scores, nulls, ids). ``gains`` and ``present``: terms x documents."""
    most = gains.max(axis=1).astype(np.int64) * weights
    worst = lambda: best[0][-1] if len(best[0]) == k else 1
    if most.sum() < worst():
        return best
    masks, group = group_masks(present)
    bounds = masks @ most
    order = np.argsort(-bounds, kind="stable")
    members = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(masks)))
    at = 0
    while at < len(order) and bounds[order[at]] >= worst():
        taken, n = [], 0
        while at < len(order) and n < STEP and bounds[order[at]] >= worst():
            g = order[at]
            taken.append(members[ends[g - 1] if g else 0:ends[g]])
            n += len(taken[-1])
            at += 1
        docs = np.concatenate(taken)
        scores = weights @ gains[:, docs].astype(np.int64)
        good = scores >= worst()
        merged = [np.concatenate(x) for x in zip(best, (scores[good], ids[0][docs[good]], ids[1][docs[good]]))]
        first = np.lexsort((merged[2], merged[1], -merged[0]))[:k]
        best = tuple(x[first] for x in merged)
    return best


def _ranked(posted: DataFrame, chosen: list[tuple[np.ndarray, np.ndarray]], total: int, length: int, size: int, k: int) -> DataFrame:
    """(item, doc_id, score): at most k documents of each item from each task."""
    shared = posted.sparkSession.sparkContext.broadcast(chosen)
    rows = int(min(BLOCK, max(64, CELLS // max(size, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                nulls = np.array(part.column(0).is_null())
                ids = part.column(0).fill_null(0).to_numpy().astype(np.int64)
                m = 100 - 25 + 25 * part.column(1).to_numpy().astype(np.int64) * total // length
                doc = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                gains, present = np.zeros((size, part.num_rows), np.int32), np.zeros((size, part.num_rows), bool)
                gains[term, doc] = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                present[term, doc] = True
                for i, (own, weights) in enumerate(shared.value):
                    best[i] = best_of_block(weights, gains[own], present[own], (nulls, ids), best[i], k)
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        scores, nulls, ids = (np.concatenate(x) for x in zip(none, *best))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, mask=nulls), pa.array(scores)], names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, round_terms: int = ROUND_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above zero."""
    spark = docs.sparkSession
    asked = staged(item_terms(items), "items")
    rounds = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / round_terms))
    out = []
    for r in range(rounds):
        chosen = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(rounds)) == r).collect()  # a share of about ``round_terms`` terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for row in chosen for t in row.terms}))}
        posted = staged(postings(docs, vocabulary), "postings")
        total, length = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {row.id: row.df for row in posted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()}
        weigh = {i: math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for i, df in holding.items()}
        known = []
        for row in chosen:
            own = [(vocabulary[bytes(t)], n) for t, n in zip(row.terms, row.repeats) if vocabulary[bytes(t)] in weigh]
            known.append((np.array([t for t, _ in own], np.int64), np.array([weigh[t] * n for t, n in own], np.int64)))
        some = [i for i, (own, _) in enumerate(known) if len(own)]
        ranked = _ranked(posted.filter(F.size("ids") > 0), [known[i] for i in some], total, max(length, 1), len(vocabulary), k)
        names = spark.createDataFrame([(at, chosen[i].item_id) for at, i in enumerate(some)], "item long, item_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, out)
