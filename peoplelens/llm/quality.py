"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of ``STATISTICS``. Trees are grown level by level on binned statistics: for each node and bin the
gradients and curvatures of the log loss are summed, and the split with the largest gain is taken. A fitted forest is
three arrays (statistic, threshold, leaf value; complete binary trees), and all documents of a batch walk down all trees at once
by indexing those arrays.

Bound: the forest is fitted on about ``SAMPLE`` labelled rows (all, if there are fewer), those whose hash of doc_id and statistics lies below the
share that gives this number. Rows that are equal in both and in the label count once, so repeated rows cannot fill the sample. Their statistics, not their texts, come to the driver. All documents are scored.

Defined cases: a NULL text has the statistics of the empty text. Rows without a label or without an id are scored, not learned from. If a doc_id
is repeated with different labels, all of them are learned from. Without labels the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

SAMPLE = 20_000
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
SMOOTH = 1.0
LEAST_WEIGHT = 5.0

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "log_longest_word", "upper", "digits", "spaces", "line_ends", "points", "bars", "other_symbols",
    "high_bytes", "byte_entropy", "distinct_words", "same_as_before", "top_word", "short_words", "capital_words", "shouted_words", "ends_in_symbol",
    "mean_line", "distinct_lines", "lines_with_end")


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; shares are 0 where there is nothing to count."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    from collections import Counter

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256).astype(float)
    n = len(raw)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum()
    points = counts[[33, 44, 46, 58, 59, 63]].sum()
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    share = counts[counts > 0] / n
    out[:13] = (np.log1p(n), np.log1p(len(words)), 0, 0, counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / n,
                counts[32] / n, counts[10] / n, points / n, counts[124] / n, (symbols - points - counts[124]) / n,
                counts[128:].sum() / n, -(share * np.log2(share)).sum())
    if words:
        w = len(words)
        lengths = np.fromiter(map(len, words), np.int64, w)
        ends = Counter([x[-1] for x in words])
        starts = Counter([x[0] for x in words])
        seen = Counter(words)
        out[2], out[3] = lengths.mean(), np.log1p(lengths.max())
        out[13:20] = (len(seen) / w, sum(a == b for a, b in zip(words, words[1:])) / w, seen.most_common(1)[0][1] / w,
                      (lengths <= 3).mean(), sum(k for c, k in starts.items() if c.isupper()) / w,
                      sum(k for x, k in seen.items() if len(x) > 1 and x.isupper()) / w,
                      sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,") / w)
    if lines:
        out[20:] = (np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines))
    return out


def statistics_table(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and ``stats``: one pass over all texts."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("stats", ArrayType(FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = [statistics(t).astype(np.float32) for t in batch["_text"]]
            batch = batch.drop(columns="_text")
            batch["stats"] = stats
            yield batch

    return source.mapInPandas(run, schema)


@dataclass
class Forest:
    """Tree t's node i has the children 2 i + 1 and 2 i + 2; a row goes right where its statistic exceeds the threshold."""

    start: float
    statistic: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.statistic.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(inner + 1).bit_length() - 1):
            right = x[row, self.statistic[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        total = self.start + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not len(y):
        return Forest(0.0, np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of_one / (1 - rate_of_one)))
    total = np.full(len(y), start)
    statistic = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            node = at - first
            best_gain, best = np.full(width, 1e-6), {}
            g_all = np.bincount(node, grad, width)
            h_all = np.bincount(node, curve, width)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                cell = node * bins + binned[f]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins).cumsum(axis=1)[:, :len(edges[f])]
                h = np.bincount(cell, curve, width * bins).reshape(width, bins).cumsum(axis=1)[:, :len(edges[f])]
                g_right, h_right = g_all[:, None] - g, h_all[:, None] - h
                gain = g * g / (h + SMOOTH) + g_right * g_right / (h_right + SMOOTH) - (g_all * g_all / (h_all + SMOOTH))[:, None]
                gain[(h < LEAST_WEIGHT / 4) | (h_right < LEAST_WEIGHT / 4)] = 0
                cut = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(width), cut] > best_gain):
                    best_gain[n], best[n] = gain[n, cut[n]], (f, int(cut[n]))
            right = np.zeros(len(y), np.int64)
            for n, (f, cut) in best.items():
                statistic[t, first + n], threshold[t, first + n] = f, edges[f][cut]
                own = node == n
                right[own] = binned[f][own] > cut
            at = 2 * at + 1 + right
        end = at - inner
        leaf[t] = rate * np.bincount(end, grad, leaves) / (np.bincount(end, curve, leaves) + SMOOTH)
        total += leaf[t][end]
    return Forest(start, statistic, threshold, leaf)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Forest:
    """Fit on the labelled rows of ``stats`` (doc_id, stats); ``labels`` has doc_id and quality."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = stats.select("doc_id", "stats").join(known, "doc_id")
    # A share by hash, not an ordered limit, of which every task would send as many rows as the whole sample. Equal rows have one hash: they are
    # counted once in the share and folded before they leave a task, so that no repeated row fills the sample or the driver.
    at = F.pmod(F.xxhash64("doc_id", "stats"), F.lit(1 << 40))
    different = rows.agg(F.approx_count_distinct(at, 0.02)).first()[0]
    share = sample / max(different, sample)
    rows = (rows.select((at / F.lit(float(1 << 40))).alias("at"), "stats", "y").filter(F.col("at") < share)
            .dropDuplicates(["at", "stats", "y"]).toPandas())
    rows = rows.iloc[np.lexsort((rows["y"], rows["stats"].map(tuple), rows["at"]))] if len(rows) else rows
    x = np.array(rows["stats"].tolist(), np.float32).reshape(-1, len(STATISTICS))
    return fit_forest(x, rows["y"].to_numpy(float), **options)


def score(stats: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score``: the probability of label 1."""
    source = stats.select(*keep, "stats")
    schema = source.drop("stats").schema.add("score", "double")
    shared = stats.sparkSession.sparkContext.broadcast((forest.start, forest.statistic, forest.threshold, forest.leaf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["stats"].tolist(), np.float32).reshape(-1, len(STATISTICS))
            batch = batch.drop(columns="stats")
            batch["score"] = Forest(*shared.value).score(x)
            yield batch

    return source.mapInPandas(run, schema)
