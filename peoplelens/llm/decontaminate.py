"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Tokens are lower-case runs of letters and digits, compared by their 64-bit hashes. A seed is the hash of the tokens that a fixed mask
selects in a window; the positions the mask leaves out may differ. Seeds of the benchmark are joined with those of every training window.
Each hit names a diagonal, on which the two token sequences are compared once. A diagonal is an overlap if some stretch of ``stretch``
aligned tokens (of the whole item, if that is shorter) has at least ``share`` equal tokens.

No overlap is lost: the masks of an item's length class (FAMILIES) hit every stretch that the comparison accepts, wherever its edits
are. ``check_families`` proves that by enumeration for the parameters given, and refuses masks that leave a gap.

The seeds of the benchmark are broadcast in rounds of at most about ``round_seeds`` (50 bytes each), one pass over the corpus for each round,
so that no size of benchmark or of one item is refused or sampled. Windows are expanded inside one code-generated stage and meet the seeds
there; they are never written or shuffled. Of a run of hits on one diagonal only the first goes on.

Defined cases: NULL and empty texts have no windows. Items of up to four tokens match word for word, longer ones with the share
of edits; items without tokens match nothing. Items with equal tokens are one class: the smallest item_id stands for it and ``items``
counts it. Rows of one doc_id (of none, too) are judged together, by their best overlap.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import row_key, staged

#: Masks by the smallest number of tokens of the items they are for. Ones are compared, zeros ignored.
FAMILIES = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("1111", "11011", "10111", "11101"),
    10: ("111011", "11010011", "11111"),
    15: ("1111011", "11001000111", "11010110001"),
}
STRETCH = 15
SHARE = 0.8
ROUND_SEEDS = 500_000
#: Items of fewer tokens are ordinary words, which condemn no document.
LEAST_TOKENS = 5


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hits_every(masks: tuple[str, ...], width: int, edits: int) -> bool:
    """Whether, wherever the edits are in ``width`` tokens, some mask fits between them."""
    placed = [{at + i for i, bit in enumerate(m) if bit == "1"} for m in masks for at in range(width - len(m) + 1)]
    return all(any(p.isdisjoint(e) for p in placed) for e in combinations(range(width), edits))


def check_families(families: dict[int, tuple[str, ...]], stretch: int, share: float) -> None:
    for width in range(1, stretch + 1):
        least = max((n for n in families if n <= width), default=None)
        if least is None or not hits_every(families[least], width, width - math.ceil(width * share)):
            raise ValueError(f"the masks miss overlaps of {width} tokens")


def _seed(words: str, at: Column, mask: str) -> Column:
    """NULL where the window does not lie inside the text."""
    inside = (at >= 0) & (at + len(mask) <= F.size(words))
    return F.when(inside, F.xxhash64(F.lit(mask), *[F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]))


def _starts(df: DataFrame, words: str, position: str, span: int) -> DataFrame:
    """One row per window start.

    A text without windows gives one row of NULLs, which joins nothing. A filter here, or one that Spark infers from a plain
    explode, would be pushed below the tokens and split every text twice.
    """
    return df.withColumn(position, F.explode_outer(F.when(
        F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span))))


def _benchmark_seeds(items: DataFrame, families: dict[int, tuple[str, ...]]) -> DataFrame:
    """(seed, mask, before, item_id, item_pos, item_size); ``before`` is the seed of the same mask one token earlier."""
    size, at = F.size("item_words"), F.col("item_pos")
    classes = sorted(families, reverse=True)
    of_class = F.coalesce(*[F.when(size >= least, F.array(*[
        F.struct(F.lit(m).alias("mask"), _seed("item_words", at, m).alias("seed"), _seed("item_words", at - 1, m).alias("before"))
        for m in families[least]])) for least in classes])
    found = _starts(items, "item_words", "item_pos", 1).withColumn("x", F.explode(of_class))
    return found.filter("x.seed IS NOT NULL").select("x.*", "item_id", "item_pos", size.alias("item_size"))


def _diagonals(texts: DataFrame, seeds: DataFrame, masks: list[str], rounds: int, stretch: int) -> DataFrame:
    """(key, item_id, doc_start, item_start) of the diagonals that hold a seed, each once.

    ``doc_start`` is the document token on which the item's first aligned token falls.
    """
    at = F.col("pos")
    windows = _starts(texts, "words", "pos", min(map(len, masks))).withColumn(
        "seed", F.explode(F.array(*[_seed("words", at, m) for m in masks])))
    before = F.coalesce(*[F.when(F.col("mask") == m, _seed("words", at - 1, m)) for m in masks])
    share = F.pmod(F.xxhash64("seed", "item_id", "item_pos"), F.lit(rounds))
    hits = reduce(DataFrame.unionAll, [windows.join(F.broadcast(seeds.filter(share == r)), "seed") for r in range(rounds)])
    lead = F.least("pos", "item_pos")
    first = hits.filter(F.coalesce(before != F.col("before"), F.lit(True))).select(
        "key", "item_id", (at - lead).alias("doc_start"), (F.col("item_pos") - lead).alias("item_start"),
        F.size("words").alias("size"), "item_size")
    aligned = F.least(F.col("size") - F.col("doc_start"), F.col("item_size") - F.col("item_start"))
    return (first.filter(aligned >= F.least(F.lit(stretch), F.col("item_size")))
            .select("key", "item_id", "doc_start", "item_start").distinct())


def overlaps(docs: DataFrame, benchmark: DataFrame, families: dict[int, tuple[str, ...]] = FAMILIES, stretch: int = STRETCH,
             share: float = SHARE, round_seeds: int = ROUND_SEEDS) -> DataFrame:
    """(doc_id, item_id, items, doc_start, item_start, aligned, equal) of the best overlap of each document and item.

    ``aligned`` is the number of tokens that the two share on the diagonal and ``equal`` how many of them are the same.
    """
    check_families(families, stretch, share)
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("words"))
                   .groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"))
                   .select(F.monotonically_increasing_id().alias("item"), "item_id", "items", _hashes(F.col("words")).alias("item_words")), "items")
    seeds = staged(_benchmark_seeds(items.select(F.col("item").alias("item_id"), "item_words"), families), "seeds")
    # One row for each mask in use, and a count.
    counts = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}
    rounds = max(1, math.ceil(sum(counts.values()) / round_seeds))
    masks = sorted(counts) or ["1"]
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    texts = rows.select("key", _hashes(tokens(F.col("text"))).alias("words"))
    diagonals = staged(_diagonals(texts, seeds, masks, rounds, stretch), "diagonals").withColumnRenamed("item_id", "item")
    # Only the documents that were hit are read into tokens again.
    hit = rows.join(diagonals, "key").select("doc_id", "item", "doc_start", "item_start", _hashes(tokens(F.col("text"))).alias("words"))
    both = hit.join(items, "item")
    aligned = F.least(F.size("words") - F.col("doc_start"), F.size("item_words") - F.col("item_start"))
    parts = both.select("doc_id", "item", "item_id", "items", "doc_start", "item_start", aligned.alias("aligned"),
                        F.least(F.lit(stretch), F.size("item_words")).alias("width"),
                        F.slice("words", F.col("doc_start") + 1, aligned).alias("doc_part"),
                        F.slice("item_words", F.col("item_start") + 1, aligned).alias("item_part"))
    # Explode computes the comparison once for its two uses.
    compared = parts.withColumn("same", F.explode(F.array(F.zip_with(
        "doc_part", "item_part", lambda a, b: F.when(a == b, 1).otherwise(0)))))
    enough = F.exists(F.sequence(F.lit(1), F.col("aligned") - F.col("width") + 1),
                      lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda a, x: a + x)
                      >= F.ceil(F.col("width") * F.lit(share)))
    verified = compared.filter(enough).withColumn("equal", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    best = F.max_by(F.struct("doc_start", "item_start", "aligned", "equal"),
                    F.struct("equal", -F.col("doc_start"), -F.col("item_start")))
    return (verified.groupBy("doc_id", "item", "item_id").agg(F.max("items").alias("items"), best.alias("best"))
            .select("doc_id", "item_id", "items", "best.*"))


def clean(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS, **options) -> DataFrame:
    """Rows of ``docs`` that overlap no benchmark item of at least ``least_tokens`` tokens. Rows are told apart by 128 bits of doc_id and
    text, so a NULL or repeated doc_id is judged by its own text."""
    key = row_key("doc_id", "text")
    long_enough = benchmark.filter(F.size(tokens(F.col("text"))) >= least_tokens)
    found = overlaps(docs.select(key.alias("doc_id"), "text"), long_enough, **options)
    bad = staged(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(bad, "key", "left_anti").select("row.*")
