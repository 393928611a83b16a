"""Best-fit packing of token sequences into bins of several permitted lengths.

Items are taken by falling length. An item goes to the open bin with the least space left that still holds it. If none
does, a bin is opened, of the permitted length whose cost per packed token is least when it is filled greedily
with what remains. At the end each bin is cut down to the smallest permitted length that holds its contents.

Sequences longer than the largest length are cut into pieces of that length and a rest. Items are dealt by a hash of their
id into shards of about ``shard_items`` and each shard is packed by one task, so a task's memory is bounded and only ids and
lengths are shuffled. Shard borders leave at most a few open bins per shard part-filled.

Defined cases: NULL or non-positive lengths and NULL texts give one row with no bin (bin_id NULL, length 0). Equal lengths are
taken by id, then by piece. Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens' worth of fixed cost for every sequence, whatever its length.
OVERHEAD = 16
SHARD_ITEMS = 100_000

ROWS = ("doc_id long, piece int, start long, length int, bin_id long, bin_offset int, bin_capacity int, opened_capacity int, "
        "bin_used int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES,
                 overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each item (lengths must fall), and opened and final capacity of each bin."""
    largest = capacities[-1]
    counts = [0] * (largest + 1)
    for n in lengths:
        counts[n] += 1
    waiting = 0  # bit n: items of length n are left
    for n, c in enumerate(counts):
        if c:
            waiting |= 1 << n
    spare: list[list[int]] = [[] for _ in range(largest + 1)]  # open bins by space left
    open_spaces = 0  # bit n: a bin with n left
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = [], []

    def greedy_fill(room: int, below: int) -> int:
        """Tokens that go into ``room`` when it is filled with the longest waiting items that fit."""
        filled = 0
        while room > 0:
            bound = min(room, below)
            n = (waiting & ((1 << (bound + 1)) - 1)).bit_length() - 1
            if n <= 0:
                break
            k = min(counts[n], room // n)
            filled, room, below = filled + k * n, room - k * n, n - 1
        return filled

    def shrink(n: int) -> int:
        return capacities[bisect_left(capacities, n)]

    for n in lengths:
        counts[n] -= 1
        if not counts[n]:
            waiting &= ~(1 << n)
        fits = open_spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = spare[space].pop()
            if not spare[space]:
                open_spaces &= ~(1 << space)
        else:
            best = None
            for capacity in capacities[bisect_left(capacities, n):]:
                filled = n + greedy_fill(capacity - n, n)
                cost = (shrink(filled) + overhead) / filled
                if best is None or cost < best[0]:
                    best = cost, capacity
            b, space = len(used), best[1]
            used.append(0)
            opened.append(best[1])
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if space > n:
            spare[space - n].append(b)
            open_spaces |= 1 << (space - n)
    return bins, offsets, opened, [shrink(n) for n in used]


def pack(docs: DataFrame, length: Column, doc_id: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES,
         overhead: int = OVERHEAD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per item (see ROWS): its place in the document, its bin, and the bin's capacity before and after."""
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    pieces = F.greatest(F.ceil(F.col("tokens") / largest), F.lit(1)).cast("int")
    items = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"),
        F.least(F.col("tokens") - F.col("piece").cast("long") * largest, F.lit(largest)).cast("int").alias("length"))
    # The number of the row is kept with it: it deals rows without an id, or of one id, over all shards, and stays the same when a task is run again.
    items = staged(items.withColumn("row", F.monotonically_increasing_id()), "items")
    shards = max(1, -(-items.count() // shard_items))
    seed = F.xxhash64("doc_id", "piece", "row")

    def pack_shard(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, opened, final = pack_lengths(group["length"].tolist(), capacities, overhead)
        used = group["length"].groupby(bins).sum()
        return pd.DataFrame({
            "doc_id": group["doc_id"].values, "piece": group["piece"].values, "start": group["start"].values,
            "length": group["length"].values, "bin_id": [(int(key[0]) << 32) + b for b in bins], "bin_offset": offsets,
            "bin_capacity": [final[b] for b in bins], "opened_capacity": [opened[b] for b in bins],
            "bin_used": [int(used[b]) for b in bins]})

    packed = (items.filter("length > 0").withColumn("shard", F.pmod(seed, F.lit(shards))).drop("row")
              .groupBy("shard").applyInPandas(pack_shard, ROWS))
    nothing = items.filter("length <= 0").select(
        "doc_id", "piece", "start", "length", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("bin_id", "long"), ("bin_offset", "int"), ("bin_capacity", "int"), ("opened_capacity", "int"), ("bin_used", "int"))])
    return packed.unionByName(nothing)
