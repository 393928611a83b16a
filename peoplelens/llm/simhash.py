"""SimHash near-duplicates found by pigeonhole blocks.

Fingerprints are 64 majority bits of the hashes of word shingles. Two fingerprints that differ in at most two bits agree on at
least two of four 16-bit blocks, so all such pairs meet under one of six keys of 32 fixed bits. Under each key the fingerprints are
compared bit by bit and the links of a key's group are returned as stars, not as all pairs.

A key may hold many different fingerprints. Keys with more than ``bucket`` of them are split by the same rule: the bits that
are still free are cut into four blocks and two of them fixed. After the third time at most eight bits are free, so no
group can exceed 256 fingerprints, however many documents there are. Nothing is capped or dropped.

Equal fingerprints are one node, so copies are counted on each task before the shuffle and never paired.

Defined cases: NULL and empty texts have fingerprint zero and are linked with each other. A text with fewer words than a shingle
is one shingle. NULL ids keep their fingerprint and component, and are not a component's name unless nothing else is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import staged
from peoplelens.llm.components import components

WORDS = 3
SEED = 42
#: The four blocks and the pairs of them that a level fixes are laid out for this distance.
DISTANCE = 2
BUCKET = 512


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of XXH64 over the shingles of one whole text, as an unsigned integer."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        return hashed(b" ".join(parts), seed)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    values = np.fromiter([hashed(line[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())],
                         np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 16):  # bounds the unpacked bits of a very long text
        part = values[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(values)).tolist()))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words: int = WORDS,
                 seed: int = SEED) -> DataFrame:
    """The kept columns and ``fp`` (the fingerprint's bits as a long)."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))],
                                             names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, schema)


def _free_after(free: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The bits left free by each of the six ways of fixing two of four blocks of ``free``."""
    step = len(free) // 4
    blocks = [free[i * step:(i + 1) * step] for i in range(4)]
    return [tuple(b for k in range(4) if k not in pair for b in blocks[k]) for pair in combinations(range(4), 2)]


def levels() -> list[list[tuple[int, ...]]]:
    """Free bits of every mask at 32, 16 and 8 free bits; mask ``m`` of one level has children ``6 m .. 6 m + 5``."""
    out, current = [], [tuple(range(64))]
    for _ in range(3):
        current = [f for free in current for f in _free_after(free)]
        out.append(current)
    return out


def _signed(bits: tuple[int, ...]) -> int:
    value = ((1 << 64) - 1) ^ sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _keyed(df: DataFrame, parents: Column | None, level: list[tuple[int, ...]]) -> DataFrame:
    """A row per fingerprint and mask: (fp, mask, key) with the fixed bits as ``key``."""
    keep = F.array(*[F.lit(_signed(free)) for free in level])
    masks = F.sequence(F.lit(0), F.lit(5)) if parents is None else F.sequence(parents * 6, parents * 6 + 5)
    return df.select("fp", F.explode(masks).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.get(keep, F.col("mask"))))


def _close(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, root) of the groups that links within one bucket form; at most one row per member."""
    values = fps.astype(np.int64).view(np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    out, left = [], np.ones(len(values), bool)
    for start in range(len(values)):
        if not left[start]:
            continue
        group = near[start].copy()
        while True:
            wider = near[group].any(axis=0)
            if (wider == group).all():
                break
            group = wider
        left &= ~group
        out += [(int(fps[i]), int(fps[start])) for i in np.flatnonzero(group) if i != start]
    return out


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): stars that join all of ``nodes.fp`` (distinct) within ``distance`` bits of each other."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("two of four blocks agree only up to a distance of two bits")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for fps in batch.column(0) for pair in _close(fps.values.to_numpy(), distance)]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found, parents, current = None, None, nodes.select("fp")
    for depth, level in enumerate(levels()):
        keyed = _keyed(current, parents, level)
        if depth < 2:
            full = staged(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
                          .select("mask", "key"), "full")
            small = keyed.join(full, ["mask", "key"], "left_anti")
        else:
            full, small = None, keyed
        groups = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        part = groups.select("fps").mapInArrow(verify, "a long, b long")
        found = part if found is None else found.unionAll(part)
        if full is None or full.isEmpty():
            break
        current = staged(keyed.join(full, ["mask", "key"], "left_semi").select("fp", F.col("mask").alias("parent")), "split")
        parents = F.col("parent")
    return found


def near_duplicates(marked: DataFrame, doc_id: str = "doc_id", distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(fp, component) for each distinct ``fp`` of ``marked``: the smallest id reachable over linked fingerprints."""
    nodes = staged(marked.groupBy("fp").agg(F.min(doc_id).alias("least")), "nodes")
    joined = staged(components(links(nodes, distance, bucket)), "components")
    grouped = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least")
    names = grouped.groupBy("root").agg(F.min("least").alias("component"))
    return grouped.join(names, "root").select("fp", "component")
