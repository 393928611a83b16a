"""One text of each near-duplicate group, by the exact Jaccard similarity of word shingles.

A text is the set of the 64-bit hashes of its shingles of ``WORDS`` words; equal sets are one node. Two sets x and y are linked if
|x & y| / |x | y| >= 0.8, which is 9 |x & y| >= 4 (|x| + |y|). No such link is lost:

* A linked pair shares one of the first |x| // 5 + 1 shingles of both, in any one order of all shingles. The order is by hash, with shingles
  that many texts start with moved to the end, so that passages on many pages make few candidates.
* A linked pair differs in at most (|x| + |y|) / 9 shingles. A parity bit over the shingles of each of at least ``BITS`` classes differs at
  most that often, so pairs with more different bits are none.

Candidates never are all pairs of a group. They come in three steps, and each leaves out what the steps before have joined:

* SimHash (``simhash``): the fingerprints of the texts that links of two bits join are one bucket, and each of its nodes is paired with the first.
* Two bits reach almost equal texts only, so the prefixes give the rest. Their rows (shingle, node) are range-sorted once, and every node is
  paired with the first node of its shingle: a cluster of near copies becomes one component by as many pairs as it has members. Shingles that
  still join several components go on, as blocks of ``bucket`` nodes against each other: each pair of blocks yields a spanning forest of the pairs
  that sizes and parities allow. Every candidate is confirmed on the two whole sets.
* Where a confirmed forest is complete the groups are. A refused pair may hide others, which all lie among what the forests of all shingles join
  to it. Those nodes meet once, with their whole sets, in blocks, and each pair of blocks yields a spanning forest of its true links.

Texts stay where they are: they are read once to see which shingles are frequent, once for the nodes, and again for the sets of each step's candidates, where a bitmap of
a fixed greatest size over the wanted texts keeps the others out of the join. Nothing is capped or dropped.

Defined cases: NULL and empty texts are the empty set, one node without links. A text with fewer words than a shingle is one shingle. Of each
group the row with the smallest doc_id stays (NULL last), among those of one doc_id the one with the smallest hash, and of wholly equal rows one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from peoplelens.llm import simhash
from peoplelens.llm.common import staged
from peoplelens.llm.components import components

WORDS = 5
SEED = 42
BITS = 512
MOST_BITS = 1 << 14
BUCKET = 1024
#: Shingles of a block of whole sets, about 2 MB.
BLOCK = 1 << 18
#: A shingle that more texts (and more than this share of all prefix rows) start with is moved to the end of the order.
OFTEN = 256
OFTEN_SHARE = 1 / 50_000
#: Bits of the bitmap over wanted texts: eight for each, up to 16 MB in all.
MOST_MARKS = 1 << 27


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted different XXH64 values, as signed whole numbers, of the shingles of one whole text."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.int64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    words = min(words, len(parts))
    starts = np.concatenate(([0], ends[:-words])).tolist()
    values = [hashed(line[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]
    return np.unique(np.array(values, np.uint64).view(np.int64))


def node_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.astype("<i8").tobytes(), SEED)).view(np.int64))


def parities(s: np.ndarray) -> bytes:
    """One bit per class of shingles; at least as many classes (a power of two) as shingles, up to ``MOST_BITS``."""
    width = min(max(BITS, 1 << (len(s) - 1).bit_length()), MOST_BITS)
    return np.packbits((np.bincount(s & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def prefix(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first |s| // 5 + 1 shingles in the order by hash, those in ``late`` (sorted) after all others."""
    n = len(s) // 5 + 1 if len(s) else 0
    if not len(late) or not n:
        return s[:n]
    frequent = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
    return s[:n] if not frequent[:n].any() else np.concatenate((s[~frequent], s[frequent]))[:n]


def frequent_shingles(docs: DataFrame, often: int = OFTEN) -> np.ndarray:
    """Shingles that many texts start with, at most 1 / OFTEN_SHARE of them. Counts leave out what occurs once in a batch, so they are low
    by a little; they set the order only, on which no result depends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            starts = [prefix(shingles(t.as_py()), none).copy() for t in batch.column(0)]
            values, counts = np.unique(np.concatenate([none, *starts]), return_counts=True)
            several = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array([None, *values[several].tolist()], pa.int64()),
                                              pa.array([int(counts.sum()), *counts[several].tolist()], pa.int64())], names=["s", "n"])

    counted = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    found = staged(counted.filter(F.col("s").isNull() | (F.col("n") > often)), "frequent")
    total = found.filter("s IS NULL").agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.s for r in found.filter(F.col("s").isNotNull() & (F.col("n") > total * OFTEN_SHARE)).collect()], np.int64))


def node_table(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """(node, size, bits, prefix, least, text_key, fp) of each different set, ``fp`` being the SimHash of the text with that key; ``docs`` has
    ``least``, ``text_key`` and ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(late)
    source = docs.select("least", "text_key", "text")
    schema = StructType(source.schema.fields[:2]).add("node", "long").add("size", "integer").add("bits", "binary").add("prefix", ArrayType(LongType())).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t.as_py()) for t in part.column(2)]
                prints = np.fromiter((simhash.fingerprint(t.as_py()) for t in part.column(2)), np.uint64, part.num_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([parities(s) for s in sets], pa.binary()), pa.array([prefix(s, shared.value) for s in sets], pa.list_(pa.int64())), pa.array(prints)],
                    names=schema.names)

    return source.mapInArrow(run, schema).groupBy("node").agg(
        F.min("least").alias("least"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bits").alias("bits"),
        F.first("prefix").alias("prefix"), F.min(F.struct("text_key", "fp"))["fp"].alias("fp"))


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: each node with the first one whose fingerprint links of at most two bits join to its own."""
    prints = staged(nodes.select("fp").distinct(), "prints")
    joined = staged(components(simhash.links(prints)), "joined").select(F.col("node").alias("fp"), "component")
    placed = nodes.select("node", "fp").join(joined, "fp", "left").select("node", F.coalesce("component", "fp").alias("bucket"))
    heads = placed.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("bucket", "a")
    return placed.join(heads, "bucket").filter("node <> a").select("a", F.col("node").alias("b"))


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """(shingle, head, head_size, node, size) for each prefix shingle with several nodes. ``head`` is the first node of the shingle in the row's
    range partition; a shingle that begins or ends a partition is given even for one node, as another partition may hold more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "head", "head_size", "node", "size"]
        before = None  # the last group: shingle, head, its size, whether its rows are given

        def alone(group):
            return pa.RecordBatch.from_arrays([pa.array([group[i]], t) for i, t in zip((0, 1, 2, 1, 2), (
                pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            s, node, size = (batch.column(i).to_numpy() for i in range(3))
            begins = np.concatenate(([True], s[1:] != s[:-1]))
            group = np.cumsum(begins) - 1
            head, head_size = node[begins][group], size[begins][group]
            given = np.bincount(group)[group] > 1
            if before is None:
                given |= group == 0
            elif before[0] == s[0]:
                if not before[3]:
                    yield alone(before)
                given |= group == 0
                head[group == 0], head_size[group == 0] = before[1], before[2]
            before = (int(s[-1]), int(head[-1]), int(head_size[-1]), bool(given[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x[given]) for x in (s, head, head_size, node, size)], names=names)
        if before and not before[3]:
            yield alone(before)

    rows = nodes.select(F.explode("prefix").alias("shingle"), "node", "size")
    return (rows.repartitionByRange("shingle", "node").sortWithinPartitions("shingle", "node")
            .mapInArrow(run, "shingle long, head long, head_size int, node long, size int"))


def first_pairs(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: each node with the head of its shingle, heads of one shingle with the least, where sizes allow it."""
    heads = shared.filter("node = head").select("shingle", "head", "head_size")
    least = heads.groupBy("shingle").agg(F.min(F.struct("head", "head_size")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    pairs = shared.filter("node <> head").select(F.col("head").alias("a"), F.col("head_size").alias("x"), F.col("node").alias("b"), F.col("size").alias("y"))
    pairs = pairs.unionAll(heads.join(least, "shingle").filter("head <> m.head").select("m.head", "m.head_size", "head", "head_size"))
    return pairs.filter("5 * least(x, y) >= 4 * greatest(x, y)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fold(bits: bytes, width: int) -> np.ndarray:
    v = np.frombuffer(bits, np.uint64)
    while v.nbytes > width:
        v = v[:len(v) // 2] ^ v[len(v) // 2:]
    return v


def allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and parities allow."""
    described = nodes.select("node", "size", "bits")
    both = pairs
    for side, size, bits in (("b", "y", "v"), ("a", "x", "u")):
        both = both.join(described.select(F.col("node").alias(side), F.col("size").alias(size), F.col("bits").alias(bits)), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, u, v in zip(*(batch.column(i) for i in range(2, 6))):
                x, y, u, v = x.as_py(), y.as_py(), u.as_py(), v.as_py()
                width = min(len(u), len(v))
                good.append(9 * int(np.bitwise_count(_fold(u, width) ^ _fold(v, width)).sum()) <= x + y)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y", "u", "v").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text) of the wanted keys, each once. A bitmap keeps most other texts out of the join."""
    spark = docs.sparkSession
    keys = staged(keys, "wanted")
    marks = min(MOST_MARKS, 1 << max(15, (8 * keys.count() - 1).bit_length()))
    place = F.pmod(F.col("text_key.a"), F.lit(marks))
    parts = keys.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bitmap = bytearray(marks // 8)
    for r in parts:
        start = (r.part - 1) * 4096
        bitmap[start:start + 4096] = r.bits[:len(bitmap) - start]
    shared = spark.sparkContext.broadcast(bytes(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            p = batch.column(0).to_numpy()
            yield batch.filter(pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))

    maybe = docs.select(place.alias("p"), "text_key", "text")
    found = maybe.mapInArrow(run, maybe.schema).groupBy("text_key").agg(F.first("text").alias("text"))
    return found.join(keys, "text_key", "left_semi")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, s) of the wanted nodes: the whole set, as bytes."""
    keys = staged(nodes.select("node", "text_key").join(wanted, "node"), "nodes_wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).astype("<i8").tobytes() for t in part.column(1)], pa.binary())],
                                                 names=["node", "s"])

    return staged(texts_of(docs, keys.select("text_key")).join(keys, "text_key").select("node", "text").mapInArrow(sets, "node long, s binary"), "sets")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 0.8 or more."""
    held = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs)
    both = (pairs.join(held.select(F.col("node").alias("b"), F.col("s").alias("v")), "b")
            .join(held.select(F.col("node").alias("a"), F.col("s").alias("u")), "a").select("a", "b", "u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_similar(np.frombuffer(u.as_py(), "<i8"), np.frombuffer(v.as_py(), "<i8")) for u, v in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _close(sizes: np.ndarray, bits: list[bytes], blocks: np.ndarray) -> np.ndarray:
    """Whether sizes and parities allow each pair of a group; of two blocks only pairs across. Sizes of a pair differ by at most a quarter,
    so widths are equal or one is twice the other, which is then folded."""
    widths = np.array([len(x) for x in bits])
    out = np.zeros((len(bits), len(bits)), bool)
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        folded = np.array([_fold(bits[i], width) for i in at])
        differ = np.zeros((len(at), len(at)), np.int64)
        for word in range(folded.shape[1]):
            differ += np.bitwise_count(folded[:, word][:, None] ^ folded[:, word][None, :])
        x, y = sizes[at][:, None], sizes[at][None, :]
        near = (9 * differ <= x + y) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
        own = widths[at] == width  # two sets of twice this width meet at their own
        near &= own[:, None] | own[None, :]
        out[np.ix_(at, at)] |= near
    if blocks.min() != blocks.max():
        out &= blocks[:, None] != blocks[None, :]
    return out


def forest(close: np.ndarray, parts: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of a spanning forest of the groups that ``close`` joins across different ``parts``, and whether there are other such pairs."""
    across = close & (parts[:, None] != parts[None, :])
    total = int(np.triu(across, 1).sum())
    if not total:
        return [], False
    joined = across | (parts[:, None] == parts[None, :])
    left, out = np.ones(len(close), bool), []
    for start in range(len(close)):
        if not left[start]:
            continue
        left[start], waiting = False, [start]
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(joined[at] & left)
            left[new] = False
            waiting += new.tolist()
            other = new[parts[new] != parts[at]]
            out += [(at, int(i)) for i in other[np.unique(parts[other], return_index=True)[1]]]
    return out, total > len(out)


def _paired_blocks(rows: DataFrame) -> DataFrame:
    """Rows with their number of ``blocks`` → (lo, hi, block) for each pair of blocks that a row's own is part of."""
    return (rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")))


def block_pairs(members: DataFrame, nodes: DataFrame, bucket: int) -> DataFrame:
    """(shingle, lo, hi, a, b, more): for each pair of blocks of a shingle, the forest of its open pairs.
    ``members``: (shingle, node, part, n) with the number of nodes of the shingle."""
    rows = _paired_blocks(members.withColumn("blocks", F.ceil(F.col("n") / F.lit(bucket)).cast("int"))).select(
        "shingle", "lo", "hi", "block", "node", "part").join(nodes.select("node", "size", "bits"), "node")
    groups = rows.groupBy("shingle", "lo", "hi").agg(F.collect_list(F.struct("node", "part", "size", "bits", "block")).alias("sets")).filter(
        F.size("sets") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, rows = lists.offsets.to_numpy(), lists.values
            node, part, size, block = (rows.field(f).to_numpy().astype(np.int64) for f in ("node", "part", "size", "block"))
            bits = rows.field("bits")
            for shingle, lo, hi, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), offsets[:-1], offsets[1:]):
                if lo != hi and block[a:b].min() == block[a:b].max() or part[a:b].min() == part[a:b].max():
                    continue  # the other block is empty, or all is joined; pairs within a block meet in its own group
                order = np.argsort(node[a:b], kind="stable")
                own, parts = node[a:b][order], part[a:b][order]
                close = _close(size[a:b][order], bits.slice(a, b - a).take(pa.array(order)).to_pylist(), block[a:b][order])
                pairs, more = forest(close, parts)
                i, j = np.array(pairs, np.int64).reshape(-1, 2).T
                if len(i):
                    k = len(i)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(k, shingle, np.int64)), pa.array(np.full(k, lo, np.int32)), pa.array(np.full(k, hi, np.int32)),
                        pa.array(np.minimum(own[i], own[j])), pa.array(np.maximum(own[i], own[j])), pa.array(np.full(k, more))],
                        names=["shingle", "lo", "hi", "a", "b", "more"])

    return groups.select("shingle", "lo", "hi", "sets").mapInArrow(run, "shingle long, lo int, hi int, a long, b long, more boolean")


def _open(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """(shingle, node, part, n) of the shingles whose nodes lie in several components.

    The only pair of two nodes has been tried with their head. Of the shingles that have the same nodes, told by 128 bits, one stands for all.
    """
    members = shared.select("shingle", "node").join(joined.withColumnRenamed("component", "part"), "node", "left").select(
        "shingle", "node", F.coalesce("part", "node").alias("part"))
    several = members.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("p <> q AND n > 2")
    one = several.groupBy("n", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle", "n")
    return members.join(one, "shingle")


def true_forest(sets: list[np.ndarray], close: np.ndarray, parts: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs that join all ``parts`` which similar pairs among the ``close`` ones join, at most one less than there are parts."""
    _, parts = np.unique(parts, return_inverse=True)
    out = []
    for i in range(len(sets)):
        for j in np.flatnonzero(close[i, i + 1:]) + i + 1:
            if parts[i] != parts[j] and _similar(sets[i], sets[j]):
                out.append((i, int(j)))
                parts[parts == parts[j]] = parts[i]
    return out


def whole_links(rest: DataFrame, nodes: DataFrame, docs: DataFrame, bucket: int) -> DataFrame:
    """(a, b): similar pairs that join all parts which similar pairs of nodes of one ``root`` join. ``rest``: (root, node, part), each node once.

    Blocks hold at most about ``bucket`` nodes and BLOCK shingles, or one longer set.
    """
    held = rest.join(nodes.select("node", "size", "bits"), "node")
    spread = held.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(bucket), F.sum("size") / F.lit(BLOCK))).cast("int").alias("blocks"))
    rows = _paired_blocks(held.join(sets_of(rest.select("node"), nodes, docs), "node").join(spread, "root"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy())
        own, part, size, block = (table[c].to_numpy()[order] for c in ("node", "part", "size", "block"))
        pairs = []
        if part.min() != part.max() and (block.min() != block.max() or table["lo"][0] == table["hi"][0]):
            bits, sets = (table[c].take(pa.array(order)).to_pylist() for c in ("bits", "s"))
            close = _close(size.astype(np.int64), bits, block)
            pairs = true_forest([np.frombuffer(x, "<i8") for x in sets], close, part)
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(own[i]), "b": pa.array(own[j])})

    return rows.select("root", "lo", "hi", "block", "node", "part", "size", "bits", "s").groupBy("root", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _parted(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, whose ``part`` is the component that the found pairs give their node."""
    joined = staged(components(found), "joined").withColumnRenamed("component", "part")
    return members.drop("part").join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))


def links(docs: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): similar pairs of nodes that join all nodes which similar pairs join."""
    found = staged(confirmed(staged(allowed(print_pairs(nodes), nodes), "by_prints"), nodes, docs), "links")
    joined = staged(components(found), "joined")
    shared = staged(shared_prefixes(nodes), "shared")
    first = first_pairs(shared)
    for side in ("a", "b"):
        first = first.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}")), side, "left")
    first = first.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
    found = found.unionAll(staged(confirmed(staged(allowed(first, nodes), "first"), nodes, docs), "links"))
    members = staged(_open(shared, staged(components(found), "joined")), "open")
    trees = staged(block_pairs(members, nodes, bucket), "trees")
    tried = staged(trees.select("a", "b").distinct(), "tried")
    good = staged(confirmed(tried, nodes, docs), "links")
    found = found.unionAll(good)
    refused = staged(trees.filter("more").select("a", "b").distinct().join(good, ["a", "b"], "left_anti"), "refused")
    if refused.isEmpty():
        return found
    # All pairs of a forest's group lie among the nodes that its pairs and the parts before it join.
    placed = members.select("node", "part").distinct()
    around = staged(components(tried.unionAll(placed.select("node", "part"))), "around").withColumnRenamed("component", "root")
    hidden = refused.select(F.col("a").alias("node")).join(around, "node").select("root").distinct()
    rest = _parted(placed.join(around.join(hidden, "root", "left_semi"), "node"), found)
    several = rest.groupBy("root").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("root")
    rest = staged(rest.join(several, "root", "left_semi").select("root", "node", "part"), "rest")
    return found if rest.isEmpty() else found.unionAll(staged(whole_links(rest, nodes, docs, bucket), "links"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, row_key, least, text_key, text); ``least`` orders rows by id, NULL last, then by the hash of the row."""
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    keyed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(
        F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *reversed(plain)).alias("b")).alias("row_key"))
    text_key = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("b"))
    return keyed.select("row", "row_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("least"), text_key.alias("text_key"), "text")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, often: int = OFTEN) -> DataFrame:
    """(node, least, root, chosen) for each different set: its least row, its group, and the least row of the group."""
    source = _keyed(docs, doc_id, text)
    nodes = staged(node_table(source, frequent_shingles(source, often)), "nodes")
    joined = staged(components(links(source, nodes, bucket)), "components").withColumnRenamed("component", "root")
    grouped = nodes.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return grouped.join(grouped.groupBy("root").agg(F.min("least").alias("chosen")), "root").select("node", "least", "root", "chosen")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, often: int = OFTEN) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with its columns as they are. Equal rows are folded before they are shuffled."""
    kept = staged(classes(docs, doc_id, text, bucket, often).select("chosen.row_key").distinct(), "kept")
    rows = _keyed(docs, doc_id, text).groupBy("row_key").agg(F.first("row").alias("row"))
    return rows.join(kept.hint("merge"), "row_key", "left_semi").select("row.*")
