"""Hard negatives by an inverted multi-index: the best different-label rows below each anchor's positives.

Vectors are turned into floor(scale * x) and cut into two halves. A codebook for each half (k-means on at most ``SAMPLE`` rows of each
dimension, chosen by a hash of the id) assigns every row to a cell, a pair of codes. Rows are range-partitioned by cell, so a partition
holds at most about ``GROUP`` rows of neighbouring cells and a crowded cell spreads over several.

No row of cell (i, j) scores more against q than (q1 c_i + |q1| r_i) + (q2 c_j + |q2| r_j), with r the largest distance of the
partition's rows from the centroid of their half. An anchor visits the cells of a partition by falling bound: both halves are sorted by their
term, and a heap yields the next pair of positions (the multi-sequence walk). A window, such as the scores from 30 % to 90 % of a
positive's, is certified once it holds k rows that no cell left can outdo, or once no cell left reaches into it; the walk ends when all windows of
the anchor are certified. Windows start from what the sample yields, which is only a lower bound, so partitions that cannot gain are
not asked. Each partition returns at most k rows for each window, and those are ranked once more: results are exact.

First each anchor's positives (one window without limits, rows of its own label) are found, then the negatives below each of them.
Anchors meet the cells in groups of about ``ANCHORS``, one task for each group and partition.

Defined cases: rows with a NULL id or label, a NULL or empty vector, or any NULL or non-finite component take no part. Vectors are
compared only with those of their own dimension. A whole row that is repeated counts once; rows that share only an id are rows of their own,
but none is a positive of its own id. Positives with a negative score have no negatives (their window is empty). Components of
2^31 / scale or more raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SAMPLE = 4096
CODES = 256
GROUP = 65_536
ANCHORS = 4096
#: Rows scored at a time.
STEP = 512

CELL = "dim int, part int, c1 int, c2 int, r1 double, r2 double, ids binary, labels binary, values binary"
ASKED = "part int, anchors int, akey long, anchor_id long, label long, v binary, windows array<struct<window:long,lo:long,hi:long>>"


def whole_rows(vectors: DataFrame, label: Column, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, label, dim, v) of the different rows that take part."""
    whole = F.transform(embedding, lambda x: F.when(F.abs(x.cast("double")) < float((1 << 31) // scale), F.floor(x.cast("double") * scale).cast("int"))
                        .otherwise(F.raise_error(F.lit("component too large")).cast("int")))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).alias(embedding))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(embedding) > 0)).filter(finite)
            .select("vec_id", "label", F.size(embedding).alias("dim"), whole.alias("v")).distinct())


def codebook(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centroids by k-means from evenly spaced starts along the first principal direction."""
    centred = x - x.mean(axis=0)
    first = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    centroids = x[np.argsort(centred @ first, kind="stable")[np.linspace(0, len(x) - 1, codes).astype(int)]]
    centroids = np.unique(centroids, axis=0)
    for _ in range(rounds):
        own = nearest(x, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, x[:, d], len(centroids)) for d in range(x.shape[1])], axis=1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - (centroids ** 2).sum(axis=1) / 2).argmax(axis=1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2.0 ** 53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in x], np.int64)


class Walk:
    """The cells of one partition and dimension, ready to be visited by anchors."""

    def __init__(self, codes: np.ndarray, radii: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        """``codes`` and ``radii``: (c1, c2) and (r1, r2) of each row, which are sorted by cell."""
        self.ids, self.labels, self.x = ids, labels, x
        self.used, self.centroids, self.radii, at = [], [], [], []
        for half in (0, 1):
            used, own = np.unique(codes[:, half], return_inverse=True)
            self.centroids.append(books[half][used])
            r = np.zeros(len(used))
            np.maximum.at(r, own, radii[:, half])
            self.radii.append(r * (1 + 1e-9) + 1e-9)
            at.append(own)
        cell = at[0] * len(self.centroids[1]) + at[1]
        order = np.argsort(cell, kind="stable")
        self.order = order
        self.starts = np.searchsorted(cell[order], np.arange(len(self.centroids[0]) * len(self.centroids[1]) + 1))
        self.largest = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0)))

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, rows) of the cells that have rows, by falling bound: the multi-sequence walk over both sorted halves."""
        cut = len(q) // 2
        terms = [c @ part + np.linalg.norm(part) * r for c, r, part in zip(self.centroids, self.radii, (q[:cut], q[cut:]))]
        order = [np.argsort(-t, kind="stable") for t in terms]
        one, two = (t[o].tolist() for t, o in zip(terms, order))
        slack = 1e-9 * float(np.linalg.norm(q)) * self.largest + 1e-6
        heap, width = [(-one[0] - two[0], 0, 0)], len(two)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-one[i] - two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-one[i + 1] - two[0], i + 1, 0))
            cell = order[0][i] * width + order[1][j]
            a, b = self.starts[cell], self.starts[cell + 1]
            if a < b:
                yield slack - bound, self.order[a:b]

    def visit(self, anchor_id: int, label: int, q: np.ndarray, windows: list[tuple[int, int, int]], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each window (lo, hi, least): its k best (vec_id, score), lo <= score <= hi, of which no score is below ``least``."""
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        least = [w[2] for w in windows]
        waiting, n, cells = [], 0, self.cells(q.astype(float))
        bound, rows = next(cells, (-np.inf, None))
        while rows is not None and bound >= min(least):
            while rows is not None and n < STEP and bound >= min(least):
                rows = rows[(self.labels[rows] == label) & (self.ids[rows] != anchor_id) if same else self.labels[rows] != label]
                waiting.append(rows)
                n += len(rows)
                bound, rows = next(cells, (-np.inf, None))
            at = np.concatenate(waiting)
            waiting, n = [], 0
            scores, ids = exact_scores(self.x[at], q), self.ids[at]
            for w, (lo, hi, _) in enumerate(windows):
                fits = (scores <= hi) & (scores >= least[w])
                if fits.any():
                    s, i = np.concatenate((kept[w][1], scores[fits])), np.concatenate((kept[w][0], ids[fits]))
                    first = np.lexsort((i, -s))[:k]
                    kept[w] = (i[first], s[first])
                    if len(first) == k:
                        least[w] = max(least[w], int(s[first[-1]]))
        return [list(zip(i.tolist(), s.tolist())) for i, s in kept]


def _array(column: pa.Array | pa.ChunkedArray, at: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[at].as_py(), kind)


def _packed_cells(rows: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], parts: int) -> DataFrame:
    """One row for each cell of a partition and dimension, with its rows packed."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            codes = np.zeros((2, batch.num_rows), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(-1, dim).astype(float)
                for half, part in enumerate((x[:, :dim // 2], x[:, dim // 2:])):
                    codes[half, at] = nearest(part, shared.value[int(dim)][half])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes[0]), pa.array(codes[1])], names=["vec_id", "label", "dim", "v", "c1", "c2"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            dims, c1, c2 = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4, 5))
            edges = np.flatnonzero(np.diff(dims, prepend=-1) | np.diff(c1, prepend=-1) | np.diff(c2, prepend=-1))
            out = []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                dim = int(dims[a])
                v = batch.column(3).slice(a, b - a).flatten().to_numpy().reshape(-1, dim).astype("<i4")
                cut, own = dim // 2, shared.value[dim]
                r1 = np.sqrt(((v[:, :cut] - own[0][c1[a]]) ** 2).sum(axis=1).max())
                r2 = np.sqrt(((v[:, cut:] - own[1][c2[a]]) ** 2).sum(axis=1).max())
                ids, labels = (batch.column(i).slice(a, b - a).to_numpy().astype("<i8").tobytes() for i in (0, 1))
                out.append((dim, part, int(c1[a]), int(c2[a]), float(r1), float(r2), ids, labels, v.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in CELL.split(", ")], r)) for r in out],
                                             schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("c1", pa.int32()), ("c2", pa.int32()), ("r1", pa.float64()),
                                                               ("r2", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("values", pa.binary())]))

    coded = rows.select("vec_id", "label", "dim", "v").mapInArrow(assign, "vec_id long, label long, dim int, v array<int>, c1 int, c2 int")
    return (coded.repartitionByRange(parts, "dim", "c1", "c2", "vec_id", F.xxhash64("v"))
            .sortWithinPartitions("dim", "c1", "c2", "vec_id").mapInArrow(pack, CELL))


def _reach(cells: DataFrame) -> dict[int, list[tuple]]:
    """Per dimension (part, codes of half one, radii, codes of half two, radii): a few numbers for each partition."""
    halves = [cells.groupBy("dim", "part", F.lit(h).alias("half"), F.col(f"c{h}").alias("code")).agg(F.max(f"r{h}").alias("r")) for h in (1, 2)]
    found: dict[tuple[int, int], list] = {}
    for row in halves[0].unionAll(halves[1]).collect():
        found.setdefault((row.dim, row.part), [[], []])[row.half - 1].append((row.code, row.r))
    out: dict[int, list[tuple]] = {}
    for (dim, part), (one, two) in sorted(found.items()):
        out.setdefault(dim, []).append((part, *[np.array(x) for half in (one, two) for x in zip(*half)]))
    return out


def _best(cells: DataFrame, anchors: DataFrame, books: dict, sample: dict, reach: dict, groups: int, same: bool, k: int) -> DataFrame:
    """(akey, window, vec_id, score, rank): the k best rows of each window of ``anchors`` (akey, vec_id, label, dim, v, windows)."""
    spark = cells.sparkSession
    shared = spark.sparkContext.broadcast((books, sample, reach))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sample, reach = shared.value
        heads = {}  # the sample as one partition
        for dim, (ids, labels, x) in sample.items():
            codes = np.stack([nearest(part, book) for part, book in zip((x[:, :dim // 2].astype(float), x[:, dim // 2:].astype(float)), books[dim])], axis=1)
            radii = np.stack([np.linalg.norm(part - book[own], axis=1) for part, book, own in zip((x[:, :dim // 2], x[:, dim // 2:]), books[dim], codes.T)], axis=1)
            heads[dim] = Walk(codes, radii, ids, labels, x, books[dim])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                q, dim = np.array(row["v"], np.int64), row["dim"]
                windows = [(w["lo"], w["hi"], w["lo"]) for w in row["windows"]]
                head = heads[dim].visit(row["vec_id"], row["label"], q, windows, same, k)
                least = [s[-1][1] if len(s) == k else w[0] for s, w in zip(head, windows)]
                given = [dict(w, lo=low) for w, low in zip(row["windows"], least)]
                qf = q.astype(float)
                halves = [qf[:dim // 2], qf[dim // 2:]]
                terms, norms = [book @ part for book, part in zip(books[dim], halves)], [np.linalg.norm(part) for part in halves]
                far = [np.linalg.norm(book, axis=1).max() for book in books[dim]]
                for part, c1, r1, c2, r2 in reach[dim]:
                    most = (terms[0][c1.astype(int)] + norms[0] * r1).max() + (terms[1][c2.astype(int)] + norms[1] * r2).max()
                    if most + 1e-9 * (norms[0] * (far[0] + r1.max()) + norms[1] * (far[1] + r2.max())) + 1e-6 >= min(least):
                        out.append({"part": part, "anchors": row["akey"] % groups, "akey": row["akey"], "anchor_id": row["vec_id"], "label": row["label"],
                                    "v": q.astype("<i4").tobytes(), "windows": given})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("part", pa.int32()), ("anchors", pa.int32()), ("akey", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()),
                ("windows", pa.list_(pa.struct([("window", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])))]))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            books = shared.value[0]
            for dim in sorted(set(left.column("dim").to_pylist())):
                own = [i for i, d in enumerate(left.column("dim").to_pylist()) if d == dim]
                ids = [_array(left.column("ids"), i, "<i8") for i in own]
                labels = np.concatenate([_array(left.column("labels"), i, "<i8") for i in own])
                x = np.concatenate([_array(left.column("values"), i, "<i4").reshape(-1, dim) for i in own])
                sizes = [len(i) for i in ids]
                by_row = [np.repeat(np.array([left.column(c)[i].as_py() for i in own]), sizes) for c in ("c1", "c2", "r1", "r2")]
                walk = Walk(np.stack(by_row[:2], axis=1), np.stack(by_row[2:], axis=1), np.concatenate(ids), labels, x, books[dim])
                for row in right.to_pylist():
                    q = np.frombuffer(row["v"], "<i4").astype(np.int64)
                    if len(q) == dim:
                        best = walk.visit(row["anchor_id"], row["label"], q, [(w["lo"], w["hi"], w["lo"]) for w in row["windows"]], same, k)
                        out += [(row["akey"], w["window"], i, s) for w, found in zip(row["windows"], best) for i, s in found]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["akey", "window", "vec_id", "score"])

    asked = staged(anchors.select("akey", "vec_id", "label", "dim", "v", "windows").mapInArrow(ask, ASKED), "asked")
    dealt = cells.withColumn("anchors", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = dealt.groupBy("part", "anchors").cogroup(asked.groupBy("part", "anchors")).applyInArrow(
        meet, "akey long, window long, vec_id long, score long")
    order = Window.partitionBy("akey", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", sample_rows: int = SAMPLE,
         group: int = GROUP, anchor_group: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors that ``is_anchor`` (over ``vec_id``)
    selects: the best ``negatives`` rows of another label with low % to high % of the score of each of the best ``positives`` rows of its own."""
    spark = vectors.sparkSession
    rows = staged(whole_rows(vectors, F.col("label") if label is None else label, scale, vec_id, embedding), "rows")
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample, books = {}, {}
    for dim, n in sorted(sizes.items()):
        head = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "label").limit(sample_rows).collect()
        x = np.array([r.v for r in head], np.int64)
        sample[dim] = (np.array([r.vec_id for r in head], np.int64), np.array([r.label for r in head], np.int64), x)
        codes = max(2, min(CODES, int(n ** 0.5 / 8)))
        books[dim] = tuple(codebook(part, codes) if part.shape[1] else np.zeros((1, 0)) for part in (x[:, :dim // 2].astype(float), x[:, dim // 2:].astype(float)))
    total = sum(sizes.values())
    parts = max(1, -(-total // group), min(spark.sparkContext.defaultParallelism, -(-total // 1024)))
    cells = staged(_packed_cells(rows, books, parts), "cells")
    reach = _reach(cells)
    anchors = rows.filter(F.col("vec_id").isNotNull() & is_anchor).withColumn("akey", F.xxhash64("vec_id", "label", "v").bitwiseAND(F.lit((1 << 63) - 1)))
    anchors = staged(anchors, "anchors")
    groups = max(1, -(-anchors.count() // anchor_group))

    whole_range = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi")))
    good = staged(_best(cells, anchors.withColumn("windows", whole_range), books, sample, reach, groups, True, positives)
                  .select("akey", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = good.filter("positive_score >= 0").select("akey", F.col("positive_score").alias("window")).distinct().withColumns({
        "lo": F.expr(f"({low} * window + 99) div 100"), "hi": F.expr(f"({high} * window) div 100")})
    wanted = limits.groupBy("akey").agg(F.collect_list(F.struct("window", "lo", "hi")).alias("windows"))
    bad = _best(cells, anchors.join(wanted, "akey"), books, sample, reach, groups, False, negatives)
    named = good.join(anchors.select("akey", F.col("vec_id").alias("anchor_id")), "akey")
    return named.join(bad, (named["akey"] == bad["akey"]) & (named["positive_score"] == bad["window"])).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
