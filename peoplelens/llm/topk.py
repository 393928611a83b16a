"""Exact top-k search by integer inner product over vectors sorted by length.

Vectors are turned into floor(scale * x), range-partitioned by falling norm and packed into blocks. The longest vectors of all
give each query a first lower bound for its k-th best score. A query meets a block only if |q| |x| can still reach
that bound. Inside a block the inner product is summed over the leading coordinates after a rotation (the singular vectors of the
corpus, largest variance first); the Cauchy-Schwarz product of what is left of both vectors bounds the rest. Pairs whose bound
stays below are skipped, the others are scored exactly in whole numbers.

Queries travel to partitions of candidates, in blocks, and only to those they can still gain from; a partition holds at most
about ``GROUP`` vectors. A pair of blocks returns at most k rows per query, so what is ranked at the end is small.

Defined cases: NULL vectors, empty ones and those with NULL or non-finite components take no part. Vectors are compared only with those
of their own dimension. A whole row that is repeated counts once, and so does an id that has one score by several vectors. A query that has fewer than k candidates gets them all. Components
of 2^31 / scale or more raise an error, and so does a score that does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

K = 10
SCALE = 1024
BLOCK = 2048
QUERY_BLOCK = 256
GROUP = 65_536
#: Vectors of greatest norm that give the first bound.
HEAD = 4096
LEADING = 24

BLOCK_SCHEMA = "dim int, part int, top double, ids binary, values binary"


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, norm2, v): valid vectors as whole numbers, with the square of their length."""
    valid = F.size(embedding) > 0
    valid &= F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float((1 << 31) // scale)))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return (vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).filter(finite)
            .withColumn("_ok", F.when(valid, True).otherwise(F.raise_error(F.lit("component too large"))))
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("dim"), v.alias("v"), "_ok")
            .filter("_ok").drop("_ok")
            .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _pack(rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of consecutive rows of one dimension; a row equal to the one before it is left out."""
        from pyspark import TaskContext

        part, held, before = TaskContext.get().partitionId(), [], None

        def flush():
            dim = len(held[0][1])
            ids = np.array([h[0] for h in held], "<i8")
            values = np.array([h[1] for h in held], "<i8")
            top = float(np.sqrt((values.astype(float) ** 2).sum(axis=1).max()))
            out = pd.DataFrame({"dim": [dim], "part": [part], "top": [top], "ids": [ids.tobytes()], "values": [values.tobytes()]})
            held.clear()
            return out

        for batch in batches:
            for vec_id, v in zip(batch["vec_id"], batch["v"]):
                row = (vec_id, v.tobytes())
                if row == before:
                    continue
                before = row
                if held and (len(held) == rows or len(held[0][1]) != len(v)):
                    yield flush()
                held.append((vec_id, v))
        if held:
            yield flush()

    return run


def _rotation(numbers: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the eigenvectors of the second moments, largest first; each task sends sums, not vectors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = np.array(part["v"].tolist(), float)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            i, j = np.triu_indices(dim)
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "s": m[i, j]})

    total = (numbers.select("dim", "v").mapInPandas(run, "dim int, i int, j int, s double")
             .groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas())
    out = {}
    for dim, part in total.groupby("dim"):
        m = np.zeros((dim, dim))
        m[part["i"], part["j"]] = part["s"]
        m[part["j"], part["i"]] = part["s"]
        out[int(dim)] = np.linalg.eigh(m)[1][:, ::-1]
    return out


def _unpack(ids: bytes, values: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(values, "<i8").reshape(-1, dim)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one whole-number vector with many, exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * len(q) < 2.0 ** 53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q, row)) for row in x], np.int64)


def block_scores(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int,
                 leading: int = LEADING) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of at most k rows per query. ``x`` falls in length; ``bounds`` (a score that each query has k
    times already) are raised in place."""
    qf, xf = q @ turn, x @ turn
    q_norm, x_norm = np.linalg.norm(qf, axis=1), np.linalg.norm(xf, axis=1)
    slack = 1e-9 * q_norm * x_norm.max(initial=0) + 1e-6
    reach = [int(np.searchsorted(-x_norm, -(b - s) / n if n else (-np.inf if b - s > 0 else np.inf), side="right"))
             if np.isfinite(b) else len(x) for b, s, n in zip(bounds, slack, q_norm)]
    longest = max(reach, default=0)
    if not longest:
        return []
    d = min(leading, x.shape[1])
    partial = qf[:, :d] @ xf[:longest, :d].T
    rest = np.linalg.norm(qf[:, d:], axis=1)[:, None] * np.linalg.norm(xf[:longest, d:], axis=1)[None, :]
    maybe = partial + rest + slack[:, None] >= bounds[:, None]
    out = []
    repeated = len(np.unique(ids)) < len(ids)
    for i in range(len(q)):
        at = np.flatnonzero(maybe[i, :reach[i]])
        at = at[ids[at] != q_ids[i]]
        if not len(at):
            continue
        scores = _exact(q[i], x[at])
        enough = scores >= bounds[i]
        at, scores = at[enough], scores[enough]
        if repeated:  # one id with one score is one result, and counts once towards the k-th best
            once = np.unique(np.stack((ids[at], scores)), axis=1, return_index=True)[1]
            at, scores = at[once], scores[once]
        best = _best(ids[at], scores, k)
        if len(best) == k:
            bounds[i] = max(bounds[i], float(scores[best[-1]]))
        out += [(int(q_ids[i]), int(ids[at[b]]), int(scores[b])) for b in best]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each row that ``is_query`` (over ``vec_id``) selects."""
    spark = vectors.sparkSession
    numbers = staged(whole_numbers(vectors, vec_id, embedding, scale).distinct(), "numbers")
    total = numbers.count()
    turns = _rotation(numbers)
    parallel = spark.sparkContext.defaultParallelism
    parts = max(1, -(-total // GROUP), min(parallel, -(-total // 1024)))
    blocks = staged(numbers.repartitionByRange(parts, F.col("dim"), F.col("norm2").desc(), "vec_id")
                    .sortWithinPartitions("dim", F.col("norm2").desc(), "vec_id")
                    .select("vec_id", "v").mapInPandas(_pack(BLOCK), BLOCK_SCHEMA), "blocks")
    asked = staged(numbers.filter(is_query).select("dim", "vec_id", "v").sortWithinPartitions("dim", "vec_id")
                   .select("vec_id", "v").mapInPandas(_pack(QUERY_BLOCK), BLOCK_SCHEMA), "queries")
    head: dict[int, list] = {}
    for dim in turns:  # HEAD vectors of each dimension
        rows = numbers.filter(F.col("dim") == dim).orderBy(F.col("norm2").desc(), "vec_id").limit(HEAD).collect()
        head[dim] = [np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.int64).reshape(-1, dim)]
    tops = {(r.part, r.dim): r.top for r in blocks.groupBy("part", "dim").agg(F.max("top").alias("top")).collect()}
    shared = spark.sparkContext.broadcast((turns, head, tops))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First bounds from the head, and one row for each partition of candidates that the block can gain from."""
        turns, head, tops = shared.value
        for batch in batches:
            for dim, top, ids, values in zip(batch["dim"], batch["top"], batch["ids"], batch["values"]):
                q_ids, q = _unpack(ids, values, dim)
                bounds = np.full(len(q), -np.inf)
                for at in range(0, len(head[dim][0]), BLOCK):
                    block_scores(q_ids, q, bounds, head[dim][0][at:at + BLOCK], head[dim][1][at:at + BLOCK], turns[dim], k)
                norms = np.linalg.norm(q.astype(float), axis=1)
                for (part, d), longest in sorted(tops.items()):
                    if d == dim and (norms * longest * (1 + 1e-9) + 1e-6 >= bounds).any():
                        yield pd.DataFrame({"dim": [dim], "part": [part], "q_ids": [ids], "q": [values],
                                            "bounds": [bounds.astype("<f8").tobytes()]})

    asked = staged(asked.mapInPandas(bound, "dim int, part int, q_ids binary, q binary, bounds binary"), "asked")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = shared.value[0]
        seen: dict[bytes, np.ndarray] = {}  # bounds that this task has raised
        for batch in batches:
            for row in batch.itertuples(index=False):
                q_ids, q = _unpack(row.q_ids, row.q, row.dim)
                ids, x = _unpack(row.ids, row.values, row.dim)
                bounds = seen.setdefault(row.q_ids, np.frombuffer(row.bounds, "<f8").copy())
                found = block_scores(q_ids, q, bounds, ids, x, turns[row.dim], k)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    pairs = blocks.join(asked, ["dim", "part"]).select("dim", "q_ids", "q", "bounds", "ids", "values")
    scores = pairs.mapInPandas(score, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
