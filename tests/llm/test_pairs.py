"""SimHash, components and top-k search against brute force, with hot groups."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from peoplelens.llm import queries, simhash, topk
from peoplelens.llm.common import staged
from peoplelens.llm.components import components

SF = "/root/testdata/sf0.01"


def slow_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, n) for n in range(501, 560)] + [(7, 8), (8, 9), (9, 7), (5, 5)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = slow_components({n for e in edges for n in e}, edges)
    assert all(want[n] == c for n, c in got.items()) and all(n in got or want[n] == n for n in want)
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_fingerprints_equal_the_plain_definition():
    for text in ["", None, "One", "one  TWO", "a b c", "É è é à x", "a\tb\x0bc\x0cd\re\nf g", "x y " * 40_000, "the cat sat on the mat " * 7]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_op6_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    close = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    want = slow_components(ids, [(ids[a], ids[b]) for a, b in close])
    got = queries.op6_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_links_of_dense_groups_are_whole(spark):
    """Small buckets force all three levels; a cube of close fingerprints stays one component, far ones stay apart."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(6))) for _ in range(400)}
    far = {rng.getrandbits(64) for _ in range(300)}
    pairs = {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in list(far)[:100]}
    values = sorted(near | far | pairs)
    arr = np.array(values, np.uint64)
    close = np.argwhere(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2, 1))
    want = slow_components(range(len(values)), close.tolist())
    rows = [(i, int(v) - (1 << 64) if v >= 1 << 63 else int(v)) for i, v in enumerate(values)]
    marked = spark.createDataFrame(rows, "doc_id long, fp long")
    for bucket in (4, 512):
        found = simhash.near_duplicates(marked, bucket=bucket)
        got = {r.doc_id: r.component for r in marked.join(found, "fp").collect()}
        assert got == want


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, "k"), (4, "", "k"), (None, " ", "k"), (9, "a b c d", None), (9, "a b c d", None), (8, "A B C D", "z")],
                                 "doc_id long, text string, fp string")
    marked = staged(simhash.fingerprints(docs), "t")
    got = sorted((r.doc_id or 0, r.component) for r in marked.join(simhash.near_duplicates(marked), "fp").collect())
    assert got == [(0, 4), (4, 4), (5, 4), (8, 8), (9, 8), (9, 8)]
    assert simhash.near_duplicates(marked.limit(0)).isEmpty()


def slow_top(rows, k=10):
    vectors = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault((i, tuple(int(np.floor(1024 * float(x))) for x in v)), None)
    out = {}
    for q, qv in vectors:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vectors if i != q and len(v) == len(qv))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def check_top(spark, rows, **extra):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(extra)
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == {q: v for q, v in slow_top(table.select("vec_id", "embedding").collect()).items() if v}


def test_op3_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check_top(spark, rows)


def test_top_k_ties_hot_vectors_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "HEAD", 20)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 450)]
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (1400, []), (1500, [0.25, 0.5]),
             (1501, [1.0, -1.0]), (1600, [0.0] * 8), (200, rows[200][1])]
    check_top(spark, rows, rank=F.lit("x"), dim=F.lit(0), score=F.lit(None))
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).isEmpty()


def test_large_components_stay_exact(spark):
    rows = [(i, [1_000_000.0 - i, -999_999.5, 999_998.25]) for i in range(30)] + [(100, [1_000_000.0, 500_000.0, 1.0])]
    check_top(spark, rows)


def test_top_k_of_repeated_rows(spark):
    """Every row twice, the longest rows 20 times, and ids with two vectors of equal score: ten different results each."""
    rng = np.random.default_rng(4)
    rows = [(i, [*rng.normal(size=7).tolist(), 0.0]) for i in range(300)] * 2
    rows += [(i, [*(9 * rng.normal(size=7)).tolist(), 0.0]) for i in range(301, 304) for _ in range(2)]
    rows += [(310, [20.0] * 7 + [0.0])] * 20 + [(311 + i // 2, [9.0 + i // 2] * 7 + [float(i)]) for i in range(8)]
    whole = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows}
    want = {}
    for q in (0, 100, 200):
        found = {(-sum(a * b for a, b in zip(qv, v)), i) for p, qv in whole if p == q for i, v in whole if i != q}
        want[q] = [(i, -s) for s, i in sorted(found)[:10]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(table, F.col("vec_id").isin(0, 100, 200)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
