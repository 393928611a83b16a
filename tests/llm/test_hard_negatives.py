"""Hard negatives against scores of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peoplelens.llm import hard_negatives, queries


def slow_mine(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    """``rows``: (vec_id, vector, label)."""
    valid = {}
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            valid[vec_id, label, tuple(math.floor(float(np.float32(x)) * scale) for x in v)] = None
    out = []
    for vec_id, label, q in valid:
        if not anchor(vec_id):
            continue
        scored = [(-sum(a * b for a, b in zip(q, x)), i, k) for i, k, x in valid if len(x) == len(q)]
        best = sorted((s, i) for s, i, k in scored if k == label and i != vec_id)[:positives]
        others = sorted((s, i) for s, i, k in scored if k != label)
        for ps, p in best:
            fit = [(s, i) for s, i in others if low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(vec_id, p, rank, i, -ps, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(frame, **options):
    found = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit("clash") for c in ("v", "dim", "part", "akey", "c1", "windows", "rank", "anchors")}).repartition(4)


@pytest.mark.parametrize("dim,spread", [(16, 3.0), (7, 0.02), (1, 1.0)])
def test_mined_rows_equal_all_pairs(spark, dim, spread):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim)) * spread
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=dim) * 0.3 * spread], int(rng.integers(4))) for i in range(700)]
    rows = [(i, v, (i % 12) // 3 if k else k) for i, v, k in rows]
    got = mined(frame_of(spark, rows), group=100, anchor_group=20, sample_rows=50)
    assert got == slow_mine(rows, lambda i: i % 10 == 0) and got
    assert got == mined(frame_of(spark, rows))


def test_odd_rows(spark):
    """A third of all rows is one vector; ties, invalid rows, other dimensions, repeated rows, few candidates and zero scores."""
    rng = np.random.default_rng(9)
    hot = [0.5, 0.25, -0.5, 1.0]
    rows = [(i, hot, i % 3) for i in range(300)] + [(1000 + i, [float(x) for x in rng.integers(-2, 3, 4) / 2], int(rng.integers(5))) for i in range(500)]
    rows += [(10, hot, 1), (10, hot, 10 % 3), (1010, [9.0, 9.0, 9.0, 9.0], 1), (None, hot, 1), (2000, None, 1), (2010, [], 1), (2020, [1.0, None, 1.0, 1.0], 1),
             (2030, [1.0, float("nan"), 0.0, 0.0], 1), (2040, [float("inf"), 0.0, 0.0, 0.0], 1), (2050, hot, None), (2060, [1.0, 2.0], 1), (2061, [1.0, 2.0], 1),
             (2062, [1.0, 1.0], 2), (2070, [3.0], 1), (2080, [0.0] * 4, 77), (2081, [0.0] * 4, 77), (-20, hot, 1)]
    rows += rows[:100] + rows[-9:]
    got = mined(frame_of(spark, rows), group=64, anchor_group=7, sample_rows=30)
    assert got == slow_mine(rows, lambda i: i % 10 == 0)
    assert {2060, 2080, -20} <= {r[0] for r in got}
    empty = frame_of(spark, rows).limit(0)
    assert mined(empty) == [] and hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(Exception, match="too large"):
        mined(frame_of(spark, [(1, [1e9], 1)]))


def test_walk_visits_cells_by_bound_and_stops_when_certified():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(-200, 200, (20, 1)), axis=0) + rng.integers(-3, 4, (20, 400))
    x = np.concatenate([x, rng.integers(-200, 200, (20, 400))], axis=0).T[:, rng.permutation(40)] * 10
    books = tuple(hard_negatives.codebook(part.astype(float), 16) for part in (x[:, :20], x[:, 20:]))
    codes = np.stack([hard_negatives.nearest(part, book) for part, book in zip((x[:, :20], x[:, 20:]), books)], axis=1)
    radii = np.stack([np.linalg.norm(part - book[c], axis=1) for part, book, c in zip((x[:, :20], x[:, 20:]), books, codes.T)], axis=1)
    walk = hard_negatives.Walk(codes, radii, np.arange(len(x)), np.arange(len(x)) % 2, x, books)
    q = x[7]
    seen, last = [], np.inf
    for bound, rows in walk.cells(q.astype(float)):
        assert bound <= last + 1e-6 and (x[rows] @ q <= bound).all()
        last = bound
        seen += rows.tolist()
    assert sorted(seen) == list(range(len(x)))


def test_certified_windows_skip_cells(monkeypatch):
    """In well-parted data a walk scores only a part of the rows."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-1000, 1000, (30, 8))
    x = centres[rng.integers(30, size=3000)] + rng.integers(-5, 6, (3000, 8))
    books = tuple(hard_negatives.codebook(part.astype(float), 24) for part in (x[:, :4], x[:, 4:]))
    codes = np.stack([hard_negatives.nearest(part, book) for part, book in zip((x[:, :4], x[:, 4:]), books)], axis=1)
    radii = np.stack([np.linalg.norm(part - book[c], axis=1) for part, book, c in zip((x[:, :4], x[:, 4:]), books, codes.T)], axis=1)
    walk, scored = hard_negatives.Walk(codes, radii, np.arange(3000), np.arange(3000) % 3, x, books), []
    real = hard_negatives.exact_scores
    monkeypatch.setattr(hard_negatives, "exact_scores", lambda rows, q: scored.append(len(rows)) or real(rows, q))
    monkeypatch.setattr(hard_negatives, "STEP", 32)
    q, least = x[5], -(1 << 62)
    found = walk.visit(5, 5 % 3, q, [(least, 1 << 62, least)], True, 5)[0]
    every = x @ q
    assert found == sorted(((i, int(every[i])) for i in range(3000) if i % 3 == 2 and i != 5), key=lambda t: (-t[1], t[0]))[:5]
    assert sum(scored) < 500


def test_op11_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in queries.op11_hard_negatives(spark, sf).collect()]
    assert sorted(got) == slow_mine(rows, lambda i: i % 100 == 0) and got
