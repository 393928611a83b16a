"""Lexical search against scores of all documents by the formula."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peoplelens.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow_search(docs, items, k=20):
    own = [Counter(slow_terms(t)) for _, t in docs]
    total, length = sum(bool(c) for c in own), sum(sum(c.values()) for c in own)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for (doc, _), c in zip(docs, own):
            n = sum(c.values())
            m = 100 - 25 + (25 * n * total) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in slow_terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def planted():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)] + ["Élan", "élan", "ÜBER", "über", "\U0001f600", "a b", "x_y", "CamelCase", "9"]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(n))
    items = [(i, pick(rng.randrange(1, 25))) for i in range(30)]
    items += [(100, " ".join(words) + " " + pick(100)), (101, None), (102, ""), (103, "... --"), (104, "absent"), (3, "w1 w2 W2"), (None, "w5 w5 w7"), (105, "w0")]
    items += [items[0], (106, items[1][1])]
    docs = [(i, pick(rng.randrange(0, 120))) for i in range(900)]
    docs += [(2000 + i, items[i % 30][1] + " " + pick(5)) for i in range(60)] + [(4000 + i, items[2][1]) for i in range(70)]
    docs += [(5000, None), (5001, ""), (5002, "!!!"), (None, items[4][1]), (None, items[4][1]), (4001, items[2][1]), (5003, "w3 " * 40_000 + "\x00w4\x00")]
    return docs, items


@pytest.mark.parametrize("round_terms,block,step", [(lexical.ROUND_TERMS, lexical.BLOCK, lexical.STEP), (60, 64, 1)])
def test_ranks_equal_the_formula(spark, monkeypatch, round_terms, block, step):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "ids", "item", "terms", "score")}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "terms", "rank", "df")})
    got = sorted(map(str, (tuple(r) for r in lexical.search(frame, asked, round_terms=round_terms).collect())))
    assert got == sorted(map(str, slow_search(docs, items)))
    assert lexical.search(frame.limit(0), asked).isEmpty() and lexical.search(frame, asked.limit(0)).isEmpty()


def test_masks_group_documents_by_their_terms():
    rng = np.random.default_rng(1)
    for terms in (1, 8, 63, 64, 65, 200):
        present = rng.random((terms, 300)) < (0.5 if terms < 8 else 0.01)
        masks, group = lexical.group_masks(present)
        assert (masks[group] == present.T).all() and len(masks) == len({row.tobytes() for row in present.T})


def test_groups_beyond_the_bound_are_left_unscored(monkeypatch):
    """With rare terms in a few documents, most groups are never scored, and the result is that of all documents."""
    rng = np.random.default_rng(2)
    present = rng.random((12, 4000)) < np.array([0.9] * 8 + [0.01] * 4)[:, None]
    gains = np.where(present, rng.integers(400_000, 900_000, present.shape), 0).astype(np.int32)
    weights = np.array([50] * 8 + [6000] * 4, np.int64)
    ids = (np.zeros(4000, bool), np.arange(4000))
    calls = []
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: calls.append(len(keys[0])) or real(keys))
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    best = lexical.best_of_block(weights, gains, present, ids, none, 20)
    scores = weights @ gains.astype(np.int64)
    want = real((np.arange(4000), -scores))[:20]
    assert (best[2] == want).all() and (best[0] == scores[want]).all() and sum(calls) < 800


def test_op12_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op12_lexical(spark, sf).collect()]
    assert sorted(got) == sorted(slow_search(docs, items))
    ranks = defaultdict(list)
    for item, rank, _, _ in got:
        ranks[item].append(rank)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())
