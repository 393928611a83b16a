"""Near-duplicate groups against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peoplelens.llm import near_texts, simhash
from peoplelens.llm.common import staged
from tests.llm.test_pairs import slow_components


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    close = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    return slow_components(ids, close)


def edited_copies(rng):
    """Ten texts with copies of up to ten edited words, around a similarity of 0.8, and texts that share one long passage only."""
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " ", "One", "one", "a b c d e", "a b c d f"]
    for size in (9, 30, 60, 100, 100, 140, 200, 300, 400, 2500):
        base = [word() for _ in range(size)]
        for edits in [0] + [rng.randrange(11) for _ in range(14)]:
            copy = list(base)
            for at in rng.sample(range(size), min(edits, size)):
                copy[at] = word()
            texts.append(" ".join(copy[rng.randrange(3):]))
    passage = [word() for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(2, 60))]) for _ in range(50)]
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("bucket,often", [(near_texts.BUCKET, near_texts.OFTEN), (4, 2)])
def test_groups_equal_all_pairs(spark, bucket, often):
    """Also with blocks of four sets and with nearly all shared shingles moved to the end."""
    texts = edited_copies(random.Random(7))
    want = slow_groups(texts)
    assert 80 < len(set(want.values())) < len(want) - 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in near_texts.keep_one(docs, bucket=bucket, often=often).collect())
    assert kept == sorted(set(want.values()))


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, absent ids, wholly equal rows, a text that a third of all rows hold, clashing names and empty tables."""
    words = [f"w{i}" for i in range(200)]
    edit = lambda at: " ".join("new" if i in at else w for i, w in enumerate(words))
    rows = [(9, edit([]), "x"), (4, edit([50, 120]), "x"), (4, edit([20, 80, 160]), "x"), (5, edit(range(5, 200, 20)), "x"), (5, edit(range(5, 200, 20)), "x"),
            (None, "left without an id", "x"), (None, "left without an id", "y"), (None, "left without an id", "y"), (None, None, "x"), (8, "", "x"),
            (3, "two texts of one id", "x"), (3, "another text of that id, kept too", "x")]
    rows += [(100, "the same row many times over and over", "x")] * 40 + [(200 + i, "THE same row many times over  and over", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumns(
        {c: F.lit("clash") for c in ("row", "row_key", "least", "text_key", "size", "shingle", "part", "root", "key")}).repartition(5)
    got = near_texts.keep_one(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.node) for r in got.collect()) in [
        Counter({(4, "x"): 1, (5, "x"): 1, (None, n): 1, (8, "x"): 1, (3, "x"): 2, (100, "x"): 1}) for n in "xy"]
    assert near_texts.keep_one(docs.limit(0)).isEmpty()


def test_stage_keeps_one_of_texts_with_edited_words(spark):
    words = [f"w{i}" for i in range(200)]
    edited = {2: [50, 120], 3: [20, 80, 160], 4: list(range(5, 200, 20))}
    rows = [(1, " ".join(words))] + [(i, " ".join("new" if k in at else w for k, w in enumerate(words))) for i, at in edited.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()) == [1, 4]


def near_copies(n, rng):
    """Texts of 150 words, one of them edited."""
    edited = [rng.randrange(150) for _ in range(n)]
    return [(i, " ".join(f"new{i}" if k == edited[i] else f"w{k}" for k in range(150))) for i in range(n)]


def test_candidates_of_near_copies_grow_in_proportion(spark):
    """Clusters of near copies give as many candidates as they have members, times the shingles they are paired by, and join in the first round."""
    per_row = []
    for n in (250, 2000):
        texts = spark.createDataFrame(near_copies(n, random.Random(n)), "doc_id long, text string").repartition(4)
        docs = near_texts._keyed(texts, "doc_id", "text")
        nodes = staged(near_texts.node_table(docs, near_texts.frequent_shingles(docs)), "nodes")
        count = nodes.count()
        pairs = staged(near_texts.first_pairs(staged(near_texts.shared_prefixes(nodes), "shared")), "pairs")
        per_row.append(pairs.count() / count)
    assert near_texts.classes(texts).select("root").distinct().count() == 1
    assert max(per_row) < 40 and per_row[1] < 2 * per_row[0]


def test_heads_across_batches_and_partitions(spark):
    """Each shingle's nodes are joined by the pairs with their heads, wherever batches and partitions cut them."""
    rng = random.Random(1)
    rows = [(i, 10, sorted(rng.sample(range(40), 6))) for i in range(3000)]
    nodes = spark.createDataFrame(rows, "node long, size int, prefix array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        shared = staged(near_texts.shared_prefixes(nodes.repartition(5)), "t")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = shared.collect()
    assert Counter((r.shingle, r.node) for r in found) == Counter((s, i) for i, _, p in rows for s in p)
    pairs = near_texts.first_pairs(shared).collect()
    assert len(set(slow_components(list(range(3000)), [(r.a, r.b) for r in pairs]).values())) == 1 and len(pairs) < 7 * 3000


def test_forest_spans_what_is_close():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 30
        close = rng.random((n, n)) < 0.06
        close = np.triu(close, 1) | np.triu(close, 1).T
        parts = rng.integers(0, 25, n)
        pairs, more = near_texts.forest(close, parts)
        every = [(i, j) for i in range(n) for j in range(i) if close[i, j] and parts[i] != parts[j]]
        same = [(i, j) for i in range(n) for j in range(i) if parts[i] == parts[j]]
        assert slow_components(list(range(n)), pairs + same) == slow_components(list(range(n)), every + same)
        assert all(close[i, j] and parts[i] != parts[j] for i, j in pairs) and len(pairs) < n and more == (len(every) > len(pairs))


def test_fingerprints_give_the_first_candidates(spark):
    """Texts that two bits tell apart at most are paired by their SimHash; of a bucket each text is paired once."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(f"new{i}" if i and k == 700 * i else w for k, w in enumerate(base)) for i in range(4)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(20)]
    docs = near_texts._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    nodes = staged(near_texts.node_table(docs, np.zeros(0, np.int64)), "nodes")
    by_node = {r.node: r for r in nodes.collect()}
    assert {r.fp for r in by_node.values()} == {int(np.uint64(simhash.fingerprint(t)).view(np.int64)) for t in texts}
    near = [(a, b) for a in by_node for b in by_node if a < b and (by_node[a].fp ^ by_node[b].fp).bit_count() <= simhash.DISTANCE]
    pairs = [tuple(r) for r in near_texts.print_pairs(nodes).collect()]
    assert near and slow_components(sorted(by_node), pairs) == slow_components(sorted(by_node), near)
    assert len({b for _, b in pairs}) == len(pairs) and all(a < b for a, b in pairs)


def test_texts_just_below_the_similarity_make_rows_in_proportion(spark, monkeypatch):
    """Texts that all look alike by parities but are too different: no table grows with the square of their number."""
    rows = Counter()

    def counted(df, name="stage"):
        out = staged(df, name)
        rows[name] += out.count()
        return out

    def copies(n, rng):
        return [" ".join(f"new{i}" if k % 80 == at else f"w{k}" for k in range(400)) for i in range(n) for at in [rng.randrange(10, 70)]]

    monkeypatch.setattr(near_texts, "staged", counted)
    found = []
    for n in (50, 200):
        rows.clear()
        texts = spark.createDataFrame(list(enumerate(copies(n, random.Random(n)))), "doc_id long, text string").repartition(4)
        assert near_texts.keep_one(texts).count() == len(set(slow_groups(dict(enumerate(copies(n, random.Random(n))))).values()))
        found.append(dict(rows))
    assert found[1]["tried"] > 100
    assert found[1].pop("trees") < found[1]["open"]
    assert {k: (found[0].get(k), v) for k, v in found[1].items() if v > 6 * max(50, found[0].get(k, 0))} == {}
