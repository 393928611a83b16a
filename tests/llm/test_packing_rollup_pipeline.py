"""Packing, token rollups and the pipeline."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from peoplelens.llm import language, packing, queries, token_rollup
from peoplelens.llm.common import new_folder, table
from tests.llm.test_near_texts import slow_groups
from tests.llm.test_texts import slow_dedup, slow_overlaps

SF = "/root/testdata/sf0.001"


# Packing

def slow_pack(lengths, capacities, overhead):
    """Best fit by looking at every open bin and every waiting item."""
    bins, placed, waiting = [], [], list(lengths)
    for n in lengths:
        waiting.remove(n)
        fitting = [(b[1] - b[0], -i) for i, b in enumerate(bins) if b[1] - b[0] >= n]
        if fitting:
            space = min(f[0] for f in fitting)
            i = last_with[space][-1]
            last_with[space].pop()
        else:
            costs = []
            for c in capacities:
                if c >= n:
                    room, filled = c - n, n
                    for w in sorted(waiting, reverse=True):
                        if w <= room:
                            room, filled = room - w, filled + w
                    costs.append(((min(x for x in capacities if x >= filled) + overhead) / filled, c))
            bins.append([0, min(costs)[1]])
            i = len(bins) - 1
            if i == 0:
                last_with = defaultdict(list)
        placed.append(i)
        bins[i][0] += n
        if bins[i][0] < bins[i][1]:
            last_with[bins[i][1] - bins[i][0]].append(i)
    return placed, [b[1] for b in bins], [min(c for c in capacities if c >= b[0]) for b in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_packing_equals_the_plain_definition(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets, opened, final = packing.pack_lengths(lengths, (8, 16, 40), 2)
    want, want_opened, want_final = slow_pack(lengths, (8, 16, 40), 2)
    assert (bins, opened, final) == (want, want_opened, want_final)
    used = Counter()
    for b, o, n in zip(bins, offsets, lengths):
        assert o == used[b]
        used[b] += n


def check_packing(rows, lengths, capacities):
    """Every document is packed once and whole, no bin overflows, and bins have the smallest permitted length."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == lengths
    for p in pieces.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0
    for found in bins.values():
        found.sort(key=lambda r: r.bin_offset)
        assert found[0].bin_offset == 0 and all(a.bin_offset + a.length == b.bin_offset for a, b in zip(found, found[1:]))
        used = sum(r.length for r in found)
        assert {(r.bin_used, r.bin_capacity) for r in found} == {(used, min(c for c in capacities if c >= used))}
        assert all(r.opened_capacity >= r.bin_capacity for r in found)


def test_op10_packs_every_word_once(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lengths = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    rows = queries.op10_packing(spark, "/root/testdata/sf0.01").collect()
    check_packing(rows, lengths, packing.CAPACITIES)
    bins = {r.bin_id: (r.bin_used, r.bin_capacity) for r in rows if r.bin_id is not None}
    assert sum(u for u, _ in bins.values()) / sum(c for _, c in bins.values()) > 0.97


def test_packing_in_shards_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 30, 31, 95, 1000, None]), 1) for i in range(500)] + [(None, 7, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, bin_id int")
    packed = packing.pack(docs, F.col("n"), capacities=(32, 8, 16), shard_items=100)
    check_packing(packed.collect(), {d: n or 0 for d, n, _ in rows}, (8, 16, 32))
    twice = packing.pack(docs.filter("doc_id < 9").union(docs.filter("doc_id < 9")), F.col("n"), capacities=(2000,))
    assert twice.count() == 18
    assert packing.pack(docs.limit(0), F.col("n")).isEmpty()


def test_rows_without_an_id_are_dealt_over_all_shards(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).alias("doc_id"), F.lit(5).alias("n"))
    packed = packing.pack(docs, F.col("n"), capacities=(50,), shard_items=100).collect()
    shards = Counter(r.bin_id >> 32 for r in packed)
    assert len(packed) == 3000 and len(shards) == 30 and max(shards.values()) < 160
    assert all(r.bin_used <= r.bin_capacity == 50 for r in packed)


# Rollups

def totals(store):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in store.totals().collect()}


def test_rollup_follows_a_dictionary(spark):
    rng = random.Random(2)
    store, state = token_rollup.Rollup(spark, new_folder(spark, "test")), {}
    for batch in range(3):
        rows, last = [], {}
        for seq in range(60):
            doc = rng.randrange(40)
            op = rng.choice(["upsert", "upsert", "delete"])
            row = (op, seq, doc, rng.choice("ab"), rng.choice(["hot", "hot", "x", None]), rng.choice(["en", None]), rng.randrange(100))
            rows.append(row)
            last[row[2], row[3]] = row
        for key, row in last.items():
            state.pop(key, None)
            if row[0] == "upsert":
                state[key] = row
        changes = spark.createDataFrame(rows, token_rollup.CHANGE).withColumn("sign", F.lit("clash"))
        assert store.apply(f"b{batch}", changes)
        assert not store.apply(f"b{batch}", changes.limit(3))
        want = defaultdict(lambda: (0, 0))
        for row in state.values():
            d, t = want[row[4], row[5], row[3]]
            want[row[4], row[5], row[3]] = (d + 1, t + row[6])
        assert totals(store) == dict(want)
    assert store.entries().count() == len(state)


def test_rollup_ignores_what_was_not_committed(spark):
    folder = new_folder(spark, "test")
    store = token_rollup.Rollup(spark, folder)
    row = ("upsert", 0, 1, "a", "s", "en", 5)
    spark.createDataFrame([("s", "en", "a", 9, 9)], "source string, lang string, version string, documents long, tokens long").write.parquet(
        f"{folder}/deltas/one")
    assert totals(store) == {}
    assert store.apply("one", spark.createDataFrame([row], token_rollup.CHANGE))
    assert totals(store) == {("s", "en", "a"): (1, 5)} and store.batches() == ["one"]
    odd = [("delete", 0, 7, "a", None, None, None), ("upsert", 0, None, "a", "s", "en", 2), ("upsert", 0, None, "a", "s", "en", 2),
           ("delete", 0, None, "a", "s", "en", 2), ("upsert", 1, 1, "a", "s", "en", None), ("upsert", 1, 1, "a", "s", "en", None)]
    assert store.apply("two", spark.createDataFrame(odd, token_rollup.CHANGE))
    assert store.apply("three", spark.createDataFrame([], token_rollup.CHANGE))
    assert totals(store) == {("s", "en", "a"): (3, 4)}
    with pytest.raises(ValueError):
        store.apply("../x", spark.createDataFrame([], token_rollup.CHANGE))


def test_op5_equals_counting_afresh(spark):
    import base64

    import tiktoken

    want = defaultdict(lambda: [0, 0])
    for version, path in queries.VOCABULARIES.items():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("own", pat_str=token_rollup.CUT, mergeable_ranks=ranks, special_tokens={})
        for r in table(spark, SF, "documents").collect():
            cell = want[r.source, r.lang, version]
            cell[0] += 1
            cell[1] += len(encoder.encode_ordinary(r.text or ""))
    got = {(r.source, r.lang, r.version): [r.documents, r.tokens] for r in queries.op5_token_rollup(spark, SF).collect()}
    assert got == dict(want)


def test_token_counts_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 100_000), (None, "<|endoftext|>")], "doc_id long, text string").withColumn(
        "tokens", F.lit("x"))
    rows = token_rollup.token_counts(docs, queries.VOCABULARIES, keep=("doc_id",)).collect()
    assert len(rows) == 8 and all((r.tokens == 0) == (r.doc_id in (1, 2)) for r in rows)
    assert token_rollup.token_counts(docs.limit(0), queries.VOCABULARIES, keep=("doc_id",)).isEmpty()


# Pipeline

def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)

    told = stages["language"](spark, docs, SF)
    model = language.fit(docs)
    rejected = {r.doc_id for r in language.predict(docs, model).filter("rejected").collect()}
    rows = {r.doc_id: r for r in told.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - rejected and len(rejected) < 4 and told.columns == docs.columns

    lines = stages["line_dedup"](spark, told, SF)
    got = {r.doc_id: r for r in lines.collect()}
    want = {i: text for i, text, _, _ in slow_dedup([(r.doc_id, r.text, r.source) for r in rows.values()])}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert [f.dataType for f in lines.schema] == [f.dataType for f in docs.schema]

    single = stages["near_dedup"](spark, lines, SF)
    kept = {r.doc_id for r in single.collect()}
    assert kept == set(slow_groups({i: r.text for i, r in got.items()}).values()) and single.count() == len(kept) and single.columns == docs.columns

    clean = stages["decontaminate"](spark, single, SF)
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {d for d, _ in slow_overlaps([(i, got[i].text) for i in kept], bench)} if len(kept) < 250 else set()
    assert {r.doc_id for r in clean.collect()} == kept - leaks and clean.columns == docs.columns

    check_packing(stages["packing"](spark, clean, SF).collect(), {i: len(got[i].text.encode().split()) for i in kept - leaks}, packing.CAPACITIES)


def test_stages_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, `key` string, fp long, component int"
    rows = [(1, None, None, None, None, 1, None, 1, 1), (2, "", "en", "a", 0, 1, "x", 1, 1), (None, "the cat and the dog", "en", "a", 19, 1, "x", 1, 1),
            (3, "the cat and the dog", "en", "a", 19, None, "x", 1, 1), (3, "the cat and the dog", "en", "a", 19, None, "x", 1, 1),
            (4, "w " * 100_000 + "the", "en", None, 200_003, 1, "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.strip("`") for c in ["doc_id", "text", "lang", "source", "n_chars", "row", "key", "fp", "component"]]
    assert Counter(r.doc_id for r in docs.collect()) == {3: 1, 4: 1}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 1 + 13


def test_run_is_the_stages_one_after_another(spark):
    assert corpus_pipeline.run(spark, SF).columns == [c.split()[0] for c in packing.ROWS.split(", ")]
