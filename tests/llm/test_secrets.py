"""Secrets against Python's regular expressions and plain counting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from peoplelens.llm import queries, secret_scan

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PLAIN = [(0, ASSIGN, 2, 8), (1, re.compile("AKIA[A-Z0-9]+"), 0, 16), (2, re.compile("[0-9a-f]+"), 0, 32)]
MORE = [(3, re.compile("[A-Za-z0-9+/_-]{20,}"), 0, 20), (4, re.compile(r"://[^\x00-\x20:/@]+:([^\x00-\x20/@]+)@"), 1, 8)]


def slow_scan(rows, max_owners=secret_scan.MAX_OWNERS, max_repositories=secret_scan.MAX_REPOSITORIES):
    """Per row (doc_id, text, owner): its spans (start, kind, end, value, owners, repositories, copied)."""
    found = []
    for _, text, _ in rows:
        text = text or ""
        base = [(m.start(), k, m.end(), m.group(g)) for k, p, g, least in PLAIN for m in p.finditer(text) if len(m.group(g)) >= least]
        added = [(m.start(), k, m.end(), m.group(g)) for k, p, g, least in MORE for m in p.finditer(text) if len(m.group(g)) >= least]
        added = [x for x in added if (x[1] == 4 or all(re.search(c, x[3]) for c in ("[a-z]", "[A-Z]", "[0-9]")))
                 and not any(x[0] < y[2] and y[0] < x[2] for y in base)]
        found.append(sorted(base + added))
    holders = defaultdict(set)
    for (doc, _, owner), spans in zip(rows, found):
        for x in spans:
            holders[x[3]].add((owner, doc))
    out = []
    for spans in found:
        done = []
        for start, kind, end, value in spans:
            owners, repositories = len({o for o, _ in holders[value]}), len(holders[value])
            copied = owners > max_owners or repositories > max_repositories
            if kind < 3 or not copied:
                done.append((start, kind, end, hashlib.sha256(value.encode()).hexdigest(), owners, repositories, copied))
        out.append(done)
    return out


def planted():
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(4)]
    opaque = "".join(rng.choice("abcXYZ019_") for _ in range(30)) + "aA1"
    texts = [None, "", " ", "no secrets", "password=short", "password=token: abcdefgh1", "PassWord : 'abcdefgh' api-key=abcdefghi ApiKey=\"abc/def+g=\"",
             "\U0001f600é token = \"" + hexes[0] + "\" ü " + hexes[1], "AKIA" + "A" * 11, "xAKIA" + "B" * 12 + "\U0001f600AKIAAKIAAKIAAKIA1",
             "f" * 31, "f" * 32, "g" + "0" * 64 + "h", opaque, "(" + opaque + ")", "url postgres://user:hunter22hunter@host/db and ://a:short@",
             "secret=" + opaque + " then " + opaque, "api_key==abcdefgh", "token:  =abcdefgh", "ſecret=abcdefgh1 toKen=abcdefgh1", "secret=" + "x" * 200_000,
             " ".join(f"{i:032x}" for i in range(3000)), "passwordpassword=abcdefgh"]
    rows = [(i, t, f"o{i % 5}") for i, t in enumerate(texts)]
    rows += [(100 + i, f"copied token={hexes[2]} here", f"o{i % 4}") for i in range(40)]
    rows += [(200 + i, f"mine {i} token={hexes[3]}", "o1") for i in range(20)]
    rows += [(300 + i, "example Aa1" + "bC2" * 9, f"o{i}") for i in range(5)] + [(None, f"token={hexes[3]}", None)] * 2
    rows += [(400 + i, "all over Zz9" + "yX8" * 9, "o1") for i in range(secret_scan.MAX_REPOSITORIES + 5)] + [(7, texts[7], "o2")]
    return rows


def test_spans_and_owners_against_plain_counting(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("clash") for c in ("key", "candidates", "spans", "value", "row", "base", "kind", "assign")}).repartition(7)
    got = secret_scan.scan(docs, F.col("source"), F.col("doc_id"), keep=("doc_id", "source", "key")).collect()
    plain = lambda r, spans: (str(r[0]), str(r[1]), tuple(tuple(x) for x in spans))
    assert sorted(plain((r.doc_id, r.source), r.spans) for r in got) == sorted(plain((d, o), s) for (d, _, o), s in zip(rows, slow_scan(rows)))
    assert {r.key for r in got} == {"clash"}
    assert secret_scan.scan(docs.limit(0), F.col("source"), F.col("doc_id")).isEmpty()


def test_op13_digests_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    spans = slow_scan([(r.doc_id, r.text, r.source) for r in docs])
    want = {}
    for r, own in zip(docs, spans):
        told = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, *_ in own]
        base = ",".join(t for t, x in zip(told, own) if x[1] < 3)
        want[r.doc_id] = (*(sum(x[1] == k for x in own) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(told),
                          sum(not x[6] for x in own), sum(x[6] for x in own))
    found = queries.op13_secrets(spark, SF)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_live, r.n_copied) for r in found.collect()}
    assert got == want and any(x[0] for x in want.values())
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
