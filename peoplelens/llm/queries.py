"""Registered queries of the operators, and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peoplelens.llm import (decontaminate, hard_negatives, html_text, language, lexical, line_dedup, packing, pseudonyms, quality, secret_scan, simhash,
                            token_rollup, topk)
from peoplelens.llm.common import new_folder, remainder, staged, table

#: Key of the registered query only; a real run brings its own secret.
EXAMPLE_KEY = b"example key, not a secret"
VOCABULARIES = {name: f"/opt/tokenizers/{name}.tiktoken" for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    stats = staged(quality.statistics_table(docs, keep=("doc_id", "held_out")), "statistics")
    forest = quality.fit(stats.filter("NOT held_out"), table(spark, sf_dir, "labels"))
    scored = quality.score(stats, forest, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise_documents(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after six deliveries: all documents under each of two tokenizers, a tenth of them first counted without a language; that tenth
    is then revised, another tenth taken down and put back, and two batches are delivered twice."""
    counts = staged(token_rollup.token_counts(table(spark, sf_dir, "documents"), VOCABULARIES), "counts")
    store = token_rollup.Rollup(spark, new_folder(spark, "rollup"))

    def changes(rows: DataFrame, op: str = "upsert", lang=F.col("lang")) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), F.lit(0).cast("long").alias("seq"), "doc_id", "version", "source", lang.alias("lang"), "tokens")

    first, second = (counts.filter(F.col("version") == name) for name in VOCABULARIES)
    revised, taken_down = F.col("doc_id") % 10 == 3, F.col("doc_id") % 10 == 7
    no_lang_yet = F.when(~F.coalesce(revised, F.lit(False)), F.col("lang"))
    deliveries = [("load", changes(first, lang=no_lang_yet)), ("upgrade", changes(second)), ("upgrade", changes(second)),
                  ("revision", changes(counts.filter(revised))), ("takedown", changes(counts.filter(taken_down), "delete")),
                  ("takedown", changes(counts.filter(taken_down), "delete")), ("restore", changes(counts.filter(taken_down)))]
    for batch, rows in deliveries:
        store.apply(batch, rows)
    return store.totals()


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = staged(simhash.fingerprints(docs), "fingerprints")
    classes = staged(simhash.near_duplicates(marked), "classes")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    model = language.fit(language.labelled(docs, F.col("held_out")))
    return language.predict(docs, model, keep=("doc_id", "held_out"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "row.source", "text", "lines_total", "lines_dropped")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_count(F.col("text")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows gets the next label first, so that labels and vectors disagree."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is an owner and each document a repository of it."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.col("doc_id"))
    return found.select("doc_id", *[c.alias(name) for name, c in secret_scan.digest().items()])


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_pseudonyms, op3_topk, op4_main_text, op5_token_rollup, op6_simhash, op7_language, op8_decontaminate, op9_line_dedup, op10_packing,
    op11_hard_negatives, op12_lexical, op13_secrets)}
#: Whole numbers as lists of doubles keep every product and sum exact.
OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT DISTINCT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.w, v.w) AS BIGINT) AS score
           FROM v AS q JOIN v ON len(q.w) = len(v.w) AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _op8_sql() -> str:
    """Without masks: of 15 tokens with at most three edits, or of 10 to 14 with two, three neighbours are equal; of 5 to 9 with one, two are."""
    width, share = decontaminate.STRETCH, decontaminate.SHARE
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    runs = " UNION ALL ".join(
        f"SELECT id, p, {g} AS g, list_aggregate(w[p + 1:p + {g}], 'string_agg', ' ') AS s FROM (SELECT id, w, unnest(range(len(w) - {g - 1})) AS p "
        f"FROM {{source}} WHERE len(w) >= {g} AND {{wanted}})" for g in (1, 2, 3))
    runs_of_items = " UNION ALL ".join(
        f"SELECT * FROM ({x})" for x in runs.replace("{source}", "sized").replace("{wanted}", "{}").format(
            "len(w) < 5", "len(w) BETWEEN 5 AND 9", "len(w) >= 10").split(" UNION ALL "))
    runs_of_docs = runs.replace("{source}", "docs").replace("{wanted}", "{}").format(
        *[f"EXISTS (SELECT 1 FROM item_runs WHERE g = {g})" for g in (1, 2, 3)])
    return f"""
WITH sized AS (SELECT row_number() OVER () AS id, * FROM (SELECT min(item_id) AS item_id, count(*) AS items, w
                 FROM (SELECT item_id, {words} AS w FROM benchmark) GROUP BY w) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
item_runs AS ({runs_of_items}),
doc_runs AS ({runs_of_docs}),
hits AS (SELECT DISTINCT d.id AS d, i.id AS i, d.p - i.p AS shift FROM doc_runs AS d JOIN item_runs AS i ON d.g = i.g AND d.s = i.s),
parts AS (SELECT d, i, greatest(shift, 0) AS doc_start, greatest(-shift, 0) AS item_start,
            least(len(docs.w) - greatest(shift, 0), len(sized.w) - greatest(-shift, 0)) AS aligned, least({width}, len(sized.w)) AS width,
            docs.w[greatest(shift, 0) + 1:greatest(shift, 0) + len(sized.w)] AS dwords, sized.w AS iwords, doc_id, item_id, items
          FROM hits JOIN docs ON docs.id = d JOIN sized ON sized.id = i),
same AS (SELECT *, list_transform(range(aligned), lambda k: CASE WHEN dwords[k + 1] = iwords[item_start + k + 1] THEN 1 ELSE 0 END) AS eq
         FROM parts WHERE aligned >= width),
good AS (SELECT *, CAST(list_sum(eq) AS INTEGER) AS equal FROM same WHERE list_sum(eq) >= ceil(width * {share})
           AND len(list_filter(range(1, aligned - width + 2), lambda k: list_sum(eq[k:k + width - 1]) >= ceil(width * {share}))) > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY equal DESC, doc_start, item_start) AS r FROM good)
SELECT doc_id, item_id, items, CAST(doc_start AS INTEGER) AS doc_start, CAST(item_start AS INTEGER) AS item_start,
  CAST(aligned AS INTEGER) AS aligned, equal FROM best WHERE r = 1
"""


OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
held AS (SELECT DISTINCT id, host, trim(line) AS line FROM (SELECT id, host, unnest(lines) AS line FROM docs) WHERE trim(line) <> ''),
totals AS (SELECT host, count(*) AS n FROM docs GROUP BY host),
bad AS (SELECT h.host, list(h.line) AS lines FROM (SELECT host, line, count(*) AS k FROM held GROUP BY host, line) AS h JOIN totals USING (host)
        WHERE k >= {line_dedup.MIN_PAGES} AND k > n * CAST({line_dedup.RATIO} AS DOUBLE) GROUP BY h.host),
cut AS (SELECT d.*, coalesce(len(list_filter(d.lines, lambda x: trim(x) <> '')), 0) AS total,
          list_filter(d.lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad.lines, []), trim(x))) AS kept
        FROM docs AS d LEFT JOIN bad USING (host)),
done AS (SELECT *, len(kept) < len(lines) AND len(list_filter(kept, lambda x: trim(x) <> '')) > 0 AS changed FROM cut)
SELECT doc_id, source, CASE WHEN changed THEN array_to_string(kept, chr(10)) ELSE text END AS text, CAST(total AS INTEGER) AS lines_total,
  CAST(CASE WHEN changed THEN len(lines) - len(kept) ELSE 0 END AS INTEGER) AS lines_dropped FROM done
"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT DISTINCT * FROM v),
scored AS (SELECT q.vec_id AS anchor_id, r.vec_id, q.label = r.label AS same, CAST(list_dot_product(q.w, r.w) AS BIGINT) AS score
           FROM rows AS q JOIN rows AS r ON len(q.w) = len(r.w) WHERE q.vec_id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored
                             WHERE same AND vec_id <> anchor_id) WHERE r <= 5),
negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
              FROM positives AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.same
              WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_TERMS = rf"unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t"
OP12_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, t, count(*) AS repeats FROM (SELECT i, {OP12_TERMS} FROM items) GROUP BY i, t),
docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
held AS (SELECT d, t, count(*) AS tf FROM (SELECT d, {OP12_TERMS} FROM docs) GROUP BY d, t),
lengths AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY d),
whole AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM lengths),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT t, count(*) AS df FROM held GROUP BY t), whole),
scores AS (SELECT i, d, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // length)))) AS BIGINT) AS score
           FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN lengths USING (d), whole GROUP BY i, d),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
           FROM scores JOIN items USING (i) JOIN docs USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _op13_sql() -> str:
    """Positions from the lengths of the pieces between matches; owners and repositories of each value counted over all documents."""
    kinds = dict(zip(secret_scan.KINDS, (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.OPAQUE, secret_scan.DSN)))
    group = {"assign": 2, "dsn": 1}
    holds = {"assign": "length(v) >= 8", "dsn": "length(v) >= 8",
             "opaque": "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"}
    found = []
    for at, (kind, pattern) in enumerate(kinds.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        value = f"regexp_extract(m, {p}, {group[kind]})" if kind in group else "m"
        found.append(f"""
SELECT id, source, doc_id, {at} AS kind, '{kind}' AS name, s, s + length(m) AS e, m, {value} AS v FROM (
  SELECT id, source, doc_id, ms[i] AS m, CAST(list_sum([length(x) FOR x IN pieces[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT id, source, doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS pieces FROM docs) WHERE len(ms) > 0))
WHERE {holds.get(kind, 'true')}""")
    every = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in found)
    told = "name || ':' || s || ':' || e"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({every}),
candidates AS (SELECT * FROM found AS x WHERE kind < 3 OR NOT EXISTS (
  SELECT 1 FROM found AS y WHERE y.id = x.id AND y.kind < 3 AND x.s < y.e AND y.s < x.e)),
held AS (SELECT v, count(*) AS repositories, count(DISTINCT coalesce(source, '?')) AS owners
         FROM (SELECT DISTINCT v, source, doc_id FROM candidates) GROUP BY v),
spans AS (SELECT *, owners > {secret_scan.MAX_OWNERS} OR repositories > {secret_scan.MAX_REPOSITORIES} AS copied FROM candidates JOIN held USING (v)),
digests AS (SELECT id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  coalesce(string_agg({told}, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg({told}, ',' ORDER BY s, kind) AS spans,
  count(*) FILTER (NOT copied) AS live, count(*) FILTER (copied) AS n_copied FROM spans WHERE kind < 3 OR NOT copied GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM docs LEFT JOIN digests USING (id)
"""


ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op8_decontaminate": _op8_sql(), "op9_line_dedup": OP9_SQL,
                           "op11_hard_negatives": OP11_SQL, "op12_lexical": OP12_SQL, "op13_secrets": _op13_sql()}
