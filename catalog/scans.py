"""Scans, sinks, predicates and lookups (IO, P, J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.people import NUMERIC, people
from catalog.registry import (
    HIGH_SQL, OUTLIER_SQL, P, ZONES_SQL, big, binned_sql, group_sql, lab, noise_sql, number_long,
    number_stats, query, rd, rounded, table,
)
from peoplelens import rules as R
from peoplelens.functions.expr import (
    col, first_int, gender, is_noise, is_target, label, number, outside, parse_number,
)
from peoplelens.functions.frames import melt, small_frame
from peoplelens.operators import audit as Q
from peoplelens.operators import exploration as E
from peoplelens.operators import features as X
from peoplelens.operators import outliers as O
from peoplelens.session import new_folder
from peoplelens.sources import scan, sink


@query("io1_header_normalised_scan", """
SELECT o_orderkey AS order_key, o_orderstatus AS order_status, round(o_totalprice, 2) AS total_price FROM orders""")
def io1(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice") \
        .toDF(" Order Key ", "ORDER STATUS", "Total Price")
    return rounded(scan.normalise_header(raw), 2)


TOKEN_CASE = """CASE o_orderkey % 9 WHEN 0 THEN 'NA' WHEN 1 THEN 'none' WHEN 2 THEN '' WHEN 3 THEN 'N/A'
 WHEN 4 THEN '<NA>' WHEN 5 THEN 'unknown' WHEN 6 THEN 'Na' ELSE o_orderpriority END"""


@query("io2_null_tokens", f"""
SELECT coalesce(v, '(null)') AS value, count(*) AS n FROM (
  SELECT CASE WHEN t IN ('', 'NA', 'N/A', 'n/a', 'null', 'NULL', 'None', 'nan', 'NaN', '#N/A', '<NA>') THEN NULL ELSE t END AS v
  FROM (SELECT {TOKEN_CASE} AS t FROM orders)) GROUP BY 1""")
def io2(spark, sf):
    raw = table(spark, sf, "orders").select(F.expr(TOKEN_CASE).alias("t"))
    return scan.null_tokens(raw).groupBy(F.coalesce("t", F.lit("(null)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


GATE = "o_totalprice < 1000 OR o_orderpriority = '2-HIGH' OR o_orderkey % 11 = 0"


@query("io3_ingest_gate", f"""SELECT CASE WHEN {GATE} THEN 'rejected' ELSE 'accepted' END AS verdict, o_orderpriority AS priority, count(*) AS records
  FROM orders GROUP BY 1, 2""")
def io3(spark, sf):
    """Rows that miss a required value are written aside, the others accepted; both are read back and counted."""
    raw = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.expr(f"CASE WHEN {GATE} THEN NULL ELSE o_totalprice END").alias("price"))
    accepted, rejected = scan.split_rows(raw, ["o_orderkey", "price"])
    folder = new_folder(spark, "gate")
    good = spark.read.parquet(sink.write_snapshot(accepted, folder, "accepted"))
    bad = spark.read.parquet(sink.write_snapshot(rejected, folder, "rejected"))
    both = good.select(F.lit("accepted").alias("verdict"), "o_orderpriority").unionByName(bad.select(F.lit("rejected").alias("verdict"), "o_orderpriority"))
    return both.groupBy("verdict", F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("records"))


TOKENS_SQL = "(" + ", ".join("'" + t + "'" for t in R.CSV_NULL_TOKENS) + ")"


@query("io3_quarantine", f"""
WITH d AS (SELECT doc_id % 7 AS kind, lang IS NULL OR lang IN {TOKENS_SQL} OR doc_id % 7 IN (2, 5) AS no_lang,
             CASE WHEN text IN {TOKENS_SQL} THEN 0 ELSE coalesce(length(text), 0) END AS chars FROM documents),
r AS (SELECT 'fields' AS reason, kind, 0 AS chars FROM d WHERE kind IN (0, 3)
  UNION ALL SELECT 'missing:lang', kind, 0 FROM d WHERE kind NOT IN (0, 3) AND no_lang
  UNION ALL SELECT 'unparsable:n_chars', kind, 0 FROM d WHERE kind IN (1, 5)
  UNION ALL SELECT 'accepted', kind, chars FROM d WHERE kind NOT IN (0, 1, 3, 5) AND NOT no_lang)
SELECT reason, kind, count(*) AS records, CAST(sum(chars) AS BIGINT) AS chars FROM r GROUP BY reason, kind""")
def io3_quarantine(spark, sf):
    """All documents as CSV lines, most of them damaged by their id; accepted and rejected records are written, read back and counted by reason."""
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("n_chars", "long")
    accepted, rejected = scan.quarantine(spark, _damaged_csv(spark, sf), schema, required=("doc_id", "lang"), multiline=True)
    folder = new_folder(spark, "quarantine")
    good = spark.read.parquet(sink.write_snapshot(accepted, folder, "accepted"))
    bad = spark.read.parquet(sink.write_snapshot(rejected, folder, "rejected"))
    counted = good.select(F.lit("accepted").alias("reason"), (F.col("doc_id") % 7).alias("kind"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    doc = F.regexp_extract(scan.RECORD, r"^(\d+),", 1).cast("long")
    counted = counted.unionByName(bad.select(F.explode(scan.REASONS).alias("reason"), (doc % 7).alias("kind"), F.lit(0).alias("chars")))
    return counted.groupBy("reason", "kind").agg(F.count(F.lit(1)).alias("records"), F.sum("chars").cast("long").alias("chars"))


def _damaged_csv(spark, sf):
    """Of each seven documents: one with a field too many, one cut off, one and one with a number that is none, two without a language."""
    kind, doc = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"'))
    fields = [doc, F.when(kind.isin(1, 5), F.concat(F.lit("about "), doc)).otherwise(F.length("text").cast("string")),
              F.when(~kind.isin(2, 5), F.col("lang")), quoted]
    line = F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])
    line = F.when(kind == 0, F.concat(line, F.lit(",extra"))).when(kind == 3, F.concat(doc, F.lit(",1"))).otherwise(line)
    # The first row of a task begins its file, with the header.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    path = new_folder(spark, "damaged")
    table(spark, sf, "documents").select(F.when(first, F.concat(F.lit("Doc_ID,n_chars, Lang,text\n"), line)).otherwise(line).alias("value")).write.text(path)
    return path


@query("io4_versioned_sink", P + """ SELECT version, sex, count(*) AS n FROM people
  JOIN (VALUES (0), (1)) AS t(version) ON true GROUP BY version, sex""")
def io4(spark, sf):
    folder = new_folder(spark, "sink")
    p = people(spark, sf).select("sex")
    first = sink.write_versioned(p, folder, "people")
    second = sink.write_versioned(p, folder, "people")
    assert first != second
    both = spark.read.parquet(first).select(F.lit(0).alias("version"), "sex").unionByName(
        spark.read.parquet(second).select(F.lit(1).alias("version"), "sex"))
    return both.groupBy("version", "sex").agg(F.count(F.lit(1)).alias("n"))


@query("io4_csv_round_trip", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def io4_csv(spark, sf):
    """All documents to CSV and back: line breaks, quotes and commas inside texts survive."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = sink.write_versioned(docs, new_folder(spark, "csv"), "documents", fmt="csv")
    return scan.read_csv(spark, path, schema=docs.schema, multiline=True)


@query("io5_snapshot_sink", P + " SELECT workclass, income, count(*) AS n FROM people GROUP BY workclass, income")
def io5(spark, sf):
    folder = new_folder(spark, "snap")
    p = people(spark, sf).select("workclass", "income")
    sink.write_snapshot(p.select("income"), folder, "latest")
    sink.write_snapshot(p, folder, "latest")
    return sink.read_snapshot(spark, folder, "latest").groupBy("workclass", "income").agg(F.count(F.lit(1)).alias("n"))


@query("io6_preview", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 10")
def io6(spark, sf):
    return scan.preview(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), [F.asc("c_custkey")])


@query("io7_name_search", """SELECT event_id, event_type, ts FROM events WHERE regexp_matches(event_type, '(?i)C.*K')
  ORDER BY ts DESC, event_id LIMIT 5 OFFSET 5""")
def io7(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return scan.search(e, "event_type", "C.*K", "ts", page=2, tie="event_id")


# --- predicates --------------------------------------------------------------------------------------------------

TARGET_CASE = """CASE o_orderkey % 6 WHEN 0 THEN ' >50K. ' WHEN 1 THEN '>50k' WHEN 2 THEN '<=50K' WHEN 3 THEN NULL
 WHEN 4 THEN 'over >50K' ELSE '50K' END"""


@query("p2_target_predicate", f"""SELECT coalesce(t, '(null)') AS value,
  coalesce(contains(lower(trim(t)), '>50k'), false) AS high, count(*) AS n FROM (SELECT {TARGET_CASE} AS t FROM orders) GROUP BY 1, 2""")
def p2(spark, sf):
    raw = table(spark, sf, "orders").select(F.expr(TARGET_CASE).alias("t"))
    return raw.groupBy(F.coalesce("t", F.lit("(null)")).alias("value"), is_target(F.col("t")).alias("high")) \
        .agg(F.count(F.lit(1)).alias("n"))


NOISE_CASE = """CASE o_orderkey % 13 WHEN 0 THEN ' N/A ' WHEN 1 THEN '?' WHEN 2 THEN 'é' WHEN 3 THEN '_' WHEN 4 THEN '  '
 WHEN 5 THEN 'Unknown' WHEN 6 THEN '#REF!' WHEN 7 THEN '7' WHEN 8 THEN 'n.a' WHEN 9 THEN NULL WHEN 10 THEN ' x ' ELSE o_orderstatus END"""


@query("p3_noise_predicate", f"""SELECT coalesce(v, '(null)') AS value, coalesce({noise_sql('v')}, false) AS noise, count(*) AS n
  FROM (SELECT {NOISE_CASE} AS v FROM orders) GROUP BY 1, 2""")
def p3(spark, sf):
    raw = table(spark, sf, "orders").select(F.expr(NOISE_CASE).alias("v"))
    return raw.groupBy(F.coalesce("v", F.lit("(null)")).alias("value"),
                       F.coalesce(is_noise(F.col("v")), F.lit(False)).alias("noise")).agg(F.count(F.lit(1)).alias("n"))


@query("p4_safe_zone_predicate", P + f""", {number_long()}, {ZONES_SQL} SELECT l.col AS "column",
  (z.col IS NULL OR l.v < z.zmin OR l.v > z.zmax) AS outside, count(*) AS n
  FROM nlong l LEFT JOIN zones z ON l.col = z.col GROUP BY 1, 2""")
def p4(spark, sf):
    p, rules = people(spark, sf), R.Rules()
    flags = melt(p, {c: F.when(number(p, c).isNotNull(), outside(number(p, c), rules.zone(c))) for c in NUMERIC})
    return flags.where(F.col("value").isNotNull()).groupBy("column", F.col("value").alias("outside")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("p5_safe_zone_violations", P + """ SELECT count(*) AS violations FROM people WHERE age < 10 OR age > 90""")
def p5(spark, sf):
    return Q.zone_violations(people(spark, sf), "age", R.Rules().zone("age"))


@query("p7_segments", P + f""" SELECT concat(CASE WHEN {HIGH_SQL} THEN 'High & ' ELSE 'Std & ' END,
  CASE WHEN coalesce(gain > 0, false) THEN 'Has CapGain' ELSE 'No CapGain' END) AS segment, count(*) AS n
  FROM (SELECT income, CASE WHEN fnlwgt % 7 = 0 THEN NULL ELSE capital_gain END AS gain FROM people) GROUP BY 1""")
def p7(spark, sf):
    p = people(spark, sf).withColumn("gain", F.when(F.col("fnlwgt") % 7 != 0, F.col("capital_gain")))
    return p.groupBy(E.segment(is_target(F.col("income")), F.col("gain")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_gender_normaliser", P + """ SELECT lower(trim(s)) AS gender, count(*) AS n FROM (
  SELECT CASE WHEN fnlwgt % 5 = 0 THEN concat(' ', sex, '  ') ELSE sex END AS s FROM people) GROUP BY 1""")
def p8(spark, sf):
    p = people(spark, sf).select(F.expr("CASE WHEN fnlwgt % 5 = 0 THEN concat(' ', sex, '  ') ELSE sex END").alias("s"))
    return p.groupBy(gender(F.col("s")).alias("gender")).agg(F.count(F.lit(1)).alias("n"))


@query("p9_first_integer", P + f""", {binned_sql()} SELECT {lab('age')} AS label,
  coalesce(TRY_CAST(regexp_extract({lab('age')}, '(\\d+)', 1) AS INTEGER), 0) AS first_number, count(*) AS n FROM b GROUP BY 1, 2""")
def p9(spark, sf):
    b = X.bin_and_group(people(spark, sf))
    return b.groupBy(label(F.col("age")).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        "label", F.coalesce(first_int(F.col("label")), F.lit(0)).alias("first_number"), "n")


# --- lookups -----------------------------------------------------------------------------------------------------

@query("j1_dictionary_lookup", P + f""" SELECT before, after, count(*) AS n FROM (
  SELECT native_country AS before, {group_sql('native_country', R.GROUPS['native_country'])} AS after FROM people) GROUP BY 1, 2""")
def j1(spark, sf):
    p = people(spark, sf).select(F.col("native_country").alias("before"), "native_country")
    return X.bin_and_group(p, bins=False).groupBy("before", F.col("native_country").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("j2_outer_rate_alignment", P + f""", {binned_sql()}, m AS (SELECT {lab('occupation')} AS label, avg(CAST(hi AS INT)) AS r
  FROM b WHERE lower(sex) = 'male' GROUP BY 1),
  f AS (SELECT {lab('occupation')} AS label, avg(CAST(hi AS INT)) AS r FROM b WHERE lower(sex) = 'female' GROUP BY 1)
  SELECT coalesce(m.label, f.label) AS label, {rd('coalesce(m.r, 0)')} AS male_rate, {rd('coalesce(f.r, 0)')} AS female_rate
  FROM m FULL JOIN f ON m.label = f.label""")
def j2(spark, sf):
    b = X.bin_and_group(people(spark, sf))
    rates = E.gender_rates(b, F.col("occupation"), F.col("sex"), is_target(F.col("income")))
    return rounded(rates.select("label", "male_rate", "female_rate"))


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("j3_stats_to_rows", f"""WITH {number_stats('lineitem', LI)} SELECT l.col AS "column", {big(f'sum(CAST({OUTLIER_SQL} AS INT))')} AS outliers
  FROM nlong l JOIN st ON l.col = st.col GROUP BY 1""")
def j3(spark, sf):
    found = O.outlier_counts(table(spark, sf, "lineitem").select(*LI))
    return small_frame(spark, "column string, outliers bigint", [(c, r["raw"]) for c, r in found.items()])


@query("j4_rate_count_alignment", P + f""", {binned_sql()} SELECT {lab('relationship')} AS "row", {lab('sex')} AS col, count(*) AS n,
  {rd('avg(CAST(hi AS INT))')} AS rate FROM b GROUP BY 1, 2 HAVING count(*) >= 30""")
def j4(spark, sf):
    b = X.bin_and_group(people(spark, sf))
    cells = E.rate_cells(b, F.col("relationship"), F.col("sex"), is_target(F.col("income")))
    return rounded(cells.where(F.col("n") >= R.MIN_CELL_ROWS))


@query("parse_number_cells", P + """ SELECT badge_no AS value, TRY_CAST(badge_no AS DOUBLE) AS parsed, count(*) AS n
  FROM people GROUP BY 1, 2""")
def parse_cells(spark, sf):
    p = people(spark, sf)
    return p.groupBy(F.col("badge_no").alias("value"), parse_number(col("badge_no")).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


