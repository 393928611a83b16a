"""Audit (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.people import NUMERIC, people
from catalog.registry import (
    OUTLIER_SQL, P, ZONES_SQL, big, noise_sql, number_long, number_stats, pct, query, rd, rounded, table, text_long,
)
from catalog.statistics import ALL, DOM, DUPES, GAPS, LI
from peoplelens.functions.frames import small_frame
from peoplelens.operators import audit as Q
from peoplelens.operators import cleaning as C
from peoplelens.operators import outliers as O
from peoplelens.operators.frequency import text_frequency
from peoplelens.operators.profile import fit_profiles
from peoplelens.operators.state import AuditState
from peoplelens.session import compiled_methods, new_folder

NOISY = f"noisy AS (SELECT * FROM tf WHERE {noise_sql('v')})"


@query("q1_noise_report", P + f""", {text_long()}, {NOISY}, r AS (
  SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS rn FROM noisy)
  SELECT n.col AS "column", {big('n.total')} AS noise_count, e.examples FROM (SELECT col, sum(n) AS total FROM noisy GROUP BY col) n
  JOIN (SELECT col, string_agg(v, ', ' ORDER BY v) AS examples FROM r WHERE rn <= 5 GROUP BY col) e ON n.col = e.col""")
def q1(spark, sf):
    return C.noise_report(people(spark, sf))


def _variants(name, key, issue, detail):
    return f"""{name}k AS (SELECT col, {key} AS k, v, n, row_number() OVER (PARTITION BY col, {key} ORDER BY n DESC, v) AS rn,
      count(*) OVER (PARTITION BY col, {key}) AS variants FROM tf),
    {name} AS (SELECT col, '{issue}' AS issue, {detail} AS detail, {big('sum(n)')} AS cnt
      FROM (SELECT *, row_number() OVER (PARTITION BY col, k ORDER BY v) AS vn FROM {name}k WHERE variants > 1 AND rn > 1)
      GROUP BY col, k)"""


CASING = _variants("casing", "lower(trim(v))", "Mixed Casing", "string_agg(v, ' | ' ORDER BY v)")
SPACES = _variants("spaces", "trim(v)", "Leading/Trailing Whitespace",
                   "string_agg('''' || v || '''', ' | ' ORDER BY v) FILTER (vn <= 5)")
SINGLES = f"""singles AS (SELECT col, 'Rare Singletons' AS issue,
    (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM tf s WHERE s.col = t.col AND s.n = 1 ORDER BY v LIMIT 5)) AS detail,
    {big('sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)')} AS cnt FROM tf t GROUP BY col
  HAVING count(*) < 50 AND sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) BETWEEN 1 AND 10 AND sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) < count(*) * 0.3)"""
UNITS = f"""u0 AS (SELECT col, regexp_extract(lower(trim(v)), '^[0-9.,]+\\s*([a-zA-Z/]+)$', 1) AS unit, n FROM tf),
  u1 AS (SELECT col, unit, sum(n) AS n FROM u0 WHERE unit <> '' GROUP BY 1, 2),
  u2 AS (SELECT col, unit, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, unit) AS rn, count(*) OVER (PARTITION BY col) AS units FROM u1),
  units AS (SELECT col, 'Mixed Units' AS issue, string_agg(unit, ' | ' ORDER BY n DESC, unit) AS detail, {big('sum(n)')} AS cnt
    FROM u2 WHERE rn > 1 AND units BETWEEN 2 AND 5 GROUP BY col
    HAVING CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM tf WHERE tf.col = u2.col) < 0.3)"""
DATES = f"""d0 AS (SELECT col, v, n, coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%d/%m/%Y'),
    try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%Y/%m/%d')) IS NULL AS bad FROM tf WHERE regexp_matches(lower(col), 'date|time|dob|created|updated')),
  d1 AS (SELECT *, row_number() OVER (PARTITION BY col, bad ORDER BY v) AS rn FROM d0),
  dates AS (SELECT col, 'Date Format Issues' AS issue, string_agg('''' || v || '''', ' | ' ORDER BY v) FILTER (bad AND rn <= 3) AS detail,
    {big('sum(CASE WHEN bad THEN n ELSE 0 END)')} AS cnt FROM d1 GROUP BY col
    HAVING sum(CASE WHEN bad THEN n ELSE 0 END) > 0 AND sum(CASE WHEN bad THEN n ELSE 0 END) < sum(n))"""
CHECKS = ", ".join((CASING, SPACES, SINGLES, UNITS, DATES))
PICK = 'SELECT col AS "column", issue, detail, cnt AS "count" FROM '
ISSUES = " UNION ALL ".join(PICK + n for n in ("casing", "spaces", "singles", "units", "dates"))


@query("q2_mixed_casing", P + f", {text_long()}, {CASING} {PICK} casing")
def q2(spark, sf):
    return Q.mixed_casing(text_frequency(people(spark, sf)))


@query("q3_whitespace_variants", P + f", {text_long()}, {SPACES} {PICK} spaces")
def q3(spark, sf):
    return Q.whitespace_variants(text_frequency(people(spark, sf)))


@query("q4_rare_singletons", P + f", {text_long()}, {SINGLES} {PICK} singles")
def q4(spark, sf):
    return Q.rare_singletons(text_frequency(people(spark, sf)))


@query("q5_mixed_units", P + f", {text_long()}, {UNITS} {PICK} units")
def q5(spark, sf):
    return Q.mixed_units(text_frequency(people(spark, sf)))


@query("q6_date_formats", P + f", {text_long()}, {DATES} {PICK} dates")
def q6(spark, sf):
    return Q.date_issues(text_frequency(people(spark, sf)))


@query("q7_consistency_report", P + f", {text_long()}, {CHECKS} {ISSUES}")
def q7(spark, sf):
    return Q.consistency(people(spark, sf))


ZONE_BAD = f"""{number_long()}, {ZONES_SQL}, bad AS (SELECT l.col, l.v, z.zmin, z.zmax, count(*) AS n FROM nlong l JOIN zones z ON l.col = z.col
  WHERE l.v < z.zmin OR l.v > z.zmax GROUP BY ALL)"""


@query("q9_safe_zone_validation", P + f""", {ZONE_BAD}, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS rn FROM bad)
  SELECT col AS "column", zmin AS safe_min, zmax AS safe_max, {big('sum(n)')} AS violations,
  string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FILTER (rn <= 5) AS examples FROM r GROUP BY 1, 2, 3""")
def q9(spark, sf):
    return Q.safe_zone_report(people(spark, sf))


METHODS = """SELECT col AS "column", method, coalesce(skew, 0.0) AS skewness, fallback, zero_spread FROM st"""


@query("q10_outlier_method", P + f", {number_stats()} {METHODS}")
def q10(spark, sf):
    return O.method_table(people(spark, sf))


@query("q10_outlier_method_lineitem", f"WITH {number_stats('lineitem', LI)} {METHODS}")
def q10_lineitem(spark, sf):
    return O.method_table(table(spark, sf, "lineitem").select(*LI))


@query("q11_default_threshold", P + f""", {number_stats()} SELECT col AS "column", CASE method WHEN 'IQR' THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END AS threshold FROM st""")
def q11(spark, sf):
    chosen = {c: O.choose_method(p).method for c, p in fit_profiles(people(spark, sf)).items()}
    return small_frame(spark, "column string, threshold double", [(c, O.default_threshold(m)) for c, m in chosen.items()])


def _scored(source, c, columns, score, test):
    return f"""{number_stats(source, [c])} SELECT {columns}, round({score}, 2) AS severity FROM {source} s, st
      WHERE s.{c} IS NOT NULL AND {test}"""


@query("q12_iqr_outliers", P + ", " + _scored(
    "people", "age", "s.*", "CASE WHEN age < q1 - 1.5 * iqr THEN (q1 - 1.5 * iqr - age) / iqr ELSE (age - (q3 + 1.5 * iqr)) / iqr END",
    "iqr > 0 AND (age < q1 - 1.5 * iqr OR age > q3 + 1.5 * iqr)"))
def q12(spark, sf):
    return O.scored_outliers(people(spark, sf), "age", O.IQR)


@query("q13_zscore_outliers", "WITH " + _scored(
    "events", "value", "s.event_id, s.value", "abs((value - mean) / sd)", "sd > 0 AND abs((value - mean) / sd) > 3.0"))
def q13(spark, sf):
    return O.scored_outliers(table(spark, sf, "events").select("event_id", "value"), "value", O.Z)


@query("q14_modified_zscore_outliers", "WITH " + _scored(
    "events", "value", "s.event_id, s.value", "abs(0.6745 * (value - med) / mad)", "mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.0"))
def q14(spark, sf):
    return O.scored_outliers(table(spark, sf, "events").select("event_id", "value"), "value", O.MODIFIED_Z)


@query("q15_risk_records", "WITH " + _scored(
    "events", "value", "s.event_id, s.value", "abs(0.6745 * (value - med) / mad)", "mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.0")
       + " ORDER BY severity DESC, value, event_id LIMIT 200")
def q15(spark, sf):
    return O.risk_records(table(spark, sf, "events").select("event_id", "value"), "value", O.MODIFIED_Z, max_rows=200)


COUNTS = f"""cn AS (SELECT l.col, sum(CAST({OUTLIER_SQL} AS INT)) AS raw,
   sum(CASE WHEN {OUTLIER_SQL} AND (z.col IS NULL OR l.v < z.zmin OR l.v > z.zmax) THEN 1 ELSE 0 END) AS actual,
   sum(CASE WHEN l.v < st.q1 - 3.0 * st.iqr OR l.v > st.q3 + 3.0 * st.iqr THEN 1 ELSE 0 END) AS extreme, count(z.col) > 0 AS zoned
   FROM nlong l JOIN st ON l.col = st.col LEFT JOIN zones z ON z.col = l.col GROUP BY l.col)"""
OUTLIERS = f"{number_stats()}, {ZONES_SQL}, {COUNTS}"


@query("q16_outlier_inspector", P + f""", {OUTLIERS} SELECT st.col AS "column", method, zero_spread,
  CASE method WHEN 'IQR' THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END AS threshold, {rd('q1', 4)} AS q1, {rd('med', 4)} AS median, {rd('q3', 4)} AS q3,
  {rd('mad', 4)} AS mad, {rd('mean', 4)} AS mean, {rd('sd', 4)} AS std, {rd('lower_limit', 4)} AS lower_limit, {rd('upper_limit', 4)} AS upper_limit,
  {big('raw')} AS outliers FROM st JOIN cn ON st.col = cn.col""")
def q16(spark, sf):
    return rounded(O.inspect(people(spark, sf)), 4)


MODE_CTE = """md AS (SELECT col, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn FROM tf) WHERE rn = 1)"""


@query("q17_data_summary", P + f""", {text_long()}, {MODE_CTE}, {NOISY}, nz AS (SELECT col, sum(n) AS noise FROM noisy GROUP BY col), {OUTLIERS},
  base AS ({" UNION ALL ".join(f'''SELECT '{c}' AS col, '{'bigint' if c in NUMERIC else 'string'}' AS type, count({c}) AS records,
    {pct(f"(count(*) - count({c}))", "count(*)")} AS missing_pct, count(DISTINCT {c}) AS unique_values FROM people''' for c in ALL)})
  SELECT base.col AS "column", type, records, missing_pct, unique_values, {big('coalesce(noise, 0)')} AS noise,
   CASE WHEN skew IS NULL THEN NULL WHEN abs(skew) < 0.5 THEN 'Approximately Symmetric' WHEN skew > 0 THEN 'Right Skewed' ELSE 'Left Skewed' END AS distribution,
   skew AS skewness, CASE WHEN type = 'string' THEN 'Mode' WHEN raw > 0 THEN 'Median' ELSE 'Mean' END AS central,
   {rd('CASE WHEN raw > 0 THEN med ELSE mean END', 4)} AS central_number, md.v AS central_text,
   CASE WHEN type = 'string' THEN NULL WHEN raw = 0 THEN 'None (' || method || ')' WHEN extreme > 0 THEN 'Extreme (' || method || ')'
        ELSE 'Moderate (' || method || ')' END AS outlier_label, {big('coalesce(raw, 0)')} AS outliers
  FROM base LEFT JOIN nz ON nz.col = base.col LEFT JOIN st ON st.col = base.col LEFT JOIN cn ON cn.col = base.col LEFT JOIN md ON md.col = base.col""")
def q17(spark, sf):
    return rounded(Q.data_summary(people(spark, sf)), 6, central_number=4)


TOTALS = f"""tt AS (SELECT count(*) AS rows, 19::BIGINT AS cols, {big(GAPS)} AS missing, {big('(SELECT coalesce(sum(n), 0) FROM noisy)')} AS noise,
  {big(f'(SELECT coalesce(sum("count"), 0) FROM ({ISSUES}))')} AS inconsistent, {big(DUPES)} AS duplicates FROM people)"""
FULL = P + f", {text_long()}, {NOISY}, {CHECKS}, {TOTALS}"
HEALTH = "greatest(0.0, least(100.0, (1.0 - CAST(missing + noise + inconsistent + duplicates * cols AS DOUBLE) / (rows * cols)) * 100))"


@query("q18_health_score", FULL + f" SELECT tt.*, {rd(HEALTH)} AS health_score FROM tt")
def q18(spark, sf):
    return rounded(Q.health_score(people(spark, sf)))


@query("q19_skewed_and_outlier_columns", P + f""", {OUTLIERS} SELECT st.col AS "column", abs(skew) > 1.0 AS is_skewed, raw > 0 AS has_outliers
  FROM st JOIN cn ON st.col = cn.col""")
def q19(spark, sf):
    return O.skewed_and_outlier_columns(people(spark, sf))


FLAT = number_long() + ", " + DOM.lstrip(", ") + ", flat AS (SELECT nd.col, round(CAST(top AS DOUBLE) / total * 100, 1) AS p FROM nd WHERE CAST(top AS DOUBLE) / total >= 0.8)"


@query("q20_issue_composition", FULL + f""", {FLAT}, k AS (SELECT rows * cols AS cells, rows, unnest(['Missing', 'Duplicates', 'Inconsistencies', 'Noise Values', 'Low Variance']) AS issue,
    unnest([missing, duplicates * cols, inconsistent, noise, (SELECT count(*) FROM flat) * rows]) AS affected_cells,
    missing + duplicates * cols + inconsistent + noise + (SELECT count(*) FROM flat) * rows AS total FROM tt)
  SELECT issue, affected_cells, {pct('affected_cells', 'cells')} AS pct,
   CASE WHEN affected_cells * 100.0 / cells >= 5 THEN 'critical' WHEN affected_cells * 100.0 / cells >= 2 THEN 'warning' WHEN affected_cells > 0 THEN 'info' ELSE 'ok' END AS severity,
   {pct('greatest(0, cells - total)', 'cells')} AS clean_pct FROM k""")
def q20(spark, sf):
    return rounded(Q.issue_composition(people(spark, sf)))


def _section(name, item, value, source):
    return f"SELECT '{name}' AS section, {item} AS item, CAST({value} AS DOUBLE) AS value FROM {source}"


AUDIT = FULL + f""", {OUTLIERS}, {FLAT.replace(number_long() + ', ', '')}, bad AS (SELECT l.col, count(*) AS n FROM nlong l JOIN zones z ON l.col = z.col
    WHERE l.v < z.zmin OR l.v > z.zmax GROUP BY l.col), hs AS (SELECT tt.*, {rd(HEALTH)} AS health_score FROM tt), found AS (""" + " UNION ALL ".join(
    [_section("totals", f"'{c}'", c, "hs") for c in ("rows", "cols", "missing", "noise", "inconsistent", "duplicates", "health_score")]
    + [_section("consistency", "\"column\" || ': ' || issue", "sum(\"count\")", f"({ISSUES}) GROUP BY \"column\", issue"),
       _section("noise", "col", "sum(n)", "noisy GROUP BY col"), _section("safe_zone", "col", "n", "bad"),
       _section("low_variance", "col", "p", "flat")]
    + [_section("missing", f"'{c}'", f"count(*) - count({c})", f"people HAVING count(*) > count({c})") for c in ALL]
    + [_section("skewed", "col", "1", "st WHERE abs(skew) > 1.0"), _section("outliers", "col", "1", "cn WHERE raw > 0")]) + ")"


@query("q22_full_audit", AUDIT + " SELECT * FROM found")
def q22(spark, sf):
    return rounded(Q.audit_result(people(spark, sf)))


@query("q22_audit_state", AUDIT + " SELECT * FROM found WHERE section NOT IN ('low_variance', 'outliers')")
def q22_state(spark, sf):
    """Two states of two batches each, a batch offered twice, merged: the audit of all rows."""
    # The table is computed once and laid out by batch, as batches arrive: each is read alone.
    df = people(spark, sf).withColumn("part", F.pmod(F.xxhash64("age", "fnlwgt", "team"), F.lit(4)))
    folder = new_folder(spark, "batches")
    with compiled_methods(spark):
        df.write.partitionBy("part").parquet(folder)
    batches = spark.read.schema(df.schema).parquet(folder)
    states = [AuditState(spark, new_folder(spark, "state")) for _ in range(2)]
    for i in range(4):
        for _ in range(2):
            states[i // 2].add(f"batch-{i}", batches.where(F.col("part") == i).drop("part"))
    return rounded(states[0].merged_into(new_folder(spark, "state"), states[1]).audit())


@query("a5_quantiles_from_state", "WITH " + number_stats("lineitem", LI) + """ SELECT col AS "column", """
       + ", ".join(f"{rd(x, 4)} AS {n}" for x, n in (("q1", "q1"), ("med", "median"), ("q3", "q3"))) + ", n AS filled, " + rd("mean", 4) + " AS mean, "
       + rd("sd", 4) + " AS std, coalesce(round(skew, 3), 0.0) AS skewness FROM st")
def a5_state(spark, sf):
    """Exact quartiles bracketed by the merged sketches of four batches, with the merged moments."""
    items = table(spark, sf, "lineitem")
    state = AuditState(spark, new_folder(spark, "state"))
    for i in range(4):
        state.add(f"batch-{i}", items.where(F.col("l_orderkey") % 4 == i).select(*LI))
    found = small_frame(spark, "column string, q1 double, median double, q3 double", [
        (c, *q) for c, q in state.quantiles(items.select(*LI), (0.25, 0.5, 0.75)).items()])
    moments = state.profile().select("column", (F.col("rows") - F.col("missing")).alias("filled"), "mean", "std", "skewness")
    return rounded(found.join(moments, "column"), 4, skewness=3)


@query("q21_key_issues", AUDIT + """, k(position, severity, kind) AS (VALUES (1, 'orange', 'missing'), (2, 'orange', 'noise'), (3, 'yellow', 'skewed'),
   (4, 'red', 'duplicates'), (5, 'orange', 'outliers'), (6, 'red', 'inconsistent'), (7, 'yellow', 'low_variance'))
  SELECT position, severity, kind, CASE WHEN kind IN ('duplicates', 'inconsistent') THEN '' ELSE string_agg(item, ', ' ORDER BY item) END AS columns,
   CAST(sum(CASE WHEN kind IN ('skewed', 'outliers', 'low_variance') THEN 1 ELSE value END) AS BIGINT) AS count
  FROM k JOIN found ON (section = kind) OR (section = 'totals' AND item = kind AND kind IN ('duplicates', 'inconsistent')) WHERE value > 0 GROUP BY 1, 2, 3""")
def q21(spark, sf):
    return Q.key_issues(people(spark, sf))


NOISE_NAMES = "(SELECT string_agg(col || ' (' || n || ')', ', ' ORDER BY p) FROM (SELECT * FROM nc ORDER BY p LIMIT 5))"
NOISE_COUNTS = f"""nc AS (SELECT col, {big('sum(n)')} AS n, CASE col {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(ALL))} END AS p
  FROM noisy GROUP BY col)"""


@query("q23_integrity_block", P + f""", {text_long()}, {NOISY}, {NOISE_COUNTS} SELECT {big(GAPS)} AS missing_total, {pct(f'({GAPS})', '(count(*) * 19)')} AS missing_pct,
  {big(DUPES)} AS duplicate_rows, {big('(SELECT sum(n) FROM nc)')} AS noise_count, {pct('(SELECT sum(n) FROM nc)', 'count(*)')} AS noise_pct,
  {NOISE_NAMES} AS noise_columns FROM people""")
def q23(spark, sf):
    return rounded(Q.integrity(people(spark, sf)))


