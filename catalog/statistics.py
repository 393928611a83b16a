"""Statistics (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.people import NUMERIC, TEXT, people
from catalog.registry import (
    HIGH_SQL, P, big, in_unpivot, lab, number_long, number_stats, pct, query, rd, rounded, table, text_long,
)
from peoplelens.functions.expr import is_target
from peoplelens.operators import audit as Q
from peoplelens.operators import cleaning as C
from peoplelens.operators import frequency as V
from peoplelens.operators import outliers as O
from peoplelens.operators import profile as S

ALL = [*NUMERIC, *TEXT]
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPS = " + ".join(f"count(*) - count({c})" for c in ALL)
DUPES = "(SELECT count(*) FROM people) - (SELECT count(*) FROM (SELECT DISTINCT * FROM people))"


@query("a1_dataset_metrics", P + f""" SELECT count(*) AS rows, 19::BIGINT AS cols, {big(DUPES)} AS duplicates,
  {big(GAPS)} AS missing_cells, {pct(f'({GAPS})', '(count(*) * 19)')} AS missing_pct FROM people""")
def a1(spark, sf):
    return rounded(Q.dataset_metrics(people(spark, sf)))


@query("a1_source_bytes", "SELECT 1::BIGINT AS files, true AS has_bytes, count(*) AS rows FROM lineitem")
def a1_bytes(spark, sf):
    """Bytes depend on the writer; that they are exact is a test's matter."""
    lines = table(spark, sf, "lineitem")
    size = Q.source_bytes(lines).select("files", (F.col("bytes") > 0).alias("has_bytes"))
    return size.select("*", lines.agg(F.count(F.lit(1))).scalar().alias("rows"))


@query("a2_missing_per_column", P + f""" SELECT * FROM ({in_unpivot(ALL, lambda c:
  f'''SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {pct(f"(count(*) - count({c}))", "count(*)")} AS missing_pct FROM people''')})
  WHERE missing > 0""")
def a2(spark, sf):
    return rounded(C.missing_report(people(spark, sf)))


TYPES = {c: "bigint" for c in NUMERIC} | {c: "string" for c in TEXT}


@query("a3_column_report", P + " " + in_unpivot(ALL, lambda c: f"""SELECT '{c}' AS "column", '{TYPES[c]}' AS type,
  count(*) - count({c}) AS missing, {pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_pct,
  count(DISTINCT {c}) AS distinct_values FROM people"""))
def a3(spark, sf):
    return rounded(Q.column_report(people(spark, sf)))


def _skew_sql(source, columns):
    return f"""{number_long(source, columns)} SELECT col AS "column", CASE WHEN count(*) < 3 THEN NULL
      WHEN min(v) = max(v) THEN 0.0 ELSE {rd('skewness(v)')} END AS skewness FROM nlong GROUP BY col"""


@query("a4_adjusted_skewness", P + ", " + _skew_sql("people", NUMERIC))
def a4(spark, sf):
    return rounded(S.moments(people(spark, sf)).select("column", "skewness"))


@query("a4_adjusted_skewness_lineitem", "WITH " + _skew_sql("lineitem", LI))
def a4_lineitem(spark, sf):
    return rounded(S.moments(table(spark, sf, "lineitem"), LI).select("column", "skewness"))


QUANT = f"""SELECT col AS "column", {rd('q1', 4)} AS q1, {rd('med', 4)} AS median, {rd('q3', 4)} AS q3, {rd('iqr', 4)} AS iqr,
  {rd('mad', 4)} AS mad FROM st"""


@query("a5_quantiles_iqr_mad", P + ", " + number_stats() + QUANT)
def a5(spark, sf):
    return rounded(S.quantile_table(people(spark, sf)), 4)


@query("a5_quantiles_lineitem", "WITH " + number_stats("lineitem", LI) + QUANT)
def a5_lineitem(spark, sf):
    return rounded(S.quantile_table(table(spark, sf, "lineitem"), LI), 4)


@query("a5_quantiles_by_rank", f"""SELECT l_returnflag AS key, {rd('quantile_cont(l_extendedprice, 0.1)', 4)} AS p10,
  {rd('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50, {rd('quantile_cont(l_extendedprice, 0.99)', 4)} AS p99
  FROM lineitem GROUP BY 1""")
def a5_rank(spark, sf):
    from peoplelens.functions.quantiles import grouped_quantiles

    long = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_extendedprice").alias("value"))
    q = grouped_quantiles(long, (0.1, 0.5, 0.99))
    return rounded(q.select("key", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p10", "p50", "p99"))]), 4)


@query("a6_moments", P + f""", {number_long()} SELECT col AS "column", count(*) AS n, {rd('avg(v)', 4)} AS mean, {rd('stddev_samp(v)', 4)} AS std,
  min(v) AS min, max(v) AS max FROM nlong GROUP BY col""")
def a6(spark, sf):
    return rounded(S.moments(people(spark, sf)).select("column", "n", "mean", "std", "min", "max"), 4)


@query("a7_value_frequency", P + f""", c AS (SELECT native_country AS value, count(*) AS n FROM people WHERE native_country IS NOT NULL GROUP BY 1),
  t AS (SELECT sum(n) AS total FROM c) SELECT value, n, {pct('n', 'total')} AS pct, CAST(n AS DOUBLE) / total * 100 <= 1.0 AS rare FROM c, t""")
def a7(spark, sf):
    return rounded(V.value_counts(people(spark, sf), "native_country"))


@query("a7_value_frequency_summary", P + f""", c AS (SELECT marital_status AS value, count(*) AS n FROM people WHERE marital_status IS NOT NULL GROUP BY 1),
  t AS (SELECT sum(n) AS total FROM c) SELECT {big('sum(n)')} AS total, count(*) AS distinct_values,
  {big('sum(CASE WHEN n * 100.0 / total <= 1.0 THEN 1 ELSE 0 END)')} AS rare_values FROM c, t""")
def a7_summary(spark, sf):
    return V.value_count_summary(people(spark, sf), "marital_status")


@query("a8_top_categories", "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def a8(spark, sf):
    return V.top_values(table(spark, sf, "part"), "p_type", 15)


MODES = """SELECT col AS "column", v AS mode, n FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn FROM tf) WHERE rn = 1"""


@query("a9_mode", P + ", " + text_long() + MODES)
def a9(spark, sf):
    return V.column_modes(people(spark, sf))


DOM = """, nf AS (SELECT col, v, count(*) AS n FROM nlong GROUP BY 1, 2), nd AS (
  SELECT col, sum(n) AS total, max(n) AS top, count(*) AS d FROM nf GROUP BY col), nt AS (
  SELECT col, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn FROM nf) WHERE rn = 1)"""


@query("a10_low_variance", P + ", " + number_long() + DOM + """ SELECT nd.col AS "column", nt.v AS dominant_value,
  round(CAST(top AS DOUBLE) / total * 100, 1) AS dominant_pct, d AS distinct_values
  FROM nd JOIN nt ON nd.col = nt.col WHERE CAST(top AS DOUBLE) / total >= 0.8""")
def a10(spark, sf):
    return V.low_variance(people(spark, sf))


@query("a10_low_variance_labels", f"WITH {number_long('labels', ['quality', 'toxic'])}" + DOM + """ SELECT nd.col AS "column",
  nt.v AS dominant_value, round(CAST(top AS DOUBLE) / total * 100, 1) AS dominant_pct, d AS distinct_values
  FROM nd JOIN nt ON nd.col = nt.col WHERE CAST(top AS DOUBLE) / total >= 0.8""")
def a10_labels(spark, sf):
    return V.low_variance(table(spark, sf, "labels"), ["quality", "toxic"])


@query("a11_zero_spread_detail", P + ", " + number_stats() + DOM + f""" SELECT nd.col AS "column", nt.v AS dominant_value, top AS dominant_count,
  {pct('top', 'total')} AS dominant_pct, {big('total - top')} AS other_count, d AS distinct_values
  FROM nd JOIN nt ON nd.col = nt.col JOIN st ON st.col = nd.col WHERE st.zero_spread""")
def a11(spark, sf):
    return rounded(O.zero_spread_details(people(spark, sf)))


def _corr(x, y, source):
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (f"(SELECT CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN NULL ELSE {rd(f'corr({x}, {y})')} END "
            f"FROM {source} WHERE {both})")


@query("a12_pearson_matrix", P + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {_corr(a, b, 'people')} AS r" for a in NUMERIC for b in NUMERIC))
def a12(spark, sf):
    return rounded(S.correlations(people(spark, sf)))


@query("a13_target_correlation", P + f", t AS (SELECT *, CAST({HIGH_SQL} AS INT) AS y FROM people) " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", {_corr(a, 'y', 't')} AS r" for a in NUMERIC))
def a13(spark, sf):
    return rounded(S.target_correlations(people(spark, sf), is_target(F.col("income"))))


@query("a14_correlation_view", P + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {_corr(a, b, 'people')} AS r" for a in NUMERIC for b in NUMERIC)
    + ") SELECT x, y, CASE WHEN x <> y AND abs(r) >= 0.05 THEN r END AS r FROM m")
def a14(spark, sf):
    return rounded(S.strong_correlations(people(spark, sf), threshold=0.05))


@query("a15_duplicate_summary", P + f""", g AS (SELECT count(*) AS n FROM people GROUP BY ALL_COLUMNS) SELECT {big('sum(n)')} AS total_rows,
  count(*) FILTER (n > 1) AS duplicate_groups, {big('coalesce(sum(n) FILTER (n > 1), 0)')} AS duplicate_instances,
  {big('sum(n - 1)')} AS redundant_rows, {pct('sum(n - 1)', 'sum(n)')} AS redundant_pct, count(*) AS rows_after FROM g"""
       .replace("ALL_COLUMNS", ", ".join(ALL)))
def a15(spark, sf):
    return rounded(C.duplicate_summary(people(spark, sf)))


@query("a15_duplicate_groups", P + f" SELECT {', '.join(ALL)}, count(*) AS occurrences FROM people GROUP BY {', '.join(ALL)} HAVING count(*) > 1")
def a15_groups(spark, sf):
    return C.duplicate_groups(people(spark, sf), top=None)


def _hist(source, c, bins, by=None):
    keys = f"{lab(by)} AS grp, " if by else ""
    group = "grp, bin" if by else "bin"
    tot = "SELECT grp, count(*) AS total FROM x GROUP BY grp" if by else "SELECT count(*) AS total FROM x"
    join = "JOIN t ON c.grp = t.grp" if by else ", t"
    return f"""b AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}),
      x AS (SELECT {keys} CAST(least(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin FROM {source}, b WHERE {c} IS NOT NULL),
      c AS (SELECT {group}, count(*) AS n FROM x GROUP BY {group}), t AS ({tot})
      SELECT {'c.grp, ' if by else ''} bin, {rd(f'lo + bin * ((hi - lo) / {bins})', 4)} AS lower, {rd(f'lo + (bin + 1) * ((hi - lo) / {bins})', 4)} AS upper,
      n, {rd(f'n / (total * ((hi - lo) / {bins}))', 8)} AS density FROM c {join} CROSS JOIN b"""


@query("a16_histogram", "WITH " + _hist("events", "value", 50))
def a16(spark, sf):
    return rounded(S.histogram(table(spark, sf, "events"), "value", 50), 4, density=8)


@query("a16_histogram_by_group", P + ", " + _hist("people", "fnlwgt", 30, "income"))
def a16_group(spark, sf):
    return rounded(S.histogram(people(spark, sf), "fnlwgt", 30, "income"), 4, density=8)


@query("a17_normal_curve", f"""WITH f AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_samp(value) AS sd FROM events)
  SELECT CAST(i AS INTEGER) AS i, {rd('lo + i * (hi - lo) / 199')} AS x,
  {rd('exp(-power((lo + i * (hi - lo) / 199 - mu) / sd, 2) / 2) / (sd * sqrt(2 * pi()))', 9)} AS y FROM f, range(200) AS r(i)""")
def a17(spark, sf):
    return rounded(S.normal_curve(table(spark, sf, "events"), "value"), 6, y=9)


@query("a18_box_statistics", "WITH " + number_stats("lineitem", LI) + f""" SELECT col AS "column", {rd('lo', 4)} AS min, {rd('q1', 4)} AS q1,
  {rd('med', 4)} AS median, {rd('q3', 4)} AS q3, {rd('hi', 4)} AS max, {rd('mean', 4)} AS mean, {rd('sd', 4)} AS std,
  {rd('q1 - 1.5 * iqr', 4)} AS lower_limit, {rd('q3 + 1.5 * iqr', 4)} AS upper_limit FROM st""")
def a18(spark, sf):
    return rounded(O.box_table(table(spark, sf, "lineitem"), LI), 4)


@query("a18_box_statistics_zscore", P + ", " + number_stats() + f""" SELECT col AS "column", {rd('lo', 4)} AS min, {rd('q1', 4)} AS q1,
  {rd('med', 4)} AS median, {rd('q3', 4)} AS q3, {rd('hi', 4)} AS max, {rd('mean', 4)} AS mean, {rd('sd', 4)} AS std,
  {rd('mean - 3 * sd', 4)} AS lower_limit, {rd('mean + 3 * sd', 4)} AS upper_limit FROM st""")
def a18_z(spark, sf):
    return rounded(O.box_table(people(spark, sf), method=O.Z), 4)


@query("a19_violin_by_group", f"""SELECT l_returnflag AS grp, count(l_quantity) AS n, min(l_quantity) AS min, {rd('quantile_cont(l_quantity, 0.25)')} AS q1,
  {rd('quantile_cont(l_quantity, 0.5)')} AS median, {rd('quantile_cont(l_quantity, 0.75)')} AS q3, max(l_quantity) AS max,
  {rd('avg(l_quantity)')} AS mean, {rd('stddev_samp(l_quantity)')} AS std FROM lineitem GROUP BY 1""")
def a19(spark, sf):
    return rounded(S.grouped_box(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"))


@query("a20_hierarchy", P + f""", b AS (SELECT {lab('sex')} AS l0, {lab('workclass')} AS l1, {lab('income')} AS l2 FROM people),
  n0 AS (SELECT count(*) AS n FROM b), n1 AS (SELECT l0, count(*) AS n FROM b GROUP BY l0),
  n2 AS (SELECT l0, l1, count(*) AS n FROM b GROUP BY l0, l1), n3 AS (SELECT l0, l1, l2, count(*) AS n FROM b GROUP BY l0, l1, l2)
  SELECT 1 AS level, n1.l0, CAST(NULL AS VARCHAR) AS l1, CAST(NULL AS VARCHAR) AS l2, n1.n, {rd('CAST(n1.n AS DOUBLE) / n0.n')} AS parent_share FROM n1, n0
  UNION ALL SELECT 2, n2.l0, n2.l1, NULL, n2.n, {rd('CAST(n2.n AS DOUBLE) / n1.n')} FROM n2 JOIN n1 ON n2.l0 = n1.l0
  UNION ALL SELECT 3, n3.l0, n3.l1, n3.l2, n3.n, {rd('CAST(n3.n AS DOUBLE) / n2.n')} FROM n3 JOIN n2 ON n3.l0 = n2.l0 AND n3.l1 = n2.l1""")
def a20(spark, sf):
    return rounded(V.hierarchy(people(spark, sf), ["sex", "workclass", "income"]))


@query("a21_scatter", P + f""" SELECT CAST(age AS DOUBLE) AS x, CAST(hours_per_week AS DOUBLE) AS y, {lab('income')} AS hue
  FROM people WHERE age IS NOT NULL AND hours_per_week IS NOT NULL""")
def a21(spark, sf):
    return S.scatter_sample(people(spark, sf), "age", "hours_per_week", "income")


@query("a7_value_frequency_documents", f"""WITH c AS (SELECT text AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS total FROM c)
  SELECT value, n, {pct('n', 'total')} AS pct, CAST(n AS DOUBLE) / total * 100 <= 1.0 AS rare FROM c, t""")
def a7_documents(spark, sf):
    return rounded(V.value_counts(table(spark, sf, "documents"), "text"))


@query("a15_duplicate_summary_documents", f"""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang) SELECT {big('sum(n)')} AS total_rows,
  count(*) FILTER (n > 1) AS duplicate_groups, {big('coalesce(sum(n) FILTER (n > 1), 0)')} AS duplicate_instances,
  {big('sum(n - 1)')} AS redundant_rows, {pct('sum(n - 1)', 'sum(n)')} AS redundant_pct, count(*) AS rows_after FROM g""")
def a15_documents(spark, sf):
    return rounded(C.duplicate_summary(table(spark, sf, "documents").select("text", "lang")))


@query("a19_grouped_density", P + f""", b AS (SELECT {lab('income')} AS grp, CAST(age AS DOUBLE) AS v FROM people WHERE age IS NOT NULL),
  e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 63 AS step FROM b), s AS (SELECT grp, least(CAST(floor((v - lo) / step) AS INTEGER), 62) AS j, (v - lo) / step AS p FROM b, e),
  w AS (SELECT grp, j, sum(w) AS w FROM (SELECT grp, j, 1 - (p - j) AS w FROM s UNION ALL SELECT grp, j + 1, p - j FROM s) GROUP BY grp, j),
  g AS (SELECT grp, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM b GROUP BY grp),
  i AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)
  SELECT grp, i, {rd('any_value(lo) + i * any_value(step)')} AS x, {rd('sum(w * exp(-pow((i - j) * step / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density
  FROM w JOIN g USING (grp), e, i GROUP BY grp, i""")
def a19_density(spark, sf):
    return rounded(S.grouped_density(people(spark, sf), "age", "income"))


@query("a21_binned_scatter", f"""WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, l_returnflag AS hue FROM lineitem),
  e AS (SELECT min(x) AS x0, (max(x) - min(x)) / 40 AS dx, min(y) AS y0, (max(y) - min(y)) / 40 AS dy FROM b WHERE x IS NOT NULL AND y IS NOT NULL),
  c AS (SELECT least(CAST(floor((x - x0) / dx) AS INTEGER), 39) AS x_bin, least(CAST(floor((y - y0) / dy) AS INTEGER), 39) AS y_bin, {lab('hue')} AS hue, count(*) AS n
        FROM b, e WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)
  SELECT x_bin, y_bin, hue, {rd('x0 + (x_bin + 0.5) * dx')} AS x, {rd('y0 + (y_bin + 0.5) * dy')} AS y, n FROM c, e""")
def a21_bins(spark, sf):
    return rounded(S.binned_scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))
