"""Exploration (E) and insights (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.audit import CHECKS, HEALTH, NOISE_COUNTS, NOISE_NAMES, NOISY, OUTLIERS, TOTALS
from catalog.people import TEXT, people
from catalog.registry import (
    HIGH_SQL, ORACLES, P, big, binned_sql, lab, pct, query, rd, rounded, table, text_long,
)
from catalog.statistics import ALL, DUPES, GAPS
from peoplelens.functions.expr import is_target, number, to_number
from peoplelens.operators import association as A
from peoplelens.operators import exploration as E
from peoplelens.operators import features as X
from peoplelens.operators import insights as N
from peoplelens.plans import dashboard as D

B = P + ", " + binned_sql()
C = F.col


def high():
    return is_target(C("income"))


def binned(spark, sf):
    """Binned table with raw age, hours, gain and the target flag beside it, as in the SQL."""
    p = people(spark, sf)
    return X.bin_and_group(p.select("*", C("age").alias("raw_age"), C("hours_per_week").alias("raw_hours"),
                                    C("capital_gain").alias("gain"), high().alias("hi")))


# --- association -------------------------------------------------------------------------------------------------

def _chi_sql(source, a, b, name="x"):
    """χ² over the dense grid of both fields' labels, with Yates' correction for 2×2."""
    return f"""{name}0 AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
   {name}r AS (SELECT a, count(*) AS rn FROM {name}0 GROUP BY a), {name}c AS (SELECT b, count(*) AS cn FROM {name}0 GROUP BY b),
   {name}t AS (SELECT (SELECT count(*) FROM {name}0) AS n, (SELECT count(*) FROM {name}r) AS r, (SELECT count(*) FROM {name}c) AS c),
   {name}o AS (SELECT a, b, count(*) AS o FROM {name}0 GROUP BY a, b),
   {name}g AS (SELECT coalesce(o, 0) AS o, CAST(rn AS DOUBLE) * cn / n AS e, n, r, c FROM {name}r CROSS JOIN {name}c CROSS JOIN {name}t
      LEFT JOIN {name}o ON {name}o.a = {name}r.a AND {name}o.b = {name}c.b),
   {name} AS (SELECT any_value(n) AS n, any_value(r) AS r, any_value(c) AS c,
      sum(CASE WHEN r = 2 AND c = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2 FROM {name}g)"""


def _v(name="x"):
    return f"CASE WHEN {name}.r < 2 OR {name}.c < 2 THEN 0.0 ELSE sqrt({name}.chi2 / ({name}.n * (least({name}.r, {name}.c) - 1))) END"


def _v_select(name="x"):
    return f"SELECT n, r, c, {rd('chi2', 4)} AS chi2, {rd(_v(name))} AS v FROM {name}"


@query("e1_cramers_v", P + ", " + _chi_sql("people", "education", "occupation") + _v_select())
def e1(spark, sf):
    return rounded(A.cramers_v(people(spark, sf), C("education"), C("occupation")), 6, chi2=4)


@query("e1_cramers_v_two_by_two", "WITH l AS (SELECT l_linestatus, l_quantity > 25 AS large FROM lineitem), "
       + _chi_sql("l", "l_linestatus", "large") + _v_select())
def e1_yates(spark, sf):
    return rounded(A.cramers_v(table(spark, sf, "lineitem"), C("l_linestatus"), C("l_quantity") > 25), 6, chi2=4)


@query("e2_bias_corrected_v", P + ", " + _chi_sql("people", "education", "occupation") + f""" SELECT n, r, c, {rd('chi2', 4)} AS chi2,
  {rd('''sqrt(greatest(0, chi2 / n - CAST((r - 1) * (c - 1) AS DOUBLE) / (n - 1)) / (least(r - CAST((r - 1) * (r - 1) AS DOUBLE) / (n - 1),
    c - CAST((c - 1) * (c - 1) AS DOUBLE) / (n - 1)) - 1))''')} AS v_corrected FROM x""")
def e2(spark, sf):
    return rounded(A.corrected_v(people(spark, sf), C("education"), C("occupation")), 6, chi2=4)


@query("e3_point_biserial", P + f", t AS (SELECT age, CAST({HIGH_SQL} AS INT) AS y FROM people WHERE age IS NOT NULL) SELECT count(*) AS n, {rd('corr(age, y)')} AS r FROM t")
def e3(spark, sf):
    p = people(spark, sf)
    return rounded(A.point_biserial(p, number(p, "age"), high()))


MINIMUM = 0.02
ASSOC_TEXT = [c for c in [*TEXT, "age", "hours_per_week", "capital_gain", "capital_loss"] if c != "income"]
ASSOC_NUM = ["fnlwgt", "education_num"]
ASSOC = ", ".join([_chi_sql("b", c, "hi", f"x_{c}") for c in ASSOC_TEXT]) + ", sc AS (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS attribute, {_v('x_' + c)} AS association, 'Cramér''s V' AS method FROM x_{c}" for c in ASSOC_TEXT]
    + [f"SELECT '{c}', abs(corr({c}, CAST(hi AS INT))), 'Point-Biserial' FROM b" for c in ASSOC_NUM]) + ")"


@query("e4_association_ranking", B + ", " + ASSOC + f" SELECT attribute, {rd('association')} AS association, method FROM sc WHERE association >= {MINIMUM}")
def e4(spark, sf):
    return rounded(A.association_scores(X.bin_and_group(people(spark, sf)), "income", MINIMUM))


@query("e5_kpi_header", P + f""", t AS (SELECT *, {HIGH_SQL} AS hi, lower(trim(sex)) AS g FROM people) SELECT count(*) AS total, count(*) FILTER (hi) AS n_high,
  count(*) FILTER (NOT hi) AS n_std, {pct('count(*) FILTER (hi)', 'count(*)')} AS pct_high, count(*) FILTER (g = 'male') AS male_n,
  count(*) FILTER (g = 'female') AS female_n, {pct("count(*) FILTER (g = 'male')", "count(*) FILTER (g IN ('male', 'female'))")} AS pct_male,
  {pct("count(*) FILTER (g = 'female')", "count(*) FILTER (g IN ('male', 'female'))")} AS pct_female, {rd('avg(hours_per_week)')} AS avg_hours,
  {pct('count(*) FILTER (hours_per_week > 40)', 'count(hours_per_week)')} AS pct_overtime, {rd('avg(age) FILTER (hi) - avg(age) FILTER (NOT hi)')} AS age_gap,
  19::BIGINT AS n_cols, CAST(floor(quantile_cont(age, 0.5)) AS BIGINT) AS median_age, CAST(floor(quantile_cont(age, 0.25)) AS BIGINT) AS q1_age,
  CAST(floor(quantile_cont(age, 0.75)) AS BIGINT) AS q3_age FROM t""")
def e5(spark, sf):
    p = people(spark, sf)
    return rounded(E.kpis(p, high(), to_number(p, "age"), C("sex"), to_number(p, "hours_per_week")))


@query("e6_target_split", f"""WITH t AS (SELECT o_orderstatus = 'F' AS hi FROM orders) SELECT count(*) AS total, count(*) FILTER (hi) AS n_high, count(*) FILTER (NOT hi) AS n_std,
  {pct('count(*) FILTER (hi)', 'count(*)')} AS pct_high, {pct('count(*) FILTER (NOT hi)', 'count(*)')} AS pct_std,
  {rd('CAST(count(*) FILTER (NOT hi) AS DOUBLE) / greatest(count(*) FILTER (hi), 1)')} AS ratio FROM t""")
def e6(spark, sf):
    return rounded(E.target_split(table(spark, sf, "orders"), C("o_orderstatus") == "F"))


RATES = f"SELECT {lab('occupation')} AS label, count(*) AS n, avg(CAST(hi AS INT)) AS rate FROM b GROUP BY 1"


@query("e7_target_rate_by_category", B + f" SELECT label, n, {rd('rate')} AS rate FROM ({RATES})")
def e7(spark, sf):
    return rounded(E.rate_by(binned(spark, sf), C("occupation"), C("hi")))


@query("e7_target_rate_by_segment", f"""SELECT coalesce(c_mktsegment, 'nan') AS label, count(*) AS n, {rd("avg(CAST(o_orderpriority = '1-URGENT' AS INT))")} AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def e7_join(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), C("o_custkey") == C("c_custkey"))
    return rounded(E.rate_by(joined, C("c_mktsegment"), C("o_orderpriority") == "1-URGENT"))


@query("e7_target_rate_top_groups", P + f" SELECT native_country AS label, count(*) AS n, {rd(f'avg(CAST({HIGH_SQL} AS INT))')} AS rate FROM people "
       "WHERE native_country IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 3")
def e7_top(spark, sf):
    return rounded(E.rate_by(people(spark, sf), C("native_country"), high(), top=3))


def _best(source, value="rate", name="label"):
    return (f"(SELECT {name} FROM {source} ORDER BY {value} DESC, {name} LIMIT 1)", f"(SELECT {name} FROM {source} ORDER BY {value}, {name} LIMIT 1)")


@query("e8_best_and_worst", B + f""", r AS ({RATES}) SELECT {_best('r')[0]} AS best, {rd('max(rate) * 100')} AS best_pct, {_best('r')[1]} AS worst,
  {rd('min(rate) * 100')} AS worst_pct, {rd('(max(rate) - min(rate)) * 100')} AS gap FROM r""")
def e8(spark, sf):
    return rounded(E.best_and_worst(E.rate_by(binned(spark, sf), C("occupation"), C("hi"))))


@query("e9_top_feature_breakdown", B + ", " + ASSOC + f""", tops AS (SELECT attribute, association FROM sc WHERE association >= 0.2 ORDER BY association DESC, attribute LIMIT 4),
  r AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {lab(c)} AS label, avg(CAST(hi AS INT)) AS rate FROM b GROUP BY 2" for c in [*ASSOC_TEXT, *ASSOC_NUM])}),
  k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rate DESC, label) AS up, row_number() OVER (PARTITION BY feature ORDER BY rate, label) AS down FROM r)
  SELECT feature, {rd('any_value(association)')} AS association, max(label) FILTER (up = 1) AS best, {rd('max(rate) * 100')} AS best_pct,
  max(label) FILTER (down = 1) AS worst, {rd('min(rate) * 100')} AS worst_pct, {rd('(max(rate) - min(rate)) * 100')} AS gap
  FROM k JOIN tops ON feature = attribute GROUP BY feature""")
def e9(spark, sf):
    return rounded(E.top_feature_breakdown(X.bin_and_group(people(spark, sf)), "income", high()))


# --- cross-tabs ----------------------------------------------------------------------------------------------------

def _cells(r, c, extra=""):
    return f'SELECT {lab(r)} AS "row", {lab(c)} AS col, count(*) AS n, avg(CAST(hi AS INT)) AS rate FROM b {extra} GROUP BY 1, 2'


@query("e10_rate_cross_tab", B + f', cl AS ({_cells("native_country", "occupation")}) SELECT "row", col, n, {rd("rate")} AS rate FROM cl')
def e10(spark, sf):
    return rounded(E.rate_grid(binned(spark, sf), C("native_country"), C("occupation"), C("hi")))


@query("e10_rate_cross_tab_dense", B + f""", cl AS ({_cells("native_country", "occupation")})
  SELECT r."row", c.col, coalesce(cl.n, 0) AS n, coalesce({rd("cl.rate")}, 0.0) AS rate FROM (SELECT DISTINCT "row" FROM cl) r CROSS JOIN (SELECT DISTINCT col FROM cl) c
  LEFT JOIN cl ON cl."row" = r."row" AND cl.col = c.col""")
def e10_dense(spark, sf):
    return rounded(E.dense(E.rate_grid(binned(spark, sf), C("native_country"), C("occupation"), C("hi"))))


def _extremes(source):
    order = "\"row\", col LIMIT 1)"
    return f"""SELECT (SELECT "row" FROM {source} ORDER BY rate DESC, {order} AS best_row, (SELECT col FROM {source} ORDER BY rate DESC, {order} AS best_col,
      {rd('max(rate) * 100')} AS best_pct, (SELECT "row" FROM {source} ORDER BY rate, {order} AS worst_row, (SELECT col FROM {source} ORDER BY rate, {order} AS worst_col,
      {rd('min(rate) * 100')} AS worst_pct, {rd('(max(rate) - min(rate)) * 100')} AS gap FROM {source}"""


@query("e11_best_worst_cell_min_sample", B + f", cl AS ({_cells('relationship', 'sex')} HAVING count(*) >= 30) {_extremes('cl')}")
def e11(spark, sf):
    return rounded(E.best_and_worst_cell(E.rate_cells(binned(spark, sf), C("relationship"), C("sex"), C("hi")), 30))


@query("e12_best_worst_cell", B + f", cl AS ({_cells('age', 'education')}) {_extremes('cl')}")
def e12(spark, sf):
    return rounded(E.best_and_worst_cell(E.rate_cells(binned(spark, sf), C("age"), C("education"), C("hi"))))


@query("e13_label_order", B + f""" SELECT label, coalesce(TRY_CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER), 0) AS sort_number, {rd('rate')} AS rate
  FROM ({RATES.replace('occupation', 'age')})""")
def e13(spark, sf):
    return rounded(E.label_order(binned(spark, sf), C("age"), C("hi"), by="number"))


@query("e14_numeric_by_target", P + f""", t AS (SELECT CAST(capital_gain AS DOUBLE) AS x, {HIGH_SQL} AS hi FROM people) SELECT {rd('avg(x) FILTER (NOT hi)', 4)} AS std_mean,
  {rd('avg(x) FILTER (hi)', 4)} AS high_mean, {pct('count(*) FILTER (NOT hi AND x > 0)', 'count(*) FILTER (NOT hi)', 4)} AS std_pct_positive,
  {pct('count(*) FILTER (hi AND x > 0)', 'count(*) FILTER (hi)', 4)} AS high_pct_positive, {rd('avg(x) FILTER (hi) / avg(x) FILTER (NOT hi)', 4)} AS multiplier FROM t""")
def e14(spark, sf):
    p = people(spark, sf)
    return rounded(E.numeric_by_target(p, number(p, "capital_gain"), high()), 4)


@query("e15_target_by_gender", P + f""", t AS (SELECT lower(trim(sex)) AS g, {HIGH_SQL} AS hi FROM people), n AS (SELECT count(*) FILTER (g = 'male' AND hi) AS mh,
  count(*) FILTER (g = 'male' AND NOT hi) AS ms, count(*) FILTER (g = 'female' AND hi) AS fh, count(*) FILTER (g = 'female' AND NOT hi) AS fs FROM t)
  SELECT mh AS male_high, ms AS male_std, fh AS female_high, fs AS female_std, {pct('mh', '(mh + ms)')} AS male_pct, {pct('fh', '(fh + fs)')} AS female_pct,
  {rd('CAST(mh AS DOUBLE) / (mh + ms) * 100 - CAST(fh AS DOUBLE) / (fh + fs) * 100')} AS gap FROM n""")
def e15(spark, sf):
    return rounded(E.target_by_gender(people(spark, sf), C("sex"), high()))


def _comp(extra=""):
    return f"""cm AS (SELECT {lab('occupation')} AS "row", {lab('education')} AS col, count(*) AS n FROM b {extra} GROUP BY 1, 2),
      cs AS (SELECT "row", col, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY "row") * 100 AS pct FROM cm)"""


@query("e16_composition", B + f', {_comp()} SELECT "row", col, n, {rd("pct")} AS pct FROM cs')
def e16(spark, sf):
    return rounded(E.composition(binned(spark, sf), C("occupation"), C("education")))


LEVELS = "lv AS (SELECT \"row\" AS label, sum(CASE WHEN col IN ('Advanced', 'Bachelors') THEN pct ELSE 0 END) AS rate FROM cs GROUP BY 1)"


@query("e16_top_level_share", B + f""", {_comp()}, {LEVELS} SELECT {_best('lv')[0]} AS best, {rd('max(rate)')} AS best_pct, {_best('lv')[1]} AS worst, {rd('min(rate)')} AS worst_pct FROM lv""")
def e16_share(spark, sf):
    return rounded(E.best_and_worst_share(E.level_share(E.composition(binned(spark, sf), C("occupation"), C("education")))))


PREV = f"""pc AS (SELECT hi AS high, {lab('education')} AS "row", {lab('occupation')} AS col, avg(CAST(coalesce(gain > 0, false) AS INT)) * 100 AS pct FROM b GROUP BY 1, 2, 3)"""


@query("e17_prevalence_cross_tab", B + f', {PREV} SELECT high, "row", col, {rd("pct")} AS pct FROM pc')
def e17(spark, sf):
    return rounded(E.prevalence_grid(binned(spark, sf), C("education"), C("occupation"), C("hi"), C("gain")))


@query("e17_prevalence_cross_tab_dense", B + f""", {PREV} SELECT r.high, r."row", c.col, coalesce({rd("pc.pct")}, 0.0) AS pct FROM (SELECT DISTINCT high, "row" FROM pc) r
  JOIN (SELECT DISTINCT high, col FROM pc) c ON r.high = c.high LEFT JOIN pc ON pc.high = r.high AND pc."row" = r."row" AND pc.col = c.col""")
def e17_dense(spark, sf):
    return rounded(E.dense(E.prevalence_grid(binned(spark, sf), C("education"), C("occupation"), C("hi"), C("gain")), ("high",)))


@query("e17_prevalence_peak", B + f', {PREV} SELECT "row", col, {rd("pct")} AS pct FROM pc WHERE high ORDER BY pc.pct DESC, "row", col LIMIT 1')
def e17_peak(spark, sf):
    return rounded(E.prevalence_peak(E.prevalence_grid(binned(spark, sf), C("education"), C("occupation"), C("hi"), C("gain"))))


@query("e18_count_rate_cells", B + f""", cl AS ({_cells('occupation', 'hours_per_week')}), w AS (SELECT *, coalesce(TRY_CAST(regexp_extract(col, '(\\d+)', 1) AS INTEGER), 999) AS wt FROM cl)
  SELECT "row", col, n, {rd('rate')} AS rate, {rd('greatest(8.0, CAST(n AS DOUBLE) / max(n) OVER () * 55)')} AS size, {big('sum(n * wt) OVER (PARTITION BY "row")')} AS total_hours FROM w""")
def e18(spark, sf):
    return rounded(E.hours_cells(binned(spark, sf), C("occupation"), C("hours_per_week"), C("hi")))


MEDIANS = f"""md AS (SELECT label, quantile_cont(x, 0.5) AS rate FROM (SELECT {lab('occupation')} AS label,
  CAST(TRY_CAST(regexp_extract(hours_per_week, '(\\d+)', 1) AS INTEGER) AS DOUBLE) AS x FROM b) WHERE x IS NOT NULL GROUP BY 1)"""


@query("e19_median_by_group", B + f", {MEDIANS} SELECT label, {rd('rate')} AS median_hours FROM md")
def e19(spark, sf):
    return rounded(E.median_hours_by(binned(spark, sf), C("occupation"), C("hours_per_week")))


@query("e19_highest_median", B + f", {MEDIANS} SELECT label, {rd('rate')} AS median_hours FROM md ORDER BY rate DESC, label LIMIT 1")
def e19_top(spark, sf):
    return rounded(E.top_median(E.median_hours_by(binned(spark, sf), C("occupation"), C("hours_per_week"))))


@query("e20_best_cell_by_rate", B + f""", cl AS ({_cells('occupation', 'hours_per_week')} HAVING count(*) >= 30) SELECT "row" AS best_row, col AS best_col, {rd('rate * 100')} AS best_pct
  FROM cl WHERE rate > 0 ORDER BY rate DESC, "row", col LIMIT 1""")
def e20(spark, sf):
    return rounded(E.best_cell(E.rate_cells(binned(spark, sf), C("occupation"), C("hours_per_week"), C("hi"))))


GENDER = f"""gn AS (SELECT {lab('occupation')} AS label, coalesce(avg(CAST(hi AS INT)) FILTER (lower(trim(sex)) = 'male'), 0) AS m,
  coalesce(avg(CAST(hi AS INT)) FILTER (lower(trim(sex)) = 'female'), 0) AS f FROM b WHERE lower(trim(sex)) IN ('male', 'female') GROUP BY 1),
  gg AS (SELECT *, (m - f) * 100 AS rate FROM gn)"""


@query("e21_gender_rates", B + f""", {GENDER} SELECT label, {rd('m')} AS male_rate, {rd('f')} AS female_rate, {rd('(m + f) / 2')} AS mean_rate, {rd('rate')} AS gap FROM gg""")
def e21(spark, sf):
    return rounded(E.gender_rates(binned(spark, sf), C("occupation"), C("sex"), C("hi")))


@query("e21_gender_gap", B + f""", {GENDER} SELECT {rd('avg(m) * 100')} AS avg_male, {rd('avg(f) * 100')} AS avg_female, {rd('(avg(m) - avg(f)) * 100')} AS gap,
  {_best('gg')[0]} AS widest, {rd('max(rate)')} AS widest_gap, {_best('gg')[1]} AS narrowest, {rd('min(rate)')} AS narrowest_gap FROM gg""")
def e21_gap(spark, sf):
    return rounded(E.gender_gap(E.gender_rates(binned(spark, sf), C("occupation"), C("sex"), C("hi"))))


def _segments(group, extra=""):
    tests = {E.SEGMENTS[0]: "hi AND g", E.SEGMENTS[1]: "hi AND NOT g", E.SEGMENTS[2]: "NOT hi AND g", E.SEGMENTS[3]: "NOT hi AND NOT g"}
    return f"SELECT {lab(group)} AS label, count(*) AS n, " + ", ".join(
        pct(f"count(*) FILTER ({t})", "count(*)") + f' AS "{s}"' for s, t in tests.items()) + f" FROM (SELECT *, coalesce(gain > 0, false) AS g FROM b {extra}) GROUP BY 1"


@query("e22_segments_by_marital_status", B + " " + _segments("marital_status"))
def e22(spark, sf):
    return rounded(E.segment_composition(binned(spark, sf), C("marital_status"), C("hi"), C("gain")))


@query("e22_segments_by_occupation", B + " " + _segments("occupation"))
def e22_occupation(spark, sf):
    return rounded(E.segment_composition(binned(spark, sf), C("occupation"), C("hi"), C("gain")))


GENDERED = _segments("occupation", "WHERE lower(trim(sex)) IN ('male', 'female')").replace("SELECT ", "SELECT lower(trim(sex)) AS gender, ", 1).replace("GROUP BY 1", "GROUP BY 1, 2")


@query("e22_segments_by_gender_and_occupation", B + " " + GENDERED)
def e22_gender(spark, sf):
    return rounded(E.segment_composition(binned(spark, sf), C("occupation"), C("hi"), C("gain"), C("sex")))


@query("e23_dual_condition_rate", B + f", r AS (SELECT {lab('marital_status')} AS label, count(*) AS n, avg(CAST(hi AND coalesce(gain > 0, false) AS INT)) AS rate FROM b GROUP BY 1) "
       f"SELECT {_best('r')[0]} AS best, {rd('max(rate) * 100')} AS best_pct, {_best('r')[1]} AS worst, {rd('min(rate) * 100')} AS worst_pct, {rd('(max(rate) - min(rate)) * 100')} AS gap FROM r")
def e23(spark, sf):
    return rounded(E.best_and_worst(E.dual_rate_by(binned(spark, sf), C("marital_status"), C("hi"), C("gain"))))


@query("e24_dual_rate_by_gender", B + f""" SELECT lower(trim(sex)) AS gender, {rd('avg(CAST(hi AS INT)) * 100')} AS target_pct,
  {rd('avg(CAST(hi AND coalesce(gain > 0, false) AS INT)) * 100')} AS dual_pct FROM b WHERE lower(trim(sex)) IN ('male', 'female') GROUP BY 1""")
def e24(spark, sf):
    return rounded(E.dual_rate_by_gender(binned(spark, sf), C("sex"), C("hi"), C("gain")))


PADDED = "CASE raw_age % 3 WHEN 0 THEN concat(' ', sex) WHEN 1 THEN concat(sex, '  ') ELSE sex END"


@query("e25_archetype", B + f""", h AS (SELECT *, {PADDED} AS padded FROM b WHERE hi), hn AS (SELECT count(*) AS t FROM h), f AS ({" UNION ALL ".join(
    f"SELECT '{k}' AS item, {lab(c)} AS label, count(*) AS n FROM h GROUP BY 2" for k, c in (("sex", "trim(padded)"), ("marital", "marital_status"), ("education", "education"), ("occupation", "occupation")))}),
  k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS rn FROM f)
  SELECT item, label, {pct('n', 't')} AS value FROM k, hn WHERE rn = 1
  UNION ALL SELECT 'median_age', NULL, {rd('floor(quantile_cont(raw_age, 0.5))')} FROM h
  UNION ALL SELECT 'mean_hours', NULL, {rd('avg(raw_hours)')} FROM h
  UNION ALL SELECT 'gain_pct', NULL, {pct('count(*) FILTER (gain > 0)', 'count(*)')} FROM h""")
def e25(spark, sf):
    fields = {"sex": F.expr(PADDED), "marital": C("marital_status"), "education": C("education"), "occupation": C("occupation")}
    return rounded(E.archetype(binned(spark, sf), C("hi"), fields, C("raw_age"), C("raw_hours"), C("gain")))


@query("e26_composition_of_target", B + f', {_comp("WHERE hi")} SELECT "row", col, n, {rd("pct")} AS pct FROM cs')
def e26(spark, sf):
    return rounded(E.composition(binned(spark, sf).where("hi"), C("occupation"), C("education")))


@query("e27_grouped_counts_top_rows", """WITH c AS (SELECT p_brand AS "row", CAST(p_size % 3 AS VARCHAR) AS hue, count(*) AS n FROM part GROUP BY 1, 2),
  t AS (SELECT "row", CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1 ORDER BY total DESC, 1 LIMIT 15) SELECT "row", hue, n, total FROM c JOIN t USING ("row")""")
def e27(spark, sf):
    from peoplelens.operators.frequency import grouped_counts

    return grouped_counts(table(spark, sf, "part").select("p_brand", (C("p_size") % 3).alias("third")), "p_brand", "third", 15)


# --- dashboard ---------------------------------------------------------------------------------------------------------

def _long(section, sql, words, numbers):
    """Rows of a section's SQL as (section, key, measure, value), as the dashboard gives them."""
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({w} AS VARCHAR), '')" for w in words) + ")" if words else "''"
    names = ", ".join("'" + n.strip('"') + "'" for n in numbers) or "'row'"
    values = ", ".join(rd(n) for n in numbers) or "CAST(1 AS DOUBLE)"
    return f"SELECT '{section}' AS section, {key} AS key, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({sql})"


def _dashboard_sql():
    row, ends = ['"row"', "col"], (["best_row", "best_col", "worst_row", "worst_col"], ["best_pct", "worst_pct", "gap"])
    best = (["best", "worst"], ["best_pct", "worst_pct", "gap"])
    segs = ["n", *(f'"{x}"' for x in E.SEGMENTS)]
    dual = "avg(CAST(hi AND coalesce(gain > 0, false) AS INT))"
    strongest = ASSOC.replace("WITH ", "")
    tops = (strongest + ", tops AS (SELECT attribute, association FROM sc WHERE association >= 0.2 ORDER BY association DESC, attribute LIMIT 4), r AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {lab(c)} AS label, count(*) AS n, avg(CAST(hi AS INT)) AS rate FROM b GROUP BY 2" for c in [*ASSOC_TEXT, *ASSOC_NUM]) + ")")

    def cells(r, c, extra=""):
        return f"WITH cl AS ({_cells(r, c)} {extra})"

    def best_worst(rates):
        return f"WITH r AS ({rates}) SELECT {_best('r')[0]} AS best, max(rate) * 100 AS best_pct, {_best('r')[1]} AS worst, min(rate) * 100 AS worst_pct, (max(rate) - min(rate)) * 100 AS gap FROM r"

    def duals(c):
        return f"SELECT {lab(c)} AS label, count(*) AS n, {dual} AS rate FROM b GROUP BY 1"

    few = "HAVING count(*) >= 30"
    kpi = ["total", "n_high", "n_std", "pct_high", "male_n", "female_n", "pct_male", "pct_female", "avg_hours", "pct_overtime", "age_gap", "median_age", "q1_age", "q3_age"]
    out = [_long("kpi", ORACLES["e5_kpi_header"], [], kpi)]
    out.append(_long("target_split", "SELECT count(*) AS total, count(*) FILTER (hi) AS n_high, count(*) FILTER (NOT hi) AS n_std, "
                     "CAST(count(*) FILTER (hi) AS DOUBLE) / count(*) * 100 AS pct_high, CAST(count(*) FILTER (NOT hi) AS DOUBLE) / count(*) * 100 AS pct_std, "
                     "CAST(count(*) FILTER (NOT hi) AS DOUBLE) / greatest(count(*) FILTER (hi), 1) AS ratio FROM b", [],
                     ["total", "n_high", "n_std", "pct_high", "pct_std", "ratio"]))
    out.append(_long("associations", f"WITH {strongest} SELECT * FROM sc WHERE association >= 0.2", ["attribute", "method"], ["association"]))
    out.append(_long("feature_rates", f"WITH {tops} SELECT feature, association, label, n, rate FROM r JOIN tops ON feature = attribute", ["feature", "label"],
                     ["association", "n", "rate"]))
    out.append(_long("breakdown", f"""WITH {tops}, k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rate DESC, label) AS up,
      row_number() OVER (PARTITION BY feature ORDER BY rate, label) AS down FROM r) SELECT feature, any_value(association) AS association, max(label) FILTER (up = 1) AS best,
      max(rate) * 100 AS best_pct, max(label) FILTER (down = 1) AS worst, min(rate) * 100 AS worst_pct, (max(rate) - min(rate)) * 100 AS gap
      FROM k JOIN tops ON feature = attribute GROUP BY feature""", ["feature", "best", "worst"], ["association", "best_pct", "worst_pct", "gap"]))
    for name, r, c, extra in (("relationship_by_sex", "relationship", "sex", few), ("marital_by_sex", "marital_status", "sex", few),
                              ("age_by_education", "age", "education", ""), ("age_by_occupation", "age", "occupation", few)):
        out.append(_long(name, cells(r, c) + " SELECT * FROM cl", row, ["n", "rate"]))
        out.append(_long(f"{name}_ends", cells(r, c, extra) + " " + _extremes("cl"), *ends))
    out.append(_long("education_in_occupation", f'WITH {_comp()} SELECT * FROM cs', row, ["n", "pct"]))
    out.append(_long("top_education_share", f"WITH {_comp()}, {LEVELS} SELECT {_best('lv')[0]} AS best, max(rate) AS best_pct, {_best('lv')[1]} AS worst, min(rate) AS worst_pct FROM lv",
                     best[0], best[1][:2]))
    out.append(_long("occupation_by_hours", cells("occupation", "hours_per_week") + """, w AS (SELECT *, coalesce(TRY_CAST(regexp_extract(col, '(\\d+)', 1) AS INTEGER), 999) AS wt FROM cl)
      SELECT "row", col, n, rate, greatest(8.0, CAST(n AS DOUBLE) / max(n) OVER () * 55) AS size, sum(n * wt) OVER (PARTITION BY "row") AS total_hours FROM w""", row,
                     ["n", "rate", "size", "total_hours"]))
    out.append(_long("occupation_by_hours_best", cells("occupation", "hours_per_week", few) + """ SELECT "row" AS best_row, col AS best_col, rate * 100 AS best_pct FROM cl
      WHERE rate > 0 ORDER BY rate DESC, "row", col LIMIT 1""", ["best_row", "best_col"], ["best_pct"]))
    out.append(_long("gain_by_target", """WITH t AS (SELECT CAST(gain AS DOUBLE) AS x, hi FROM b) SELECT avg(x) FILTER (NOT hi) AS std_mean, avg(x) FILTER (hi) AS high_mean,
      CAST(count(*) FILTER (NOT hi AND x > 0) AS DOUBLE) / count(*) FILTER (NOT hi) * 100 AS std_pct_positive,
      CAST(count(*) FILTER (hi AND x > 0) AS DOUBLE) / count(*) FILTER (hi) * 100 AS high_pct_positive, avg(x) FILTER (hi) / avg(x) FILTER (NOT hi) AS multiplier FROM t""", [],
                     ["std_mean", "high_mean", "std_pct_positive", "high_pct_positive", "multiplier"]))
    out.append(_long("gain_prevalence", f"WITH {PREV} SELECT * FROM pc", ["high", *row], ["pct"]))
    out.append(_long("gain_prevalence_peak", f'WITH {PREV} SELECT * FROM pc WHERE high ORDER BY pct DESC, "row", col LIMIT 1', row, ["pct"]))
    out.append(_long("segments_by_marital", _segments("marital_status"), ["label"], segs))
    out.append(_long("segments_by_occupation", _segments("occupation"), ["label"], segs))
    out.append(_long("segments_by_gender_and_occupation", GENDERED, ["gender", "label"], segs))
    for name, c in (("dual_by_marital", "marital_status"), ("dual_by_occupation", "occupation")):
        out.append(_long(name, duals(c), ["label"], ["n", "rate"]))
        out.append(_long(f"{name}_ends", best_worst(duals(c)), *best))
    out.append(_long("target_by_gender", ORACLES["e15_target_by_gender"], [], ["male_high", "male_std", "female_high", "female_std", "male_pct", "female_pct", "gap"]))
    out.append(_long("gender_by_occupation", f"WITH {GENDER} SELECT label, m AS male_rate, f AS female_rate, (m + f) / 2 AS mean_rate, rate AS gap FROM gg", ["label"],
                     ["male_rate", "female_rate", "mean_rate", "gap"]))
    out.append(_long("gender_gap", f"""WITH {GENDER} SELECT avg(m) * 100 AS avg_male, avg(f) * 100 AS avg_female, (avg(m) - avg(f)) * 100 AS gap, {_best('gg')[0]} AS widest,
      max(rate) AS widest_gap, {_best('gg')[1]} AS narrowest, min(rate) AS narrowest_gap FROM gg""", ["widest", "narrowest"],
                     ["avg_male", "avg_female", "gap", "widest_gap", "narrowest_gap"]))
    out.append(_long("dual_by_gender", f"""SELECT lower(trim(sex)) AS gender, avg(CAST(hi AS INT)) * 100 AS target_pct, {dual} * 100 AS dual_pct FROM b
      WHERE lower(trim(sex)) IN ('male', 'female') GROUP BY 1""", ["gender"], ["target_pct", "dual_pct"]))
    out.append(_long("archetype", ORACLES["e25_archetype"].replace(PADDED, "sex"), ["item", "label"], ["value"]))
    out.append(_long("education_of_target", f'WITH {_comp("WHERE hi")} SELECT * FROM cs', row, ["n", "pct"]))
    return B + " " + " UNION ALL ".join(out)


@query("e28_dashboard", _dashboard_sql())
def e28(spark, sf):
    return D.dashboard_long(people(spark, sf))


# --- insights ----------------------------------------------------------------------------------------------------------

def _rates1(c, name):
    return f"{name} AS (SELECT {lab(c)} AS label, round(avg(CAST({HIGH_SQL} AS INT)) * 100, 1) AS rate FROM people GROUP BY 1)"


def _of(name, short):
    best, worst = _best(name)
    return f"{best} AS {short}_best, (SELECT max(rate) FROM {name}) AS {short}_best_pct, {worst} AS {short}_worst, (SELECT min(rate) FROM {name}) AS {short}_worst_pct"


MALE = "(SELECT {} FROM sx WHERE contains(lower(label), 'male') AND NOT contains(lower(label), 'fe') ORDER BY label LIMIT 1)"
FEMALE = "(SELECT {} FROM sx WHERE contains(lower(label), 'female') OR lower(label) = 'f' ORDER BY label LIMIT 1)"


@query("n1_insight_record", P + f""", {text_long()}, {NOISY}, {NOISE_COUNTS}, {_rates1('education', 'ed')}, {_rates1('occupation', 'oc')}, {_rates1('sex', 'sx')},
  t AS (SELECT *, {HIGH_SQL} AS hi FROM people)
  SELECT count(*) AS n, count(*) FILTER (hi) AS n_high, {pct('count(*) FILTER (hi)', 'count(*)')} AS pct_high,
  {rd('corr(hours_per_week, CAST(hi AS INT))')} AS hours_r, {rd('avg(hours_per_week) FILTER (hi)')} AS hours_mean_high, {rd('avg(hours_per_week) FILTER (NOT hi)')} AS hours_mean_low,
  {pct('count(*) FILTER (capital_gain > 0)', 'count(*)')} AS gain_pct_positive, max(capital_gain) AS gain_max, count(*) FILTER (capital_gain >= 99999) AS gain_at_ceiling,
  19::BIGINT AS cols, {_of('ed', 'education')}, {_of('oc', 'occupation')}, {MALE.format('label')} AS men_label, {MALE.format('rate')} AS men_pct,
  {FEMALE.format('label')} AS women_label, {FEMALE.format('rate')} AS women_pct,
  round((SELECT max(rate) FROM ed) / greatest((SELECT min(rate) FROM ed), 1.0), 1) AS education_ratio,
  round((SELECT max(rate) FROM oc) - (SELECT min(rate) FROM oc), 1) AS occupation_spread, round({MALE.format('rate')} - {FEMALE.format('rate')}, 1) AS gender_gap,
  {big(GAPS)} AS missing_total, {pct(f'({GAPS})', '(count(*) * 19)')} AS missing_pct, {big(DUPES)} AS duplicate_rows,
  {big('(SELECT sum(n) FROM nc)')} AS noise_count, {pct('(SELECT sum(n) FROM nc)', 'count(*)')} AS noise_pct, {NOISE_NAMES} AS noise_columns FROM t""")
def n1(spark, sf):
    return rounded(N.insight_record(people(spark, sf)))


STRENGTH = "CASE WHEN abs({0}) < 0.15 THEN 'weak' WHEN abs({0}) < 0.35 THEN 'moderate' ELSE 'strong' END"


@query("n2_numeric_against_target", P + f""", t AS (SELECT education_num AS x, {HIGH_SQL} AS hi FROM people) SELECT {rd('corr(x, CAST(hi AS INT))')} AS r,
  {STRENGTH.format('corr(x, CAST(hi AS INT))')} AS strength, {rd('avg(x) FILTER (hi)')} AS mean_high, {rd('avg(x) FILTER (NOT hi)')} AS mean_low FROM t""")
def n2(spark, sf):
    p = people(spark, sf)
    return rounded(N.numeric_against_target(p, number(p, "education_num"), high()))


@query("n3_ceiling_check", P + f""" SELECT {pct('count(*) FILTER (capital_gain > 0)', 'count(*)')} AS pct_positive, CAST(max(capital_gain) AS DOUBLE) AS max_value,
  count(*) FILTER (capital_gain >= 99999) AS at_ceiling FROM people""")
def n3(spark, sf):
    p = people(spark, sf)
    return rounded(N.ceiling_check(p, number(p, "capital_gain")))


@query("n4_strength_label", P + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {rd('r')} AS r, {STRENGTH.format('r')} AS strength FROM (SELECT corr({c}, CAST({HIGH_SQL} AS INT)) AS r FROM people)"
    for c in ("age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week")))
def n4(spark, sf):
    from peoplelens.operators.profile import target_correlations

    return rounded(target_correlations(people(spark, sf), high()).select("column", "r", A.strength_label(C("r")).alias("strength")))


@query("n5_dataset_context", P + f""", g AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) - count({c}) AS m FROM people" for c in ALL)})
  SELECT count(*) AS rows, 19::BIGINT AS cols, {big(DUPES)} AS duplicates, {pct(f'({GAPS})', '(count(*) * 19)')} AS missing_pct,
  (SELECT string_agg(c || '=' || m, ',' ORDER BY c) FROM g WHERE m > 0) AS gaps FROM people""")
def n5(spark, sf):
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat(g["column"], F.lit("="), g["missing"].cast("string"))), ",")
    return rounded(N.dataset_context(people(spark, sf)).withColumn("gaps", gaps))


@query("n6_report_tables", P + f""", {text_long()}, {NOISY}, {CHECKS}, {TOTALS}, {OUTLIERS}, s AS (SELECT {rd(HEALTH)} AS health_score, rows, cols, duplicates,
   {pct('missing', '(rows * cols)')} AS missing_pct FROM tt), g AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) - count({c}) AS m FROM people" for c in ALL)}) """
       + " UNION ALL ".join(f"SELECT 'summary' AS section, '{c}' AS item, CAST({c} AS DOUBLE) AS value FROM s"
                            for c in ("health_score", "rows", "cols", "duplicates", "missing_pct"))
       + " UNION ALL SELECT 'missing', c, CAST(m AS DOUBLE) FROM g WHERE m > 0 UNION ALL SELECT 'outliers', col, CAST(raw AS DOUBLE) FROM cn WHERE raw > 0")
def n6(spark, sf):
    return rounded(N.report_long(people(spark, sf)))


