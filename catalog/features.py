"""Feature engineering (F)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog.people import COLUMNS, NUMERIC, TEXT, people, people_sql
from catalog.audit import COUNTS, MODE_CTE
from catalog.cleaning import CASE_MAP, STRATEGY, picks
from catalog.registry import (
    OUTLIER_SQL, P, ZONES_SQL, big, bin_sql, binned_sql, group_sql, noise_sql, number_long, number_stats, query, rd, rounded, table,
    text_long,
)
from catalog.statistics import ALL, DOM, DUPES, GAPS, LI
from peoplelens import rules as R
from peoplelens.functions.frames import small_frame
from peoplelens.operators import features as X
from peoplelens.plans import nine_step

EV = "(SELECT event_id, value, value - 50 AS shifted FROM events)"


def _log_sql(source, columns):
    flat = ", " + DOM.lstrip(", ") + ", flat AS (SELECT nd.col FROM nd WHERE CAST(top AS DOUBLE) / total >= 0.8)"
    return f"""{number_stats(source, columns)}{flat} SELECT col AS "column", skew AS skewness, lo AS min, hi AS max,
      CASE WHEN lo >= 0 THEN 'log1p' ELSE 'yeo-johnson' END AS method FROM st
      WHERE abs(skew) > 1.0 AND n >= 3 AND col NOT IN (SELECT col FROM flat)"""


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", (F.col("value") - 50).alias("shifted"))


@query("f1_log_candidates", "WITH ev AS " + EV + ", " + _log_sql("ev", ["event_id", "value", "shifted"]))
def f1(spark, sf):
    return X.log_candidates(events(spark, sf))


@query("f1_log_candidates_documents", "WITH " + _log_sql("documents", ["doc_id", "n_chars"]))
def f1_documents(spark, sf):
    return X.log_candidates(table(spark, sf, "documents").select("doc_id", "n_chars"))


@query("f2_log1p", f"SELECT event_id, {rd('ln(1 + value)')} AS value FROM events")
def f2(spark, sf):
    return rounded(X.log_transform(events(spark, sf).select("event_id", "value"), {"value": X.LOG1P}))


YJ = """CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE (power(x + 1, lam) - 1) / lam END
  ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - lam) - 1) / (2 - lam) END END"""


@query("f3_yeo_johnson_fit", f"""WITH g AS (SELECT CAST(i AS DOUBLE) / 100 AS lam FROM range(-200, 401) AS r(i)), e AS (SELECT value - 50 AS x FROM events),
  l AS (SELECT lam, count(*) AS n, -count(*) / 2.0 * ln(var_pop({YJ})) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS likelihood FROM e CROSS JOIN g GROUP BY lam)
  SELECT n, lam AS "lambda" FROM l ORDER BY likelihood DESC LIMIT 1""")
def f3_fit(spark, sf):
    lam = X.fit_yeo_johnson(events(spark, sf), ["shifted"])["shifted"]
    return events(spark, sf).agg(F.count("shifted").alias("n")).select("n", F.lit(round(lam, 2)).alias("lambda"))


@query("f3_yeo_johnson_transform", f"""SELECT event_id, {rd('''CASE WHEN value - 50 >= 0 THEN (power(value - 50 + 1, 0.7) - 1) / 0.7
  ELSE -(power(1 - (value - 50), 2 - 0.7) - 1) / (2 - 0.7) END''')} AS shifted FROM events""")
def f3(spark, sf):
    df = events(spark, sf).select("event_id", "shifted")
    return rounded(X.log_transform(df, {"shifted": X.YEO_JOHNSON}, {"shifted": 0.7}))


@query("f4_numeric_binning", P + " SELECT " + ", ".join(
    [f"{bin_sql(c, *rule)} AS {c}" for c, rule in R.BINS.items()] + ["age AS raw_age", "hours_per_week AS raw_hours"]) + " FROM people")
def f4(spark, sf):
    p = people(spark, sf).select(*R.BINS, F.col("age").alias("raw_age"), F.col("hours_per_week").alias("raw_hours"))
    return X.bin_and_group(p, groups=False)


@query("f5_category_mapping", P + " SELECT " + ", ".join(f"{group_sql(c, g)} AS {c}" for c, g in R.GROUPS.items()) + ", sex FROM people")
def f5(spark, sf):
    return X.bin_and_group(people(spark, sf).select(*R.GROUPS, "sex"), bins=False)


def _preview_sql(c):
    kind, labels = ("bins", R.BINS[c][1]) if c in R.BINS else ("groups", tuple(R.GROUPS[c]))
    return f"""SELECT '{c}' AS "column", '{kind}' AS kind, {len(labels)}::INTEGER AS n_labels, '{"|".join(labels)}' AS labels,
      count(DISTINCT {c}) AS unique_before FROM people"""


@query("f6_binning_preview", P + " " + " UNION ALL ".join(_preview_sql(c) for c in (*R.BINS, *R.GROUPS)))
def f6(spark, sf):
    return X.binning_preview(people(spark, sf)).withColumn("labels", F.array_join("labels", "|"))


BINNED_COLUMNS = ", ".join(ALL)


@query("f7_binning_on_the_fly", P + f", {binned_sql()} SELECT {BINNED_COLUMNS} FROM b")
def f7(spark, sf):
    return X.bin_and_group(people(spark, sf))


def _plan_sql(c):
    """Encoding of one column, decided in SQL from its distinct count where no rule fixes it."""
    if c in R.BINS or c in R.GROUPS:
        names = R.BINS[c][1] if c in R.BINS else list(R.GROUPS[c])
        unique, examples = f"{len(names)}::BIGINT", "'" + "|".join(names) + "'"
    else:
        unique = f"(SELECT count(DISTINCT {c}) FROM people)"
        examples = f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM people WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))"
    rest = "ordinal" if c in R.ORDINAL_COLUMNS else "binned" if c in R.BINS else "nominal"
    reason = "'redundant'" if c == "education" else "'binary'" if c in R.BINARY_COLUMNS else f"CASE WHEN {unique} <= 2 THEN 'binary' ELSE '{rest}' END"
    return f"SELECT '{c}', {unique}, {examples}, {reason}"


@query("f8_encoding_plan", P + ', t("column", unique_values, examples, reason) AS (' + " UNION ALL ".join(
    _plan_sql(c) for c in (*TEXT, *R.BINS)) + """) SELECT *, CASE reason WHEN 'redundant' THEN 'drop' WHEN 'nominal' THEN 'one_hot' ELSE 'label' END AS encoding FROM t""")
def f8(spark, sf):
    return X.encoding_table(people(spark, sf), R.Rules()).withColumn("examples", F.array_join("examples", "|"))


@query("f9_drop_redundant", P + " SELECT " + ", ".join(c for c in ALL if c != "education") + " FROM people")
def f9(spark, sf):
    return X.drop_redundant(people(spark, sf))


def _codes(c, name, source="people"):
    return f"{name} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM {source} WHERE {c} IS NOT NULL))"


@query("f10_label_encoding", P + f""", {_codes('workclass', 'w')}, {_codes('sex', 's')} SELECT fnlwgt, w.code AS workclass, s.code AS sex
  FROM people LEFT JOIN w ON w.v = workclass LEFT JOIN s ON s.v = sex""")
def f10(spark, sf):
    return X.label_encode(people(spark, sf).select("fnlwgt", "workclass", "sex"), ["workclass", "sex"])


@query("f10_label_encoding_many_values", f"WITH {_codes('p_name', 'w', 'part')} SELECT p_partkey, w.code AS p_name FROM part LEFT JOIN w ON w.v = p_name")
def f10_many(spark, sf):
    return X.label_encode(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"])


# Names differ in more than case, so "private" beside "Private" is numbered.
ONE_HOT = {"workclass": {"?": "workclass_?", "Federal-gov": "workclass_Federal-gov", "Local-gov": "workclass_Local-gov", "Private": "workclass_Private",
                         "Self-emp-inc": "workclass_Self-emp-inc", "Self-emp-not-inc": "workclass_Self-emp-not-inc", "State-gov": "workclass_State-gov",
                         "private": "workclass_private_2"},
           "race": {"Black": "race_Black", "Other": "race_Other", "White": "race_White"}}


@query("f11_one_hot", P + " SELECT fnlwgt, " + ", ".join(
    f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS \"{n}\"" for c, vs in ONE_HOT.items() for v, n in vs.items()) + " FROM people")
def f11(spark, sf):
    return X.one_hot(people(spark, sf).select("fnlwgt", "workclass", "race"), ["workclass", "race"])


@query("f11_one_hot_long", f"WITH {_codes('p_name', 'w', 'part')} SELECT p_partkey, 'p_name' AS \"column\", w.code AS level FROM part JOIN w ON w.v = p_name")
def f11_long(spark, sf):
    return X.one_hot_long(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", ["p_name"])


SCALER = "CASE WHEN abs(skew) < 0.5 THEN 'StandardScaler' ELSE 'RobustScaler' END"


@query("f12_scaling_plan", P + f""", b2 AS (SELECT *, CAST(income = '>50K' AS BIGINT) AS flag FROM people), {number_stats('b2', [*NUMERIC, 'flag'])}, d AS (
  SELECT col, count(DISTINCT v) AS d FROM nlong GROUP BY col) SELECT st.col AS "column", skew AS skewness, lo AS min, hi AS max, {rd('sd', 4)} AS std, {SCALER} AS method
  FROM st JOIN d ON d.col = st.col WHERE d > 2 AND n >= 3""")
def f12(spark, sf):
    p = people(spark, sf).withColumn("flag", (F.col("income") == ">50K").cast("bigint"))
    return rounded(X.scaling_table(p), 4)


def _scaled(how):
    centre, spread = ("mean", "sd") if how == "standard" else ("med", "iqr")
    return f"WITH {number_stats('lineitem', LI)} SELECT l_orderkey, l_linenumber, " + ", ".join(
        rd(f"({c} - (SELECT {centre} FROM st WHERE col = '{c}')) / (SELECT {spread} FROM st WHERE col = '{c}')") + f" AS {c}" for c in LI) + " FROM lineitem"


@query("f13_standard_scaling", _scaled("standard"))
def f13(spark, sf):
    return rounded(X.standard_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI), LI))


@query("f14_robust_scaling", _scaled("robust"))
def f14(spark, sf):
    return rounded(X.robust_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI), LI))


def _named(sql, suffix):
    """The shared expressions once more under other names."""
    return re.sub(r"\b(nlong|m0|m1|m2|st|tlong|tf|md|cn|zones)\b", lambda m: m.group(0) + suffix, sql)


TEXT_AFTER = [c for c in TEXT if c != "badge_no"]
NUMBERS_AFTER = [*NUMERIC, "badge_no"]


def _capped_sql(c):
    stats = f"FROM st_b WHERE col = '{c}'"
    zone = R.SAFE_ZONES.get(c)
    hit = f"(SELECT {OUTLIER_SQL.replace('l.v', f't4.{c}').replace('st.', 'st_b.')} {stats})"
    if zone:
        return f"CASE WHEN {hit} AND ({c} < {zone[0]} OR {c} > {zone[1]}) THEN greatest({zone[0]}, least({zone[1]}, {c})) ELSE {c} END AS {c}"
    return f"CASE WHEN {hit} THEN (SELECT greatest(lower_limit, least(upper_limit, CAST(t4.{c} AS DOUBLE))) {stats}) ELSE {c} END AS {c}"


FILLED = f"CASE WHEN {STRATEGY} = 'mean' THEN mean ELSE med END"
CLEANED = P + ", t0 AS (SELECT " + picks({c: f"trim({c})" for c in TEXT}) + f" FROM people), {text_long('t0')}, {CASE_MAP}, t1 AS (SELECT " + picks(
    {c: f"coalesce((SELECT winner FROM cm WHERE cm.col = '{c}' AND cm.v = t0.{c}), t0.{c})" for c in TEXT_AFTER}
    | {"badge_no": "TRY_CAST(badge_no AS BIGINT)", "hours_per_week": "CAST(hours_per_week AS DOUBLE)"}) + " FROM t0), t3 AS (SELECT DISTINCT " + picks(
    {c: f"CASE WHEN {noise_sql(c)} THEN NULL ELSE {c} END" for c in TEXT_AFTER}) + f""" FROM t1), {_named(number_stats('t3', NUMBERS_AFTER), '_a')},
  {_named(text_long('t3', TEXT_AFTER) + ', ' + MODE_CTE, '_a')}, t4 AS (SELECT """ + picks(
    {c: f"coalesce({c}, (SELECT CAST(round_even({FILLED}, 0) AS BIGINT) FROM st_a WHERE col = '{c}'))" for c in NUMBERS_AFTER if c != "hours_per_week"}
    | {"hours_per_week": f"coalesce(hours_per_week, (SELECT {FILLED} FROM st_a WHERE col = 'hours_per_week'))"}
    | {c: f"coalesce({c}, (SELECT v FROM md_a WHERE col = '{c}'))" for c in TEXT_AFTER}) + f""" FROM t3),
  {_named(f"{number_stats('t4', NUMBERS_AFTER)}, {ZONES_SQL}, {COUNTS}", '_b')}, t5 AS (SELECT """ + ", ".join(
    [_capped_sql(c) for c in NUMBERS_AFTER] + TEXT_AFTER) + f""" FROM t4), {_named(f"{number_stats('t5', NUMBERS_AFTER)}, {ZONES_SQL}, {COUNTS}", '_c')},
  noise AS (SELECT {' + '.join(f"count(*) FILTER ({noise_sql(c)})" for c in TEXT_AFTER)} AS n FROM t1)"""
AFTER_GAPS = " + ".join(f"count(*) - count({c})" for c in (*NUMBERS_AFTER, *TEXT_AFTER))


@query("f16_before_after_table", CLEANED + f""" SELECT 'Missing Values' AS issue, {big(f'(SELECT {GAPS} FROM people) + (SELECT n FROM noise)')} AS before,
   {big(f'(SELECT {AFTER_GAPS} FROM t5)')} AS after, CAST(NULL AS BIGINT) AS redetected
  UNION ALL SELECT 'Noise Values', {big('(SELECT n FROM noise)')}, {big('(SELECT ' + ' + '.join(f"count(*) FILTER ({noise_sql(c)})" for c in TEXT_AFTER) + ' FROM t5)')}, NULL
  UNION ALL SELECT 'Duplicate Rows', {big(DUPES)}, {big('(SELECT count(*) FROM t5) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t5))')}, NULL
  UNION ALL SELECT 'Outliers', {big('(SELECT sum(actual) FROM cn_b)')}, 0, {big('(SELECT sum(actual) FROM cn_c)')}""")
def f16(spark, sf):
    return nine_step.comparison_table(people(spark, sf))


@query("f17_cleaning_statistics", CLEANED + f""" SELECT (SELECT count(*) FROM people) AS rows_before, (SELECT count(*) FROM t3) AS rows_after,
  (SELECT count(*) FROM people) - (SELECT count(*) FROM t3) AS duplicates_dropped, (SELECT count(*) FROM cn_b WHERE actual > 0) AS outlier_columns""")
def f17_cleaning(spark, sf):
    counts = nine_step.clean(people(spark, sf))[2]
    return small_frame(spark, ", ".join(f"{k} bigint" for k in counts), [tuple(counts.values())])


# Steps 6 to 9 on t5: log, bins and groups, encoding, scaling.
CODED = ["age", "hours_per_week", "sex", "income"]
PLAIN = [c for c in NUMBERS_AFTER if c not in R.BINS]
NOMINAL = [c for c in (*TEXT_AFTER, *R.BINS) if c not in (*CODED, "education")]
ENCODED = CLEANED + f""", top5 AS (SELECT col, v, count(*) AS k FROM nlong_c GROUP BY 1, 2),
  flat5 AS (SELECT col FROM top5 GROUP BY col HAVING CAST(max(k) AS DOUBLE) / sum(k) >= 0.8),
  lg AS (SELECT col FROM st_c WHERE abs(skew) > 1.0 AND n >= 3 AND col NOT IN (SELECT col FROM flat5)),
  t6 AS (SELECT """ + ", ".join([f"CASE WHEN '{c}' IN (SELECT col FROM lg) THEN ln(1 + {c}) ELSE CAST({c} AS DOUBLE) END AS {c}" for c in NUMBERS_AFTER] + TEXT_AFTER) + """ FROM t5),
  t7 AS (SELECT """ + picks({c: f"coalesce({bin_sql(c, *rule)}, 'nan')" for c, rule in R.BINS.items()} | {c: group_sql(c, R.GROUPS[c]) if c in R.GROUPS else c for c in TEXT_AFTER}
                            | {c: c for c in PLAIN}) + " FROM t6), " + ", ".join(_codes(c, f"k_{c}", "t7") for c in CODED) + ", t8 AS (SELECT " + ", ".join(
    [f"t7.{c} AS {c}" for c in PLAIN] + [f"k_{c}.code AS {c}" for c in CODED]) + " FROM t7 " + " ".join(f"LEFT JOIN k_{c} ON k_{c}.v = t7.{c}" for c in CODED) + f"""),
  {_named(number_stats('t8', [*PLAIN, *CODED]), '_d')}, sc AS (SELECT st_d.col, CASE WHEN abs(skew) < 0.5 THEN mean ELSE med END AS centre,
    CASE WHEN abs(skew) < 0.5 THEN sd ELSE iqr END AS spread, abs(skew) < 0.5 AS standard FROM st_d
    JOIN (SELECT col, count(DISTINCT v) AS d FROM nlong_d GROUP BY col) u ON u.col = st_d.col WHERE d > 2 AND skew IS NOT NULL)"""


@query("f15_nine_steps_encoded", ENCODED + f""", x AS (SELECT l.col, CASE WHEN sc.spread <> 0 THEN (v - centre) / spread ELSE v END AS v FROM nlong_d l LEFT JOIN sc ON sc.col = l.col),
  o AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v, count(*) AS k, row_number() OVER (ORDER BY {c}) AS rn FROM t7 WHERE {c} IS NOT NULL GROUP BY {c}" for c in NOMINAL)}),
  t AS (SELECT count(*) AS n FROM t7) SELECT col AS "column", count(*) AS n, {rd('min(v)', 4)} AS lowest, {rd('max(v)', 4)} AS highest, {rd('sum(v * v)', 2)} AS squares FROM x GROUP BY col
  UNION ALL SELECT col || '_' || v, n, CASE WHEN k = n THEN 1.0 ELSE 0.0 END, 1.0, CAST(k AS DOUBLE) FROM o, t WHERE rn > 1""")
def f15(spark, sf):
    """The encoded table by column: rows, extremes and sum of squares, each column in one row."""
    from peoplelens.functions.expr import number_sql
    from peoplelens.functions.frames import per_column

    encoded = nine_step.run(people(spark, sf)).encoded
    return rounded(per_column(encoded, encoded.columns, lambda c: {
        "n": f"count({number_sql(encoded, c)})", "lowest": f"min({number_sql(encoded, c)})", "highest": f"max({number_sql(encoded, c)})",
        "squares": f"sum({number_sql(encoded, c)} * {number_sql(encoded, c)})"}), 4, squares=2)


# The plan fitted on one half of the people and applied to the other: the tables t0 to t8 once more as u0 to u8, over the other half but with
# the statistics, casing winners, modes, limits, codes and scales of the first.
HALVES = "WITH " + people_sql("everyone") + ", people AS (SELECT * FROM everyone WHERE fnlwgt % 2 = 0), others AS (SELECT * FROM everyone WHERE fnlwgt % 2 = 1)"
FITTED = HALVES + ENCODED[len(P):]


def _table_of(sql: str, name: str) -> str:
    """The common table expression ``name`` with what its brackets hold."""
    start = at = sql.index(f" {name} AS (") + 1
    depth = 0
    while True:
        depth += {"(": 1, ")": -1}.get(sql[at], 0)
        at += 1
        if sql[at - 1] == ")" and not depth:
            return sql[start:at]


APPLIED = ", ".join(re.sub(r"\bt(\d)\b", r"u\1", _table_of(ENCODED, t)).replace("FROM people", "FROM others").replace("SELECT DISTINCT", "SELECT")
                    for t in ("t0", "t1", "t3", "t4", "t5", "t6", "t7", "t8"))
LEVELS = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS col, {c} AS v, row_number() OVER (ORDER BY {c}) AS rn FROM t7 WHERE {c} IS NOT NULL GROUP BY {c}"
                            for i, c in enumerate(sorted(NOMINAL, key=list(COLUMNS).index)))
CELLS = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v, count(*) AS n FROM u7 WHERE {c} IS NOT NULL GROUP BY {c}" for c in NOMINAL)


@query("f15_fitted_plan", FITTED + f""", {APPLIED}, {_named(number_long('u8', [*PLAIN, *CODED]), '_u')},
  x AS (SELECT l.col, CASE WHEN sc.spread <> 0 THEN (v - centre) / spread ELSE v END AS v FROM nlong_u l LEFT JOIN sc ON sc.col = l.col),
  lv AS ({LEVELS}), numbered AS (SELECT col, v, row_number() OVER (ORDER BY place, rn) - 1 AS cell FROM lv WHERE rn > 1), cells AS ({CELLS})
  SELECT col AS "column", count(*) AS n, {rd('min(v)', 4)} AS lowest, {rd('max(v)', 4)} AS highest, {rd('sum(v * v)', 2)} AS squares FROM x GROUP BY col
  UNION ALL SELECT 'one_hot_' || cell, n, 1.0, 1.0, CAST(n AS DOUBLE) FROM numbered JOIN cells ON cells.col = numbered.col AND cells.v = numbered.v
  UNION ALL SELECT 'one_hot_size', (SELECT count(*) FROM others), CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), NULL FROM numbered""")
def f15_fitted(spark, sf):
    """A plan fitted on half of the people, saved, loaded and applied to the other half: extremes and sums of squares of the scaled
    columns, and the rows that set each index of the one-hot vector."""
    from peoplelens.functions.expr import number_sql
    from peoplelens.functions.frames import per_column
    from peoplelens.plans import fitted
    from peoplelens.session import new_folder, staged

    everyone = people(spark, sf)
    plan = fitted.load(spark, fitted.fit(everyone.where("fnlwgt % 2 = 0")).save(new_folder(spark, "plan")))
    done = staged(plan.apply(everyone.where("fnlwgt % 2 = 1")), "applied")
    numbers = [c for c in done.columns if c != "one_hot"]
    scaled = rounded(per_column(done, numbers, lambda c: {
        "n": f"count({number_sql(done, c)})", "lowest": f"min({number_sql(done, c)})", "highest": f"max({number_sql(done, c)})",
        "squares": f"sum({number_sql(done, c)} * {number_sql(done, c)})"}), 4, squares=2)
    cells = done.select(F.explode("one_hot.indices").alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    cells = cells.select(F.concat(F.lit("one_hot_"), F.col("at").cast("string")).alias("column"), "n", F.lit(1.0).alias("lowest"),
                         F.lit(1.0).alias("highest"), F.col("n").cast("double").alias("squares"))
    size = done.agg(F.count("*").alias("n"), F.min("one_hot.size").cast("double").alias("lowest"), F.max("one_hot.size").cast("double").alias("highest"))
    return scaled.unionByName(cells).unionByName(size.select(F.lit("one_hot_size").alias("column"), "n", "lowest", "highest", F.lit(None).cast("double").alias("squares")))


@query("f17_step_statistics", ENCODED + f""" SELECT (SELECT count(*) FROM people) AS rows_before, (SELECT count(*) FROM t3) AS rows_after,
  (SELECT count(*) FROM people) - (SELECT count(*) FROM t3) AS duplicates_dropped, (SELECT count(*) FROM cn_b WHERE actual > 0) AS outlier_columns,
  (SELECT count(*) FROM lg) AS logged, {len(CODED)}::BIGINT AS label_encoded, {len(NOMINAL)}::BIGINT AS one_hot_encoded, 1::BIGINT AS redundant_dropped,
  (SELECT count(*) FROM sc WHERE standard) AS standard_scaled, (SELECT count(*) FROM sc WHERE NOT standard) AS robust_scaled""")
def f17(spark, sf):
    return nine_step.statistics_table(people(spark, sf))


def _version(tag, source):
    return f"SELECT '{tag}' AS version, label, n FROM (SELECT education AS label, count(*) AS n FROM {source} WHERE education IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 10)"


@query("f18_before_after_top", P + f", {binned_sql()} {_version('before', 'people')} UNION ALL {_version('after', 'b')}")
def f18(spark, sf):
    p = people(spark, sf)
    return X.compare_distribution(p, X.bin_and_group(p), "education").drop("lower")


def _bins(tag, source):
    return f"""(WITH x AS (SELECT CAST(fnlwgt AS DOUBLE) AS v FROM {source} WHERE fnlwgt IS NOT NULL), r AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
      SELECT '{tag}' AS version, CAST(CAST(least(floor((v - lo) / (hi - lo) * 30), 29) AS INT) AS VARCHAR) AS label, count(*) AS n FROM x, r GROUP BY 2)"""


@query("f18_before_after_histogram", CLEANED + f" SELECT * FROM {_bins('before', 'people')} UNION ALL SELECT * FROM {_bins('after', 't5')}")
def f18_hist(spark, sf):
    p = people(spark, sf)
    return X.compare_distribution(p, nine_step.clean(p)[0], "fnlwgt").drop("lower")
