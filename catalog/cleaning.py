"""Cleaning (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.audit import MODE_CTE, OUTLIERS
from catalog.people import NUMERIC, TEXT, people
from catalog.registry import P, big, noise_sql, number_stats, pct, query, rd, rounded, table, text_long
from catalog.statistics import ALL
from peoplelens.operators import cleaning as C
from peoplelens.operators import outliers as O
from peoplelens.rules import Rules


def picks(change: dict, columns=ALL) -> str:
    return ", ".join(f"{change[c]} AS {c}" if c in change else c for c in columns)


@query("c1_trim_text", P + " SELECT " + picks({c: f"trim({c})" for c in TEXT}) + " FROM people")
def c1(spark, sf):
    return C.trim_text(people(spark, sf))


CASE_MAP = """cf AS (SELECT col, v, n, row_number() OVER (PARTITION BY col, lower(v) ORDER BY n DESC, v) AS rn,
   first_value(v) OVER (PARTITION BY col, lower(v) ORDER BY n DESC, v) AS winner FROM tf),
  cm AS (SELECT col, v, winner FROM cf WHERE rn > 1)"""


@query("c2_canonical_casing", P + f", {text_long()}, {CASE_MAP} SELECT " + picks(
    {c: f"coalesce((SELECT winner FROM cm WHERE cm.col = '{c}' AND cm.v = people.{c}), people.{c})" for c in TEXT}) + " FROM people")
def c2(spark, sf):
    return C.unify_casing(people(spark, sf))


# Text and doubles that the schema wants as whole numbers, and numbers that it wants as text.
DIRTY = """age AS raw, CASE WHEN fnlwgt % 11 = 0 THEN 'n/a' WHEN fnlwgt % 11 = 1 THEN ' ' || CAST(age AS VARCHAR(20)) || '.5'
  ELSE CAST(age AS VARCHAR(20)) END AS age, CAST(education_num AS DOUBLE) + 0.5 AS education_num,
  CASE WHEN fnlwgt % 7 = 0 THEN '1e1' ELSE CAST(hours_per_week AS VARCHAR(20)) END AS hours_per_week, capital_loss AS race, fnlwgt"""


def _dirty(spark, sf):
    return people(spark, sf).selectExpr(*[e.strip() for e in _split(DIRTY.replace("VARCHAR(20)", "STRING"))])


def _split(text):
    depth, part, out = 0, "", []
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


@query("c3_schema_types", P + f""", d AS (SELECT {DIRTY} FROM people) SELECT raw, CAST(round_even(TRY_CAST(trim(age) AS DOUBLE), 0) AS BIGINT) AS age,
  CAST(round_even(education_num, 0) AS BIGINT) AS education_num, TRY_CAST(hours_per_week AS DOUBLE) AS hours_per_week,
  CAST(race AS VARCHAR) AS race, fnlwgt FROM d""")
def c3(spark, sf):
    return C.cast_types(_dirty(spark, sf))


@query("c4_auto_cast", P + " SELECT badge_no AS original, TRY_CAST(badge_no AS BIGINT) AS badge_no, team FROM people")
def c4(spark, sf):
    p = people(spark, sf).select(F.col("badge_no").alias("original"), "badge_no", "team")
    return C.cast_types(p, decisions=C.decide_types(p.select("badge_no", "team")))


@query("c5_type_cast_preview", P + f""", d AS (SELECT {DIRTY}, badge_no, team FROM people)
  SELECT * FROM (SELECT 'age' AS "column", 'string' AS current_type, 'bigint' AS target_type, 'Schema' AS origin,
    count(TRY_CAST(trim(age) AS DOUBLE)) AS convertible, {pct('count(TRY_CAST(trim(age) AS DOUBLE))', 'count(age)')} AS convertible_pct FROM d
   UNION ALL SELECT 'education_num', 'double', 'bigint', 'Schema', count(education_num), {rd('100')} FROM d
   UNION ALL SELECT 'hours_per_week', 'string', 'double', 'Schema', count(hours_per_week), {rd('100')} FROM d
   UNION ALL SELECT 'badge_no', 'string', 'bigint', 'Auto', count(TRY_CAST(badge_no AS DOUBLE)),
     {pct('count(TRY_CAST(badge_no AS DOUBLE))', 'count(badge_no)')} FROM d)""")
def c5(spark, sf):
    exprs = [e.strip() for e in _split(DIRTY.replace("VARCHAR(20)", "STRING"))]
    return rounded(C.type_cast_preview(people(spark, sf).selectExpr(*exprs, "badge_no", "team")))


@query("c6_text_issue_preview", P + f""", {text_long()}, g AS (SELECT col, lower(trim(v)) AS k, count(*) AS variants,
  sum(CASE WHEN v <> trim(v) THEN n ELSE 0 END) AS cells FROM tf GROUP BY 1, 2)
  SELECT col AS "column", {big('sum(cells)')} AS whitespace_cells, count(*) FILTER (variants > 1) AS casing_groups FROM g GROUP BY col
  HAVING sum(cells) > 0 OR count(*) FILTER (variants > 1) > 0""")
def c6(spark, sf):
    return C.text_issue_preview(people(spark, sf))


@query("c7_noise_to_null", P + " SELECT " + picks({c: f"CASE WHEN {noise_sql(c)} THEN NULL ELSE {c} END" for c in TEXT}) + " FROM people")
def c7(spark, sf):
    return C.clean_noise(people(spark, sf))


CLEAN_MODE = f"""cm AS (SELECT col, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn FROM tf WHERE NOT {noise_sql('v')}) WHERE rn = 1)"""


@query("c7_noise_to_mode", P + f", {text_long()}, {CLEAN_MODE} SELECT " + picks(
    {c: f"CASE WHEN {noise_sql(c)} THEN (SELECT v FROM cm WHERE col = '{c}') ELSE {c} END" for c in TEXT}) + " FROM people")
def c7_mode(spark, sf):
    return C.clean_noise(people(spark, sf), "replace_mode")


@query("c7_noise_drop_rows", P + " SELECT * FROM people WHERE " + " AND ".join(f"NOT coalesce({noise_sql(c)}, false)" for c in TEXT))
def c7_drop(spark, sf):
    return C.clean_noise(people(spark, sf), "drop")


@query("c8_noise_preview", P + f""", {text_long()}, noisy AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS rn FROM tf WHERE {noise_sql('v')})
  SELECT col AS "column", {big('sum(n)')} AS noise_count, string_agg(v, ', ' ORDER BY v) FILTER (rn <= 4) AS examples FROM noisy GROUP BY col""")
def c8(spark, sf):
    return C.noise_report(people(spark, sf), examples=4)


@query("c9_drop_duplicates", P + " SELECT DISTINCT * FROM people")
def c9(spark, sf):
    return C.drop_duplicates(people(spark, sf))


STRATEGY = "CASE WHEN skew IS NOT NULL AND abs(skew) < 0.5 THEN 'mean' ELSE 'median' END"


@query("c10_fill_strategy", P + f""", {number_stats()} SELECT col AS "column", skew AS skewness, {STRATEGY} AS strategy FROM st
  UNION ALL SELECT unnest([{', '.join(f"'{c}'" for c in TEXT)}]), NULL, 'mode'""")
def c10(spark, sf):
    return C.fill_strategies(people(spark, sf))


FILL_NUM = f"(SELECT CAST(round_even(CASE WHEN {STRATEGY} = 'mean' THEN mean ELSE med END, 0) AS BIGINT) FROM st WHERE col = '%s')"


@query("c11_impute", P + f", {number_stats()}, {text_long()}, {MODE_CTE} SELECT " + picks(
    {c: f"coalesce({c}, {FILL_NUM % c})" for c in NUMERIC} | {c: f"coalesce({c}, (SELECT v FROM md WHERE col = '{c}'))" for c in TEXT}) + " FROM people")
def c11(spark, sf):
    return C.impute(people(spark, sf))


@query("c12_missing_preview", P + f""", {number_stats()}, g AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS col, '{"Numeric" if c in NUMERIC else "Categorical"}' AS class, count(*) - count({c}) AS missing,
    {pct(f"(count(*) - count({c}))", "count(*)")} AS missing_pct FROM people''' for c in ALL)})
  SELECT g.col AS "column", class, missing, missing_pct, skew AS skewness,
  CASE WHEN class = 'Categorical' THEN 'Mode' WHEN {STRATEGY} = 'mean' THEN 'Mean' ELSE 'Median' END AS strategy
  FROM g LEFT JOIN st ON st.col = g.col WHERE missing > 0""")
def c12(spark, sf):
    return rounded(C.missing_preview(people(spark, sf)))


TREATMENT = "actual > 0 AS treated, zoned AND raw > 0 AS shielded"


@query("c13_outlier_preview", P + f""", {OUTLIERS} SELECT st.col AS "column", lo AS min, hi AS max, skew AS skewness, method, {big('actual')} AS outliers,
  {pct('actual', 'n')} AS outlier_pct, {TREATMENT}, zoned AS has_safe_zone FROM st JOIN cn ON st.col = cn.col""")
def c13(spark, sf):
    return rounded(O.preview(people(spark, sf)))


@query("c14_fence_table", P + f""", {OUTLIERS} SELECT st.col AS "column", lo AS min, hi AS max, skew AS skewness, method,
  {rd('CASE WHEN zero_spread THEN NULL ELSE lower_limit END', 4)} AS lower_limit, {rd('CASE WHEN zero_spread THEN NULL ELSE upper_limit END', 4)} AS upper_limit,
  {big('raw')} AS outliers, {rd('CAST(raw AS DOUBLE) / n * 100', 4)} AS outlier_pct, {TREATMENT} FROM st JOIN cn ON st.col = cn.col""")
def c14(spark, sf):
    return rounded(O.fence_table(people(spark, sf)), 4)


NO_ZONES = Rules(safe_zones={})


def _cap(source, c, columns, low, high, test):
    return f"""{number_stats(source, [c])} SELECT {columns}, {rd(f'CASE WHEN {test} THEN greatest({low}, least({high}, CAST({c} AS DOUBLE))) ELSE {c} END')} AS {c}
      FROM {source} s, st"""


@query("c15_iqr_capping", P + ", " + _cap("people", "age", "fnlwgt, sex", "q1 - 1.5 * iqr", "q3 + 1.5 * iqr",
                                          "iqr > 0 AND (age < q1 - 1.5 * iqr OR age > q3 + 1.5 * iqr)"))
def c15(spark, sf):
    p = people(spark, sf).select("fnlwgt", "sex", F.col("age").cast("double").alias("age"))
    return rounded(O.treat(p, "iqr_capping", ["age"], 1.5, NO_ZONES))


@query("c16_zscore_capping", "WITH " + _cap("events", "value", "event_id", "mean - 3 * sd", "mean + 3 * sd", "abs((value - mean) / sd) > 3.0"))
def c16(spark, sf):
    return rounded(O.treat(table(spark, sf, "events").select("event_id", "value"), "zscore_capping", ["value"], 3.0))


@query("c17_modified_zscore_capping", "WITH " + _cap("events", "value", "event_id", "med - 3 * mad / 0.6745", "med + 3 * mad / 0.6745",
                                                     "abs(0.6745 * (value - med) / mad) > 3.0"))
def c17(spark, sf):
    return rounded(O.treat(table(spark, sf, "events").select("event_id", "value"), "modified_zscore_capping", ["value"], 3.0))


@query("c18_zscore_removal", P + f""", {number_stats('people', ['hours_per_week'])} SELECT fnlwgt, hours_per_week FROM people, st
  WHERE hours_per_week IS NULL OR NOT (abs((hours_per_week - mean) / sd) > 2.0)""")
def c18(spark, sf):
    return O.treat(people(spark, sf).select("fnlwgt", "hours_per_week"), "zscore_removal", ["hours_per_week"], 2.0)


@query("c19_safe_zone_capping", P + f""", {number_stats('people', ['age'])} SELECT fnlwgt,
  CASE WHEN (age < q1 - 1.5 * iqr OR age > q3 + 1.5 * iqr) AND (age < 10 OR age > 90) THEN greatest(10, least(90, age)) ELSE age END AS age FROM people, st""")
def c19(spark, sf):
    return O.treat(people(spark, sf).select("fnlwgt", "age"), "iqr_capping", ["age"])


@query("c20_outlier_dispatcher", P + f""", {number_stats()} SELECT sex,
  CASE WHEN age > 90 AND (SELECT abs((people.age - mean) / sd) > 3.0 FROM st WHERE col = 'age') THEN 90
       WHEN age < 10 AND (SELECT abs((people.age - mean) / sd) > 3.0 FROM st WHERE col = 'age') THEN 10 ELSE age END AS age,
  {rd("CASE WHEN (SELECT abs((people.hours_per_week - mean) / sd) > 3.0 FROM st WHERE col = 'hours_per_week') THEN (SELECT greatest(mean - 3 * sd, least(mean + 3 * sd, CAST(people.hours_per_week AS DOUBLE))) FROM st WHERE col = 'hours_per_week') ELSE hours_per_week END")} AS hours_per_week FROM people""")
def c20(spark, sf):
    p = people(spark, sf).select("sex", "age", F.col("hours_per_week").cast("double").alias("hours_per_week"))
    return rounded(O.treat(p, "zscore_capping", ["sex", "age", "hours_per_week"], 3.0))


@query("c20_unknown_method", P + f""", {number_stats('people', ['age', 'hours_per_week'])}, a AS (SELECT * FROM st WHERE col = 'age')
  SELECT hours_per_week, CASE WHEN (age < q1 - 1.5 * iqr OR age > q3 + 1.5 * iqr) AND (age < 10 OR age > 90) THEN greatest(10, least(90, age)) ELSE age END AS age FROM people, a""")
def c20_unknown(spark, sf):
    return O.treat(people(spark, sf).select("hours_per_week", "age"), "something_else", ["age", "hours_per_week"])


OUTER = "' ' || " + " || ".join(f"chr({i})" for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160))


@query("c1_trim_text_conversations", f"SELECT conv_id, turn, trim(role, {OUTER}) AS role, trim(text, {OUTER}) AS text FROM conversations")
def c1_conversations(spark, sf):
    return C.trim_text(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@query("c9_drop_duplicates_documents", "SELECT DISTINCT text, lang, source FROM documents")
def c9_documents(spark, sf):
    return C.drop_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))
