"""Registry of queries and SQL, and the pieces of SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.people import NUMERIC, TEXT, people_sql
from peoplelens import rules as R
from peoplelens.functions.expr import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns a negative zero positive."""
    return df.select(*[
        (F.round(col(f.name), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else col(f.name) for f in df.schema.fields])


def rd(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def pct(part: str, whole: str, digits: int = 6) -> str:
    return rd(f"CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100", digits)


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


P = "WITH " + people_sql()

NOISE_SQL = "(" + ", ".join("'" + t + "'" for t in R.NOISE_TOKENS) + ")"


def noise_sql(v: str) -> str:
    return (f"(lower(trim({v})) IN {NOISE_SQL} OR trim({v}) = '' "
            f"OR (length({v}) = 1 AND NOT regexp_matches({v}, '^[\\p{{L}}\\p{{N}}]$')))")


def text_long(source: str = "people", columns=TEXT, name: str = "tlong") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v FROM {source} WHERE {c} IS NOT NULL" for c in columns)
    return f"{name} AS ({parts}), tf AS (SELECT col, v, count(*) AS n FROM {name} GROUP BY col, v)"


def number_long(source: str = "people", columns=NUMERIC, name: str = "nlong") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL" for c in columns) + ")"


def number_stats(source: str = "people", columns=NUMERIC) -> str:
    """CTEs nlong, st: moments, quartiles, MAD, method and limits per numeric column."""
    return f"""{number_long(source, columns)},
    m0 AS (SELECT col, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd,
             CASE WHEN count(*) < 3 THEN NULL WHEN min(v) = max(v) THEN 0.0 ELSE round(skewness(v), 3) + CAST(0 AS DOUBLE) END AS skew,
             min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med,
             quantile_cont(v, 0.75) AS q3 FROM nlong GROUP BY col),
    m1 AS (SELECT l.col, quantile_cont(abs(l.v - m0.med), 0.5) AS mad FROM nlong l JOIN m0 ON l.col = m0.col GROUP BY l.col),
    m2 AS (SELECT m0.*, m1.mad, m0.q3 - m0.q1 AS iqr,
             CASE WHEN m0.skew IS NULL THEN 'IQR' WHEN abs(m0.skew) < 0.5 THEN 'Z-Score' WHEN abs(m0.skew) <= 1.0 THEN 'IQR'
                  WHEN m1.mad = 0 THEN 'IQR' ELSE 'Modified Z-Score' END AS method,
             (m0.skew IS NOT NULL AND abs(m0.skew) > 1.0 AND m1.mad = 0) AS fallback,
             (m0.skew IS NOT NULL AND abs(m0.skew) > 1.0 AND m1.mad = 0 AND m0.q3 = m0.q1) AS zero_spread
           FROM m0 JOIN m1 ON m0.col = m1.col),
    st AS (SELECT *,
             CASE method WHEN 'IQR' THEN CASE WHEN iqr > 0 THEN q1 - 1.5 * iqr END
                         WHEN 'Z-Score' THEN CASE WHEN sd > 0 THEN mean - 3.0 * sd END
                         ELSE med - 3.0 * mad / 0.6745 END AS lower_limit,
             CASE method WHEN 'IQR' THEN CASE WHEN iqr > 0 THEN q3 + 1.5 * iqr END
                         WHEN 'Z-Score' THEN CASE WHEN sd > 0 THEN mean + 3.0 * sd END
                         ELSE med + 3.0 * mad / 0.6745 END AS upper_limit
           FROM m2)"""


OUTLIER_SQL = """(CASE st.method
    WHEN 'IQR' THEN st.iqr > 0 AND (l.v < st.lower_limit OR l.v > st.upper_limit)
    WHEN 'Z-Score' THEN st.sd > 0 AND abs((l.v - st.mean) / st.sd) > 3.0
    ELSE st.mad > 0 AND abs(0.6745 * (l.v - st.med) / st.mad) > 3.0 END)"""

ZONES_SQL = "zones(col, zmin, zmax) AS (VALUES " + ", ".join(
    f"('{c}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for c, (lo, hi) in R.SAFE_ZONES.items()) + ")"


def in_unpivot(columns, expression) -> str:
    """UNION ALL of one select per column."""
    return " UNION ALL ".join(expression(c) for c in columns)


def bin_sql(c: str, edges, labels) -> str:
    out = f"CASE WHEN {c} >= {edges[0]} AND {c} <= {edges[1]} THEN '{labels[0]}'"
    for lo, hi, name in zip(edges[1:], edges[2:], labels[1:]):
        upper = "" if hi == float("inf") else f" AND {c} <= {hi}"
        out += f" WHEN {c} > {lo}{upper} THEN '{name}'"
    return out + " END"


def group_sql(c: str, groups: dict) -> str:
    whens = " ".join(
        f"WHEN {c} IN (" + ", ".join(f"'{m}'" for m in members) + f") THEN '{g}'" for g, members in groups.items())
    return f"CASE {whens} ELSE {c} END"


HIGH_SQL = "coalesce(contains(lower(trim(income)), '>50k'), false)"


def binned_sql(name: str = "b") -> str:
    """CTE with every rule column binned or grouped, plus raw numbers and the target flag."""
    picks = [f"{bin_sql(c, *rule)} AS {c}" for c, rule in R.BINS.items()]
    picks += [f"{group_sql(c, g)} AS {c}" for c, g in R.GROUPS.items()]
    rest = [c for c in (*NUMERIC, *TEXT) if c not in R.BINS and c not in R.GROUPS]
    raw = "age AS raw_age, hours_per_week AS raw_hours, capital_gain AS gain"
    return f"{name} AS (SELECT {', '.join(picks + rest)}, {raw}, {HIGH_SQL} AS hi FROM people)"


def lab(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"
