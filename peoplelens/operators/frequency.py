"""Frequency table (column, value, n) and everything read from it.

Row order has no meaning here: ties in a count go to the smallest value, and "first examples" are the
smallest values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import (
    col, double_sql, integral_columns, label, name_sql, number_sql, numeric_columns, ranked_first, share, strip, text_columns,
)
from peoplelens.functions.frames import melt, per_column


def text_frequency(df: DataFrame, columns=None, trimmed: bool = False, weight: str | None = None) -> DataFrame:
    """Distinct values of the text columns with their row counts; NULL is left out. A row counts as often as its ``weight`` says."""
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    times = {"n": col(weight)} if weight else {}
    if trimmed:
        return _count(melt(df, {c: strip(col(c).cast("string")) for c in columns}, times), *times)
    return _count(melt(df, {c: f"CAST({name_sql(c)} AS STRING)" for c in columns}, times), *times)


def numeric_frequency(df: DataFrame, columns=None) -> DataFrame:
    """Distinct values of the numeric columns, as double, with their row counts.

    Whole numbers are told apart and counted as such, so that long identifiers do not merge; only then they become doubles.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    whole = [c for c in columns if c in integral_columns(df)]
    parts = []
    if whole:
        counted = _count(melt(df, {c: f"CAST({name_sql(c)} AS BIGINT)" for c in whole}))
        parts.append(counted.select("column", F.col("value").cast("double").alias("value"), "n"))
    if len(whole) < len(columns):
        parts.append(_count(melt(df, {c: number_sql(df, c) for c in columns if c not in whole})))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _count(long: DataFrame, weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(n.alias("n"))


def value_counts(df: DataFrame, column: str, rare_pct: float = R.RARE_PCT) -> DataFrame:
    """Count, share in % and rare flag per value of one column."""
    base = df.select(col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
    counts = base.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    pct = share(F.col("n"), base.agg(F.count(F.lit(1))).scalar(), 100.0)
    return counts.select("value", "n", pct.alias("pct")) \
        .select("*", (F.col("pct") <= rare_pct).alias("rare"))


def value_count_summary(df: DataFrame, column: str, rare_pct: float = R.RARE_PCT) -> DataFrame:
    """Total, distinct and rare-value count of one column."""
    return value_counts(df, column, rare_pct).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.count_if("rare").alias("rare_values"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ``limit`` after a sort keeps k rows per task."""
    return df.select(col(column).cast("string").alias("value")).where(F.col("value").isNotNull()) \
        .groupBy("value").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.asc("value")).limit(k)


def column_modes(df: DataFrame, columns=None) -> DataFrame:
    """Most frequent value of every text column."""
    return text_frequency(df, columns).groupBy("column").agg(
        ranked_first(F.col("value"), F.col("n")).alias("mode"), F.max("n").alias("n"))


def dominance(df: DataFrame, columns=None) -> DataFrame:
    """Most frequent value of every numeric column with count, share and distinct values."""
    return numeric_frequency(df, columns).groupBy("column").agg(
        ranked_first(F.col("value"), F.col("n")).alias("dominant_value"),
        F.max("n").alias("dominant_count"),
        share(F.max("n"), F.sum("n"), 100.0).alias("dominant_pct"),
        (F.sum("n") - F.max("n")).alias("other_count"),
        F.count(F.lit(1)).alias("distinct_values"))


def low_variance(df: DataFrame, columns=None, threshold: float = R.LOW_VARIANCE_SHARE) -> DataFrame:
    """Numeric columns in which one value fills at least ``threshold`` (over one half) of the non-null rows.

    Such a value is the median whatever else the column holds. So the sketched median is counted in one pass, with room for the
    sketch's error, and values are shuffled only for the columns that pass this test.
    """
    if threshold <= 0.5:
        raise ValueError("a share of one half or less need not be the median")
    columns = numeric_columns(df) if columns is None else list(columns)
    schema = "column string, dominant_value double, dominant_pct double, distinct_values bigint"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    middles = {r["column"]: r["m"] for r in per_column(df, columns, lambda c: {
        "m": f"percentile_approx({number_sql(df, c)}, 0.5D, 1000)"}).collect()}
    known = [c for c in columns if middles[c] is not None]
    hits = per_column(df, known, lambda c: {
        "n": f"count({number_sql(df, c)})", "k": f"count_if({number_sql(df, c)} = {double_sql(middles[c])})"}).collect() if known else []
    flat = [r["column"] for r in hits if r["k"] >= threshold * r["n"]]
    if not flat:
        return df.sparkSession.createDataFrame([], schema)
    return dominance(df, flat).where(F.col("dominant_pct") >= threshold * 100.0).select(
        "column", "dominant_value", F.round("dominant_pct", 1).alias("dominant_pct"), "distinct_values")


def hierarchy(df: DataFrame, path: list[str]) -> DataFrame:
    """Counts at every level of a path of columns with the share of the parent.

    The finest level is counted once; coarser levels and parents are sums over those counts.
    """
    names = [f"l{i}" for i in range(len(path))]
    finest = df.select(*[label(col(c)).alias(n) for c, n in zip(path, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.struct(
        F.lit(i + 1).alias("level"), *[F.col(n) if k <= i else F.lit(None).cast("string").alias(n) for k, n in enumerate(names)])
        for i in range(len(names))]))
    counted = finest.select("n", levels.alias("x")).select("n", "x.*").groupBy("level", *names).agg(F.sum("n").alias("n"))
    # The parent of a row is the row without its last label.
    parent = [F.when(F.col("level") > i + 1, F.col(n)).alias(f"p{i}") for i, n in enumerate(names)]
    total = F.sum("n").over(Window.partitionBy("level", *[f"p{i}" for i in range(len(names))]))
    return counted.select("*", *parent).select("level", *names, "n", share(F.col("n"), total).alias("parent_share"))


def grouped_counts(df: DataFrame, row: str, hue: str, top: int | None = None) -> DataFrame:
    """Cross-tab of two columns in long form (row, hue, n, total), for the ``top`` largest rows or all; absent cells are 0 rows."""
    base = df.select(col(row).cast("string").alias("row"), col(hue).cast("string").alias("hue")) \
        .where(F.col("row").isNotNull() & F.col("hue").isNotNull())
    cells = base.groupBy("row", "hue").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("row").agg(F.sum("n").alias("total"))
    if top is not None:
        totals = totals.orderBy(F.desc("total"), F.asc("row")).limit(top)
    return cells.join(totals, "row").select("row", "hue", "n", "total")
