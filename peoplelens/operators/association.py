"""Association with a binary target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import (
    col, is_target, name_sql, number_sql, numeric_columns, pearson, pearson_sql, text_columns,
)
from peoplelens.functions.frames import melt, per_column


def _contingency_stats(cells: DataFrame) -> DataFrame:
    """One row (n, r, c, chi2) from the counted cells of two fields.

    With row totals R and column totals C, chi² = n·(Σ O²/(R·C) - 1), so absent cells need no rows. Only a 2×2
    table takes Yates' correction; there |O - E| is the same d in all cells, and chi² = (d - min(½, d))²·Σ 1/E.
    """
    joined = cells.select("a", "b", "n", F.sum("n").over(Window.partitionBy("a")).alias("row_n"),
                          F.sum("n").over(Window.partitionBy("b")).alias("col_n"))
    n = F.sum("n").cast("double")
    pearson_sum = F.sum(F.col("n") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n")))
    one = F.min(F.struct("a", "b", "n", "row_n", "col_n"))
    base = joined.agg(
        n.alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"),
        pearson_sum.alias("s"), one.alias("cell"))
    d = F.abs(F.col("cell.n") - F.col("cell.row_n") * F.col("cell.col_n") / F.col("n"))
    # Both totals of a 2×2 table follow from one cell's row and column total.
    inverse = F.col("n") * (
        F.try_divide(F.lit(1.0), F.col("cell.row_n")) + F.try_divide(F.lit(1.0), F.col("n") - F.col("cell.row_n"))) * (
        F.try_divide(F.lit(1.0), F.col("cell.col_n")) + F.try_divide(F.lit(1.0), F.col("n") - F.col("cell.col_n")))
    yates = F.pow(d - F.least(F.lit(0.5), d), F.lit(2.0)) * inverse
    plain = F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1))
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(plain)
    return base.select("n", "r", "c", chi2.alias("chi2"))


def _v(chi2: Column, n: Column, r: Column, c: Column) -> Column:
    small = F.least(r, c) - 1
    return F.when((r < 2) | (c < 2), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(chi2, n * small)))


def cramers_v(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cramér's V of two categorical expressions over rows where both are known: n, r, c, chi2, v."""
    cells = df.select(a.cast("string").alias("a"), b.cast("string").alias("b")) \
        .where(F.col("a").isNotNull() & F.col("b").isNotNull()) \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    s = _contingency_stats(cells)
    return s.select(F.col("n").cast("bigint").alias("n"), "r", "c", "chi2",
                    _v(F.col("chi2"), F.col("n"), F.col("r"), F.col("c")).alias("v"))


def corrected_v(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Bias-corrected variant of Cramér's V."""
    n, r, c = F.col("n").cast("double"), F.col("r"), F.col("c")
    phi = F.greatest(F.lit(0.0), F.try_divide(F.col("chi2"), n) - F.try_divide(((r - 1) * (c - 1)).cast("double"), n - 1))
    rt = r - F.try_divide(((r - 1) * (r - 1)).cast("double"), n - 1)
    ct = c - F.try_divide(((c - 1) * (c - 1)).cast("double"), n - 1)
    low = F.least(rt, ct) - 1
    v = F.when((r < 2) | (c < 2) | (low <= 0), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(phi, low)))
    return cramers_v(df, a, b).select("n", "r", "c", "chi2", v.alias("v_corrected"))


def point_biserial(df: DataFrame, x: Column, target: Column) -> DataFrame:
    """Correlation of a number with a binary target on complete pairs; fewer than ten pairs give 0."""
    y = target.cast("double")
    pairs = F.count_if(x.isNotNull() & y.isNotNull())
    return df.agg(pairs.alias("n"), F.when(pairs < 10, F.lit(0.0)).otherwise(pearson(x, y)).alias("r"))


def association_scores(df: DataFrame, target_column: str, minimum: float = R.ASSOCIATION_MIN,
                       target: Column | None = None) -> DataFrame:
    """Association of every other column with the target, at or above ``minimum``, strongest first.

    Text columns share one shuffle of (column, value) counts split by target class. Because the target is binary,
    chi² needs only sums over values per column, so no totals are joined back. Numbers share one pass.
    """
    high = is_target(col(target_column)) if target is None else target
    texts = [c for c in text_columns(df) if c != target_column]
    numbers = [c for c in numeric_columns(df) if c != target_column]
    parts = []
    if texts:
        # ``filled`` counts the column's own values, with or without a target: ten of them make it worth ranking.
        counts = melt(df, {c: name_sql(c) for c in texts}, {"high": F.when(col(target_column).isNotNull(), high.cast("bigint"))}) \
            .where(F.col("value").isNotNull()).groupBy("column", "value") \
            .agg(F.count("high").alias("n"), F.sum("high").alias("h"), F.count(F.lit(1)).alias("filled"))
        h, n = F.col("h").cast("double"), F.when(F.col("n") > 0, F.col("n").cast("double"))
        sums = counts.groupBy("column").agg(
            F.sum("filled").alias("filled"),
            F.sum("n").cast("double").alias("total"), F.sum("h").cast("double").alias("total_h"),
            F.count(n).alias("r"), F.sum(h * h / n).alias("hh"), F.sum((n - h) * (n - h) / n).alias("ss"),
            F.sum(1 / n).alias("inverse"), F.min(F.when(n.isNotNull(), F.struct("value", "n", "h"))).alias("cell"))
        total, th = F.col("total"), F.col("total_h")
        ts = total - th
        plain = total * (F.try_divide(F.col("hh"), th) + F.try_divide(F.col("ss"), ts) - 1)
        d = F.abs(F.col("cell.h") - F.col("cell.n") * th / total)
        yates = F.pow(d - F.least(F.lit(0.5), d), F.lit(2.0)) * total * F.col("inverse") * (
            F.try_divide(F.lit(1.0), th) + F.try_divide(F.lit(1.0), ts))
        chi2 = F.when(F.col("r") == 2, yates).otherwise(F.greatest(F.lit(0.0), plain))
        v = F.when((F.col("r") < 2) | (th == 0) | (ts == 0), F.lit(0.0)).otherwise(F.sqrt(chi2 / total))
        parts.append(sums.where("filled >= 10 AND total > 0").select(
            F.col("column").alias("attribute"), v.alias("association"), F.lit("Cramér's V").alias("method")))
    if numbers:
        rows = per_column(df.select("*", high.cast("double").alias("_y")), numbers, lambda c: {
            "n": f"count({number_sql(df, c)})", "association": f"abs({pearson_sql(number_sql(df, c), '_y')})"})
        parts.append(rows.where(F.col("n") >= 10).select(
            F.col("column").alias("attribute"), "association", F.lit("Point-Biserial").alias("method")))
    if not parts:
        return df.sparkSession.createDataFrame([], "attribute string, association double, method string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("association") >= minimum) \
        .orderBy(F.desc("association"), F.asc("attribute"))


def strength_label(r: Column) -> Column:
    return F.when(F.abs(r) < 0.15, "weak").when(F.abs(r) < 0.35, "moderate").otherwise("strong")

