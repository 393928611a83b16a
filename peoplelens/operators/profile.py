"""Numeric profile: moments, adjusted skewness, quantiles, MAD, histograms, correlation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.functions.expr import (
    col, double_sql, integral_columns, label, number, number_sql, numeric_columns, pearson_sql, text_sql,
)
from peoplelens.functions.frames import per_column, small_frame
from peoplelens.functions.quantiles import column_quantiles, grouped_quantiles, sketch_sql

QUARTILES = (0.25, 0.5, 0.75)


def skewness_sql(x: str) -> str:
    """Bias-adjusted skewness aggregate; NULL under three values, 0 for a constant column."""
    n = f"CAST(count({x}) AS DOUBLE)"
    return (f"CASE WHEN count({x}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0D "
            f"ELSE skewness({x}) * sqrt({n} * ({n} - 1)) / ({n} - 2) END")


def moments(df: DataFrame, columns=None, probs=()) -> DataFrame:
    """One row per numeric column: n, missing, mean, std, skewness, min, max, and a sketch around ``probs`` if there are any.

    All columns share one pass without a shuffle of rows.
    """
    columns = numeric_columns(df) if columns is None else list(columns)

    def make(c):
        x = number_sql(df, c)
        return {"n": f"count({x})", "missing": f"count(1) - count({x})", "mean": f"avg({x})",
                "std": f"stddev_samp({x})", "skewness": skewness_sql(x), "min": f"min({x})", "max": f"max({x})",
                **({"sketch": sketch_sql(x, probs)} if probs else {})}

    return per_column(df, columns, make)


@dataclass(frozen=True)
class Profile:
    """Fitted numbers of one numeric column."""

    column: str
    n: int
    missing: int
    mean: float | None
    std: float | None
    skew: float | None
    low: float | None
    high: float | None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    mad: float | None = None
    integral: bool = False

    @property
    def iqr(self):
        return None if self.q1 is None else self.q3 - self.q1


def fit_profiles(df: DataFrame, columns=None, quantiles: bool = True, mad: bool = True) -> dict[str, Profile]:
    """Profiles of the numeric columns: three scans for moments and quartiles, three more for the MAD.

    Skewness is rounded to three digits here, before any threshold is applied to it.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return {}
    whole = integral_columns(df)
    rows = {r["column"]: r for r in moments(df, columns, QUARTILES if quantiles or mad else ()).collect()}
    quarts, mads = {}, {}
    if quantiles or mad:
        quarts = column_quantiles(df, {c: number_sql(df, c) for c in columns}, QUARTILES,
                                  {c: (r["n"], r["min"], r["max"], r["sketch"]) for c, r in rows.items()})
    if mad:
        mads = column_quantiles(df, {c: f"abs({number_sql(df, c)} - {double_sql(quarts[c][1])})"
                                     for c in columns if quarts[c][1] is not None}, (0.5,))
    out = {}
    for c in columns:
        r = rows[c]
        q1, med, q3 = quarts.get(c, (None, None, None))
        skew = r["skewness"]
        out[c] = Profile(c, r["n"], r["missing"], r["mean"], r["std"],
                         None if skew is None else round(skew, 3) + 0.0, r["min"], r["max"], q1, med, q3, mads.get(c, [None])[0], c in whole)
    return out


def quantile_table(df: DataFrame, columns=None) -> DataFrame:
    """Quartiles, IQR and MAD, one row per column."""
    fitted = fit_profiles(df, columns)
    return small_frame(
        df.sparkSession, "column string, q1 double, median double, q3 double, iqr double, mad double",
        [(p.column, p.q1, p.median, p.q3, p.iqr, p.mad) for p in fitted.values()])


def _bounds(df: DataFrame, column: str):
    r = df.agg(F.min(number(df, column)).alias("lo"), F.max(number(df, column)).alias("hi")).first()
    return r["lo"], r["hi"]


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width counts and densities, optionally per group, over common edges; empty bins have no row.

    The largest value falls into the last bin.
    """
    lo, hi = _bounds(df, column)
    x = number(df, column)
    keys = ["grp", "bin"] if by else ["bin"]
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins
    slot = F.lit(0) if hi == lo else F.least(
        F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int"), F.lit(bins - 1))
    base = df.where(x.isNotNull()).select(slot.alias("bin"), *([label(col(by)).alias("grp")] if by else []))
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if by:
        joined = counts.join(base.groupBy("grp").agg(F.count(F.lit(1)).alias("total")), "grp")
    else:
        joined = counts.select("*", base.agg(F.count(F.lit(1))).scalar().alias("total"))
    density = F.try_divide(F.col("n").cast("double"), F.col("total") * F.lit(width)) if width else F.lit(None)
    return joined.select(*keys, (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                         "n", density.cast("double").alias("density"))


def normal_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Normal density at evenly spaced points between the column's minimum and maximum."""
    x = number(df, column)
    fit = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    z = F.try_divide(F.col("x") - F.col("mu"), F.col("sd"))
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")) \
        .withColumn("x", at) \
        .select("i", "x", F.try_divide(F.exp(-z * z / 2), F.col("sd") * F.lit(sqrt(2 * 3.141592653589793))).alias("y"))


def grouped_density(df: DataFrame, column: str, by: str, points: int = 64) -> DataFrame:
    """(grp, i, x, density) of a Gaussian kernel density for each group, over one grid from the column's minimum to its maximum.

    Every value gives its weight to the two grid points around it in proportion to its nearness, so a group is at most ``points`` weights whatever its
    size; the kernel is then summed over the grid. The bandwidth of a group is std * n^(-1/5). Groups without spread have no density.
    """
    lo, hi = _bounds(df, column)
    if lo is None or lo == hi:
        return small_frame(df.sparkSession, "grp string, i int, x double, density double", [])
    step = (hi - lo) / (points - 1)
    base = df.select(label(col(by)).alias("grp"), number(df, column).alias("v")).where(F.col("v").isNotNull())
    place = (F.col("v") - F.lit(lo)) / F.lit(step)
    left = F.least(F.floor(place).cast("int"), F.lit(points - 2))
    shares = base.select("grp", left.alias("j"), (place - left).alias("w"))
    weights = shares.groupBy("grp", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    weights = weights.select("grp", F.inline(F.array(F.struct("j", (F.col("n") - F.col("w")).alias("w")), F.struct((F.col("j") + 1).alias("j"), F.col("w").alias("w")))))
    weights = weights.groupBy("grp", "j").agg(F.sum("w").alias("w"))
    widths = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("std")).where(F.col("std") > 0).select(
        "grp", "n", (F.col("std") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    cells = weights.join(widths, "grp").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    z = (F.col("i") - F.col("j")) * F.lit(step) / F.col("h")
    return cells.groupBy("grp", "i").agg(
        (F.sum(F.col("w") * F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * F.lit(sqrt(2 * 3.141592653589793)))).alias("density")).select(
        "grp", "i", (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), "density")


def binned_scatter(df: DataFrame, x: str, y: str, hue: str | None = None, bins: int = 40) -> DataFrame:
    """(x_bin, y_bin, x, y, n) of the square bins that hold complete pairs, per colour if there is one; x and y are the middles of a bin.

    Both axes run from the least to the greatest value of the complete pairs. The size is bounded by the grid and the colours, whatever the table's.
    """
    base = df.select(number(df, x).alias("x"), number(df, y).alias("y"), *([label(col(hue)).alias("hue")] if hue else [])) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = base.agg(*[f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]).first()

    def axis(c):
        lo, width = ends[f"{c}0"] or 0.0, ((ends[f"{c}1"] or 0.0) - (ends[f"{c}0"] or 0.0)) / bins
        at = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)) if width else F.lit(0)
        return at.alias(f"{c}_bin"), (F.lit(lo) + (F.col(f"{c}_bin") + F.lit(0.5)) * F.lit(width)).alias(c)

    axes = [axis("x"), axis("y")]
    keys = ["x_bin", "y_bin", *(["hue"] if hue else [])]
    return base.select(*[a for a, _ in axes], *keys[2:]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, *[m for _, m in axes], "n")


def grouped_box(df: DataFrame, column: str, by: str) -> DataFrame:
    """Box statistics per group."""
    base = df.select(label(col(by)).alias("key"), number(df, column).alias("value"))
    quartiles = grouped_quantiles(base, QUARTILES)
    spread = base.groupBy("key").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return spread.join(quartiles, "key", "left").select(
        F.col("key").alias("grp"), "n", "min", F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q3"), "max", "mean", "std")


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, n, sx, sy, xx, yy, xy) of a task's rows for i <= j, over the rows where both columns are present.

    With X the values (absent ones zero) and N what is present, these are N'N, X'N, (X*X)'N and X'X. An infinite value spoils only
    the pairs that it takes part in.
    """
    sums = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        have = ~np.isnan(x)
        endless = np.isinf(x)
        x = np.where(have & ~endless, x, 0.0)
        n = have.astype(float)
        part = np.stack([n.T @ n, x.T @ n, (x * x).T @ n, x.T @ x])
        if endless.any():
            spoiled = endless.astype(float).T @ n > 0
            part[1:3, spoiled] = np.nan
            part[3, spoiled | spoiled.T] = np.nan
        sums = part if sums is None else sums + part
    if sums is not None:
        i, j = np.triu_indices(sums.shape[1])
        n, sx, xx, xy = sums
        yield pa.RecordBatch.from_arrays([
            pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j].astype(np.int64)),
            *(pa.array(v) for v in (sx[i, j], sx[j, i], xx[i, j], xx[j, i], xy[i, j]))], names=["i", "j", "n", "sx", "sy", "xx", "yy", "xy"])


def correlations(df: DataFrame, columns=None) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (x, y, r), both triangles and the diagonal.

    One pass for the means and one for the sums of products of the centred values, for any number of columns: each task multiplies its batches
    as matrices and gives one row for each pair, which are summed. Undefined where a side is constant.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return small_frame(df.sparkSession, "x string, y string, r double", [])
    finite = lambda x: f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"
    means = {r["column"]: r["mean"] or 0.0 for r in per_column(df, columns, lambda c: {"mean": f"avg({finite(number_sql(df, c))})"}).collect()}
    centred = df.select(*[(number(df, c) - F.lit(means[c])).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = centred.mapInArrow(_gram, "i int, j int, n bigint, sx double, sy double, xx double, yy double, xy double").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
    name = "element_at(array({}), {{}} + 1)".format(", ".join(map(text_sql, columns)))
    out = sums.selectExpr(
        f"{name.format('i')} AS x", f"{name.format('j')} AS y", "xx - sx * sx / nullif(n, 0) AS vx", "yy - sy * sy / nullif(n, 0) AS vy",
        "xy - sx * sy / nullif(n, 0) AS vxy", "xx", "yy").selectExpr(
        "x", "y", "CASE WHEN vx > 1e-12D * xx AND vy > 1e-12D * yy THEN vxy / sqrt(vx * vy) END AS r")
    # Both triangles from one row, so that the sums are taken once.
    return out.selectExpr("inline(CASE WHEN x = y THEN array(named_struct('x', x, 'y', y, 'r', r)) "
                          "ELSE array(named_struct('x', x, 'y', y, 'r', r), named_struct('x', y, 'y', x, 'r', r)) END)")


def strong_correlations(df: DataFrame, columns=None, threshold: float = 0.0) -> DataFrame:
    """Matrix for display: the diagonal and pairs below the threshold are blank."""
    keep = (F.col("x") != F.col("y")) & (F.abs("r") >= threshold)
    return correlations(df, columns).select("x", "y", F.when(keep, F.col("r")).alias("r"))


def target_correlations(df: DataFrame, target: Column, columns=None) -> DataFrame:
    """Correlation of every numeric column with the target, strongest first; undefined ones are left out."""
    columns = numeric_columns(df) if columns is None else list(columns)
    tagged = df.select("*", target.cast("double").alias("_y"))
    found = per_column(tagged, columns, lambda c: {"r": pearson_sql(number_sql(df, c), "_y")})
    return found.where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), F.asc("column"))


def scatter_sample(df: DataFrame, x: str, y: str, hue: str | None = None, fraction: float = 1.0,
                   seed: int = 7) -> DataFrame:
    """x, y and optional colour of the complete pairs; a sample when ``fraction`` is below one."""
    out = df.select(number(df, x).alias("x"), number(df, y).alias("y"),
                    *([label(col(hue)).alias("hue")] if hue else [])) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return out.sample(fraction=fraction, seed=seed) if fraction < 1.0 else out
