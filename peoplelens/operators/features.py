"""Feature engineering: power transforms, binning, category groups, encoding, scaling."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import isfinite, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peoplelens import rules as R
from peoplelens.functions.expr import (
    col, cut, double_sql, label, name_sql, number, number_sql, numeric_columns, replace_by, text_columns, text_sql,
)
from peoplelens.functions.frames import first_per_column, melt, per_column, small_frame
from peoplelens.operators.frequency import low_variance, numeric_frequency, text_frequency, top_values
from peoplelens.operators.profile import Profile, fit_profiles, histogram
from peoplelens.session import staged

LOG1P, YEO_JOHNSON = "log1p", "yeo-johnson"
STANDARD, ROBUST = "StandardScaler", "RobustScaler"
# What happens to a column, and why.
DROP, LABEL, ONE_HOT = "drop", "label", "one_hot"


# --- power transforms ----------------------------------------------------------------------------------------

def log_candidates(df: DataFrame, skip_binned: bool = False, rules: R.Rules = R.Rules(), profiles: dict[str, Profile] | None = None) -> DataFrame:
    """Strongly skewed columns without a dominant value; log1p from zero up, else Yeo-Johnson.

    ``skip_binned`` leaves out columns that a bin rule with raw-unit edges will read afterwards. ``profiles`` of the numeric columns may be given.
    """
    columns = [c for c in numeric_columns(df) if not (skip_binned and rules.bin_rule(c))]
    flat = {r["column"] for r in low_variance(df, columns).collect()} if columns else set()
    steep = [c for c in columns if c not in flat]
    profiles = fit_profiles(df, steep, quantiles=False, mad=False) if profiles is None else {c: profiles[c] for c in steep}
    rows = [(p.column, p.skew, p.low, p.high, LOG1P if p.low >= 0 else YEO_JOHNSON)
            for p in profiles.values() if p.skew is not None and abs(p.skew) > R.SKEW_STRONG]
    return small_frame(df.sparkSession,
                       "column string, skewness double, min double, max double, method string", rows)


def yeo_johnson_sql(x: str, lam: float) -> str:
    """Yeo-Johnson transform for a given λ, as SQL text over ``x``."""
    up = f"log1p({x})" if abs(lam) < 1e-12 else f"(pow({x} + 1, {double_sql(lam)}) - 1) / {double_sql(lam)}"
    down = f"-log1p(-{x})" if abs(lam - 2) < 1e-12 else \
        f"-(pow(1 - {x}, {double_sql(2 - lam)}) - 1) / {double_sql(2 - lam)}"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def fit_yeo_johnson(df: DataFrame, columns, tolerance: float = 1e-4) -> dict[str, float | None]:
    """λ of largest likelihood per column, from a few aggregate passes that all columns share.

    The first pass evaluates a coarse grid and moves it while the best point lies on its edge. Then each pass takes five points around the
    vertex of the parabola through the best three, an eighth as wide as before. A column without two different values has no λ
    (None); a search that does not converge raises.
    """
    columns = list(columns)
    ends = {r["column"]: r for r in per_column(df, columns, lambda c: {
        "lo": f"min({number_sql(df, c)})", "hi": f"max({number_sql(df, c)})"}).collect()} if columns else {}
    best: dict[str, float | None] = {c: None for c in columns}
    grids = {c: [-2.0 + 0.5 * i for i in range(13)] for c in columns
             if ends[c]["lo"] is not None and ends[c]["lo"] < ends[c]["hi"]}
    for _ in range(40):
        if not grids:
            return best

        def make(c):
            x = number_sql(df, c)
            points = ", ".join(f"var_pop({yeo_johnson_sql(x, lam)})" for lam in grids[c])
            return {"n": f"count({x})", "s": f"sum(signum({x}) * log1p(abs({x})))", "v": f"array({points})"}

        for r in per_column(df, list(grids), make).collect():
            c, grid = r["column"], grids[r["column"]]
            like = [_likelihood(r["n"], r["s"], lam, v) for lam, v in zip(grid, r["v"])]
            top = max(range(len(grid)), key=like.__getitem__)
            step = grid[1] - grid[0]
            if top in (0, len(grid) - 1):
                shift = (len(grid) - 2) * step * (1 if top else -1)
                grids[c] = [lam + shift for lam in grid]
                continue
            left, mid, right = like[top - 1:top + 2]
            bend = left - 2 * mid + right
            best[c] = grid[top] + (step * (left - right) / (2 * bend) if isfinite(bend) and bend < 0 else 0.0)
            if step <= tolerance:
                del grids[c]
            else:
                grids[c] = [best[c] + step / 8 * i for i in (-2, -1, 0, 1, 2)]
    if grids:
        raise ArithmeticError(f"no λ found for {', '.join(grids)}")
    return best


def _likelihood(n: int, s: float, lam: float, variance) -> float:
    if variance is None or not isfinite(variance) or variance <= 0:
        return float("-inf")
    return -n / 2 * log(variance) + (lam - 1) * s


def log_transform(df: DataFrame, methods: dict[str, str], lambdas: dict[str, float] | None = None) -> DataFrame:
    """Apply log1p or Yeo-Johnson per column; results are double, NULL stays NULL."""
    need = [c for c, m in methods.items() if m == YEO_JOHNSON and c in df.columns]
    lambdas = lambdas if lambdas is not None else fit_yeo_johnson(df, need)
    picks = []
    for c in df.columns:
        if c not in methods:
            picks.append(col(c))
        elif methods[c] == LOG1P:
            picks.append(F.log1p(number(df, c)).alias(c))
        elif lambdas[c] is None:  # nothing to transform
            picks.append(number(df, c).alias(c))
        else:
            picks.append(F.expr(yeo_johnson_sql(number_sql(df, c), lambdas[c])).alias(c))
    return df.select(*picks)


# --- binning and grouping ------------------------------------------------------------------------------------

def bin_and_group(df: DataFrame, rules: R.Rules = R.Rules(), bins: bool = True, groups: bool = True) -> DataFrame:
    """Bin numbers right-closed and map categories to groups; unmapped categories stay as they are."""
    numeric = set(numeric_columns(df))
    texts = set(text_columns(df))
    picks = []
    for c in df.columns:
        rule = rules.bin_rule(c) if bins else None
        mapping = rules.group_rule(c) if groups else None
        if rule and c in numeric:
            picks.append(cut(number(df, c), *rule).alias(c))
        elif mapping and c in texts:  # a rule, so of a size that a person wrote
            picks.append(replace_by(col(c), mapping).alias(c))
        else:
            picks.append(col(c))
    return df.select(*picks)


def binning_preview(df: DataFrame, rules: R.Rules = R.Rules()) -> DataFrame:
    """Columns with a rule: its kind (``bins`` or ``groups``), its labels, and distinct values before it is applied."""
    ruled = {c: rules.bin_rule(c)[1] if rules.bin_rule(c) else rules.group_labels(c)
             for c in df.columns if rules.bin_rule(c) or rules.group_rule(c)}
    rows = [(c, "bins" if rules.bin_rule(c) else "groups", len(labels), list(labels)) for c, labels in ruled.items()]
    planned = small_frame(df.sparkSession, "column string, kind string, n_labels int, labels array<string>", rows)
    frequencies = [f(df, [c for c in ruled if c in of(df)]) for f, of in
                   ((text_frequency, text_columns), (numeric_frequency, numeric_columns)) if any(c in of(df) for c in ruled)]
    if not frequencies:
        return planned.withColumn("unique_before", F.lit(0).cast("bigint"))
    seen = None
    for freq in frequencies:
        part = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique_before"))
        seen = part if seen is None else seen.unionByName(part)
    return planned.join(seen, "column", "left").select(
        "column", "kind", "n_labels", "labels", F.coalesce("unique_before", F.lit(0)).alias("unique_before"))


# --- encoding --------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Facts:
    """What is known of a categorical column before its encoding is chosen."""

    column: str
    unique: int
    examples: tuple
    twin: str | None
    is_text: bool


@dataclass(frozen=True)
class Encoding:
    column: str
    unique: int
    examples: tuple
    encoding: str
    reason: str


#: The first rule whose test holds decides: (reason, encoding, test).
ENCODING_RULES = (
    ("redundant", DROP, lambda f: f.twin is not None),
    ("binary", LABEL, lambda f: f.unique <= 2 or f.column.lower() in R.BINARY_COLUMNS),
    ("ordinal", LABEL, lambda f: f.column.lower() in R.ORDINAL_COLUMNS),
    ("binned", LABEL, lambda f: not f.is_text),
    ("nominal", ONE_HOT, lambda f: True),
)


def categorical_facts(df: DataFrame, rules: R.Rules | None = None, examples: int = 5) -> list[Facts]:
    """Facts of the text columns and, with rules, of the numbers that a rule will bin; ruled columns count their labels."""
    texts = text_columns(df)
    ruled = {c: tuple(rules.bin_rule(c)[1] if rules.bin_rule(c) else rules.group_labels(c))
             for c in df.columns if rules and (rules.bin_rule(c) or rules.group_rule(c))}
    open_ = [c for c in texts if c not in ruled]
    seen, shown = {}, {}
    if open_:
        freq = staged(text_frequency(df, open_), "levels")
        seen = {r["column"]: r["u"] for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("u")).collect()}
        shown = {r["column"]: tuple(r["examples"]) for r in first_per_column(freq, [F.asc("value")], examples).collect()}
    have = {c.lower() for c in df.columns}
    out = []
    for c in dict.fromkeys([*texts, *(c for c in ruled if rules.bin_rule(c))]):
        twin = R.REDUNDANT_PAIRS.get(c.lower())
        names = ruled.get(c)
        out.append(Facts(c, len(names) if names else seen.get(c, 0), names or shown.get(c, ()),
                         twin if twin in have else None, c in texts))
    return out


def plan_encoding(df: DataFrame, rules: R.Rules | None = None) -> list[Encoding]:
    """Encoding per categorical column; with rules, as it will look once they are applied."""
    out = []
    for f in categorical_facts(df, rules):
        reason, encoding = next((reason, encoding) for reason, encoding, test in ENCODING_RULES if test(f))
        out.append(Encoding(f.column, f.unique, f.examples, encoding, reason))
    return out


def encoding_table(df: DataFrame, rules: R.Rules | None = None) -> DataFrame:
    rows = [(e.column, e.unique, list(e.examples), e.encoding, e.reason) for e in plan_encoding(df, rules)]
    return small_frame(df.sparkSession,
                       "column string, unique_values bigint, examples array<string>, encoding string, reason string", rows)


def drop_redundant(df: DataFrame) -> DataFrame:
    """Remove a categorical column whose numeric twin is present."""
    have = {c.lower() for c in df.columns}
    return df.select(*[col(c) for c in df.columns if R.REDUNDANT_PAIRS.get(c.lower()) not in have])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with code = rank of the distinct value in code-point order.

    Distinct values are range-partitioned; a code is the position inside its partition plus the sizes of the
    partitions before it, so no task ever holds all of them.
    """
    distinct = df.select(col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    ordered = staged(distinct.repartitionByRange("value").sortWithinPartitions("value").select(
        "value", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("position")), "codes")
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())
    starts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    # One row per partition of the shuffle, so the broadcast does not grow with the data.
    offsets = small_frame(df.sparkSession, "part int, start bigint", starts)
    return ordered.join(F.broadcast(offsets), "part").select(
        "value", (F.col("start") + F.col("position")).cast("bigint").alias("code"))


def level_codes(df: DataFrame, columns) -> DataFrame:
    """(column, value, code) of all columns from one sort: code = rank of the distinct value within its column, in code-point order.

    A code is the position inside its range partition, less where its column begins there, plus what the column has in the partitions before. The
    driver sees one number for each column and partition.
    """
    if not columns:
        return small_frame(df.sparkSession, "column string, value string, code bigint", [])
    distinct = melt(df, {c: f"CAST({name_sql(c)} AS STRING)" for c in columns}).where(F.col("value").isNotNull()).distinct()
    ordered = staged(distinct.repartitionByRange("column", "value").sortWithinPartitions("column", "value").select(
        "column", "value", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("position")), "codes")
    sizes = ordered.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first")).collect()
    starts, before = [], {}
    for r in sorted(sizes, key=lambda r: (r["column"], r["part"])):
        starts.append((r["column"], r["part"], before.get(r["column"], 0) - r["first"]))
        before[r["column"]] = before.get(r["column"], 0) + r["n"]
    offsets = small_frame(df.sparkSession, "column string, part int, shift bigint", starts)
    return ordered.join(F.broadcast(offsets), ["column", "part"]).select("column", "value", (F.col("position") + F.col("shift")).alias("code"))


def label_encode(df: DataFrame, columns, order: dict[str, list] | None = None) -> DataFrame:
    """Text to the rank of its value; NULL stays NULL. ``order`` gives an explicit order, of any length, for some columns.

    Codes are (value, code) tables that are joined, one way for any number of values.
    """
    order = order or {}
    for c in columns:
        if c in order:
            codes = small_frame(df.sparkSession, "value string, code bigint", [(v, i) for i, v in enumerate(order[c])])
        else:
            codes = staged(label_codes(df, c), "codes")
        side = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.join(side, col(c).cast("string") == F.col("_value"), "left").select(
            *[F.col("_code").alias(c) if k == c else col(k) for k in df.columns])
    return df


def one_hot_levels(df: DataFrame, columns) -> dict[str, list]:
    """Sorted distinct values of several columns; they become columns of the plan, so the caller decides how many there may be."""
    levels = text_frequency(df, list(columns)).select("column", "value").collect() if columns else []
    return {c: sorted(r["value"] for r in levels if r["column"] == c) for c in columns}


def one_hot_names(df: DataFrame, columns, levels: dict[str, list]) -> dict[tuple[str, str], str]:
    """Name per (column, value): ``<column>_<value>``; one that is taken already, in any case, gets _2, _3 and so on."""
    taken = {c.lower() for c in df.columns if c not in columns}
    names = {}
    for c in columns:
        for v in levels[c][1:]:
            name, i = f"{c}_{v}", 1
            while name.lower() in taken:
                i += 1
                name = f"{c}_{v}_{i}"
            taken.add(name.lower())
            names[c, v] = name
    return names


def one_hot(df: DataFrame, columns, levels: dict[str, list] | None = None) -> DataFrame:
    """0/1 column per value but the first in order, appended after the others; NULL is 0 everywhere.

    Any number of values; for very many, ``one_hot_long`` holds the same in one row per set cell.
    """
    columns = list(columns)
    levels = levels or one_hot_levels(df, columns)
    names = one_hot_names(df, columns, levels)
    kept = [col(c) for c in df.columns if c not in columns]
    added = [F.expr(f"CASE WHEN CAST({name_sql(c)} AS STRING) = {text_sql(v)} THEN 1L ELSE 0L END").alias(n) for (c, v), n in names.items()]
    return df.select(*kept, *added)


def one_hot_long(df: DataFrame, key: str, columns) -> DataFrame:
    """(key, column, level): the set cells of ``one_hot`` with the level's code (0 = first value, which has no column)."""
    long = melt(df, {c: f"CAST({name_sql(c)} AS STRING)" for c in columns}, {key: col(key)}).where(F.col("value").isNotNull())
    out = None
    for c in columns:
        part = long.where(F.col("column") == c).join(staged(label_codes(df, c), "codes"), "value").select(
            col(key), "column", F.col("code").alias("level"))
        out = part if out is None else out.unionByName(part)
    return out


def encode(df: DataFrame, plan: list[Encoding], binned=(), order: dict[str, list] | None = None) -> DataFrame:
    """Drop, label-encode and one-hot the planned columns. In binned columns NULL is the category ``nan``.

    The table is written with its codes and without the one-hot columns, which are as many as there are values and are set where they are read.
    """
    by = {k: [e.column for e in plan if e.encoding == k and e.column in df.columns] for k in (DROP, LABEL, ONE_HOT)}
    df = df.drop(*by[DROP])
    named = [c for c in (*by[LABEL], *by[ONE_HOT]) if c in binned]
    df = df.select(*[label(col(c)).alias(c) if c in named else col(c) for c in df.columns])
    coded = staged(label_encode(df, by[LABEL], order), "coded")
    return one_hot(coded, by[ONE_HOT])


# --- scaling ---------------------------------------------------------------------------------------------------

def plan_scaling(df: DataFrame, columns=None) -> dict[str, tuple[Profile, str]]:
    """Scaler per numeric column with at least three rows and more than two distinct values."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return {}
    # Three or more distinct values: a middle one exists strictly between the two extremes.
    edges = {r["column"]: r for r in per_column(df, columns, lambda c: {
        "lo": f"min({number_sql(df, c)})", "hi": f"max({number_sql(df, c)})"}).collect()}
    spread = [c for c in columns if edges[c]["lo"] is not None and edges[c]["lo"] < edges[c]["hi"]]
    inner = {r["column"]: r["inner"] for r in per_column(df, spread, lambda c: {
        "inner": f"max({number_sql(df, c)} > {double_sql(edges[c]['lo'])} AND {number_sql(df, c)} < {double_sql(edges[c]['hi'])})"
    }).collect()} if spread else {}
    wide = [c for c in columns if inner.get(c)]
    out = {}
    for c, p in fit_profiles(df, wide, mad=False).items():
        if p.skew is not None:
            out[c] = (p, STANDARD if abs(p.skew) < R.SKEW_SYMMETRIC else ROBUST)
    return out


def scaling_table(df: DataFrame, columns=None) -> DataFrame:
    rows = [(c, p.skew, p.low, p.high, p.std, m) for c, (p, m) in plan_scaling(df, columns).items()]
    return small_frame(df.sparkSession, "column string, skewness double, min double, max double, std double, "
                                        "method string", rows)


def scale(df: DataFrame, plan: dict[str, tuple[Profile, str]]) -> DataFrame:
    """(x - mean) / std or (x - median) / IQR; a zero spread leaves the column as double."""
    picks = []
    for c in df.columns:
        if c not in plan:
            picks.append(col(c))
            continue
        p, method = plan[c]
        centre, spread = (p.mean, p.std) if method == STANDARD else (p.median, p.iqr)
        x = number(df, c)
        picks.append(((x - F.lit(centre)) / F.lit(spread) if spread else x).alias(c))
    return df.select(*picks)


def standard_scale(df: DataFrame, columns) -> DataFrame:
    return scale(df, {c: (p, STANDARD) for c, p in fit_profiles(df, columns, quantiles=False, mad=False).items()})


def robust_scale(df: DataFrame, columns) -> DataFrame:
    return scale(df, {c: (p, ROBUST) for c, p in fit_profiles(df, columns, mad=False).items()})


# --- before / after ----------------------------------------------------------------------------------------------

def compare_distribution(before: DataFrame, after: DataFrame, column: str, bins: int = 30, top: int = 10) -> DataFrame:
    """Histogram (numbers) or top values (text) of one column in two tables, tagged and stacked."""
    out = None
    for tag, df in (("before", before), ("after", after)):
        if column not in df.columns:
            continue
        if isinstance(df.schema[column].dataType, T.NumericType):
            part = histogram(df, column, bins).select(
                F.lit(tag).alias("version"), F.col("bin").cast("string").alias("label"),
                F.col("lower").alias("lower"), "n")
        else:
            part = top_values(df, column, top).select(
                F.lit(tag).alias("version"), F.col("value").alias("label"),
                F.lit(None).cast("double").alias("lower"), "n")
        out = part if out is None else out.unionByName(part)
    return out


