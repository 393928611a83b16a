"""Cleaning steps: trim, casing, types, placeholders, duplicates, imputation.

Each step is a fit that brings a few numbers per column to the driver, and a lazy select.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peoplelens import rules as R
from peoplelens.functions.expr import (
    col, is_noise, number, numeric_columns, parse_number, present, present_sql, ranked_first, share, strip, text_columns,
)
from peoplelens.functions.frames import apply_replacements, per_column, small_frame
from peoplelens.operators.frequency import column_modes, text_frequency
from peoplelens.operators.profile import Profile, fit_profiles
from peoplelens.session import staged

# Type names a schema rule may use.
INT_TYPES = ("int64", "int32", "int")
FLOAT_TYPES = ("float64", "float32", "float")
TEXT_TYPES = ("object", "category", "string")


# --- text ------------------------------------------------------------------------------------------------

def trim_text(df: DataFrame, columns=None) -> DataFrame:
    """Strip Unicode whitespace from the text columns."""
    columns = text_columns(df) if columns is None else columns
    return df.select(*[strip(col(c)).alias(c) if c in columns else col(c) for c in df.columns])


def casing_map(df: DataFrame, columns=None, freq: DataFrame | None = None) -> DataFrame:
    """(column, value, replacement) for every spelling that loses to a more frequent casing of itself."""
    freq = (text_frequency(df, columns) if freq is None else freq).withColumn("folded", F.lower("value"))
    winners = freq.groupBy("column", "folded").agg(
        ranked_first(F.col("value"), F.col("n")).alias("replacement"),
        F.count(F.lit(1)).alias("variants")).where(F.col("variants") > 1)
    return freq.join(winners, ["column", "folded"]).where(F.col("value") != F.col("replacement")) \
        .select("column", "value", "replacement")


def unify_casing(df: DataFrame, columns=None, mapping: DataFrame | None = None) -> DataFrame:
    """Replace every casing variant by the most frequent one."""
    mapping = staged(casing_map(df, columns), "casing") if mapping is None else mapping
    affected = {r["column"] for r in mapping.select("column").distinct().collect()}
    return apply_replacements(df, mapping, [c for c in df.columns if c in affected])


def text_issue_preview(df: DataFrame, columns=None) -> DataFrame:
    """Cells with outer whitespace and number of casing groups, for columns that have either."""
    freq = text_frequency(df, columns)
    groups = freq.groupBy("column", F.lower(strip(F.col("value"))).alias("folded")).agg(
        F.count(F.lit(1)).alias("variants"),
        F.sum(F.when(F.col("value") != strip(F.col("value")), F.col("n")).otherwise(0)).alias("cells"))
    return groups.groupBy("column").agg(
        F.sum("cells").alias("whitespace_cells"), F.count_if(F.col("variants") > 1).alias("casing_groups")) \
        .where((F.col("whitespace_cells") > 0) | (F.col("casing_groups") > 0))


# --- types -----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TypeDecision:
    column: str
    current: str
    target: str | None
    origin: str
    convertible: int
    present: int


def decide_types(df: DataFrame, rules: R.Rules = R.Rules(), freq: DataFrame | None = None) -> list[TypeDecision]:
    """Target type per column: the schema's, or a number when 90 % of a text column parses. One pass.

    With a frequency table at hand only its values are parsed, each once.
    """
    texts = set(text_columns(df))
    seen = {}
    if freq is not None:
        x, n = parse_number(F.col("value")), F.col("n")
        seen = {r["column"]: r for r in freq.groupBy("column").agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0)).alias("ok"),
            F.coalesce(F.sum(F.when(x == F.floor(x), n)), F.lit(0)).alias("whole")).collect()}
    aggs = []
    for c in df.columns:
        if c in texts and freq is not None:
            aggs += [F.lit(seen[c][k] if c in seen else 0).alias(f"{c}|{k}") for k in ("n", "ok", "whole")]
        elif c in texts:
            x = parse_number(col(c))
            aggs += [F.count(col(c)).alias(f"{c}|n"), F.count(x).alias(f"{c}|ok"),
                     F.count_if(x == F.floor(x)).alias(f"{c}|whole")]
        else:
            ok = F.count_if(present(col(c), df.schema[c].dataType))
            aggs += [ok.alias(f"{c}|n"), ok.alias(f"{c}|ok"), F.lit(0).alias(f"{c}|whole")]
    row = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        n, ok, whole = row[f"{c}|n"], row[f"{c}|ok"], row[f"{c}|whole"]
        expected = rules.expected_type(c)
        if expected:
            kind = ("bigint" if expected in INT_TYPES else "double" if expected in FLOAT_TYPES
                    else "string" if expected in TEXT_TYPES else None)
            out.append(TypeDecision(c, df.schema[c].dataType.simpleString(), kind, "Schema", ok, n))
        elif c in texts and n and ok / n >= R.NUMERIC_SHARE:
            kind = "bigint" if ok and whole == ok else "double"
            out.append(TypeDecision(c, "string", kind, "Auto", ok, n))
    return out


def cast_types(df: DataFrame, rules: R.Rules = R.Rules(), decisions=None) -> DataFrame:
    """Enforce the schema and auto-cast the rest; what does not parse becomes NULL.

    Whole numbers are rounded half to even. A number cast to text keeps its NULLs.
    """
    targets = {d.column: d.target for d in (decisions if decisions is not None else decide_types(df, rules))}
    picks = []
    for c in df.columns:
        kind, target = df.schema[c].dataType, targets.get(c)
        is_text = isinstance(kind, T.StringType)
        if target == "bigint" and not isinstance(kind, T.LongType):
            x = parse_number(col(c)) if is_text else number(df, c)
            # Beyond 2**53 the text is read directly, so that long identifiers keep all digits.
            exact = F.bround(x).try_cast("bigint")
            if is_text:
                exact = F.coalesce(strip(col(c)).try_cast("bigint"), exact)
            elif isinstance(kind, T.IntegralType):
                exact = col(c).cast("bigint")
            picks.append(F.when(x.isNotNull(), exact).alias(c))
        elif target == "double" and not isinstance(kind, T.DoubleType):
            picks.append((parse_number(col(c)) if is_text else number(df, c)).alias(c))
        elif target == "string" and not is_text:
            picks.append(col(c).cast("string").alias(c))
        else:
            picks.append(col(c))
    return df.select(*picks)


def type_cast_preview(df: DataFrame, rules: R.Rules = R.Rules()) -> DataFrame:
    """Columns whose type would change to a number, with the convertible count and share."""
    rows = []
    for d in decide_types(df, rules):
        already = (d.target == "bigint" and d.current in ("bigint", "int", "smallint", "tinyint")) or \
                  (d.target == "double" and d.current in ("double", "float"))
        if d.target in ("bigint", "double") and not already:
            pct = d.convertible / d.present * 100 if d.present else 0.0
            rows.append((d.column, d.current, d.target, d.origin, d.convertible, pct))
    return small_frame(df.sparkSession, "column string, current_type string, target_type string, origin string, "
                                        "convertible bigint, convertible_pct double", rows)


def standardize(df: DataFrame, rules: R.Rules = R.Rules(), fix_whitespace: bool = True, fix_casing: bool = True,
                convert_types: bool = True, columns=None) -> DataFrame:
    """Step 1: trim, unify casing, cast types."""
    if fix_whitespace:
        df = trim_text(df, columns)
    if fix_casing:
        df = unify_casing(df, columns)
    return cast_types(df, rules) if convert_types else df


# --- placeholders ------------------------------------------------------------------------------------------

def noise_report(df: DataFrame, columns=None, rules: R.Rules = R.Rules(), examples: int = 5,
                 freq: DataFrame | None = None) -> DataFrame:
    """Placeholder cells per text column with the smallest distinct examples; clean columns are absent.

    Without a frequency table at hand the test is pushed below the count, so only placeholders are shuffled.
    """
    freq = text_frequency(df, columns) if freq is None else freq
    noisy = freq.where(is_noise(F.col("value"), rules.noise_tokens))
    # One row per column and value; a task keeps its first values and its sum, so a column costs one small row per task.
    ranked = noisy.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    return ranked.groupBy("column").agg(
        F.sum("n").alias("noise_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= examples, F.struct("rank", "value")))),
                                 lambda s: s["value"]), ", ").alias("examples"))


def clean_noise(df: DataFrame, strategy: str = "replace_nan", columns=None, rules: R.Rules = R.Rules()) -> DataFrame:
    """Placeholders to NULL, to the mode of the clean values, or drop the rows that hold one."""
    columns = [c for c in (text_columns(df) if columns is None else columns) if c in df.columns]
    noisy = {c: F.coalesce(is_noise(col(c).cast("string"), rules.noise_tokens), F.lit(False)) for c in columns}
    if strategy == "drop":
        keep = F.lit(True)
        for test in noisy.values():
            keep = keep & ~test
        return df.where(keep)
    fill = {}
    if strategy == "replace_mode":
        clean = text_frequency(df, columns).where(~is_noise(F.col("value"), rules.noise_tokens))
        rows = clean.groupBy("column").agg(ranked_first(F.col("value"), F.col("n")).alias("mode")).collect()
        fill = {r["column"]: r["mode"] for r in rows}
    elif strategy != "replace_nan":
        raise ValueError(f"unknown noise strategy {strategy!r}")
    return df.select(*[
        F.when(noisy[c], F.lit(fill.get(c)).cast(df.schema[c].dataType)).otherwise(col(c)).alias(c)
        if c in noisy else col(c) for c in df.columns
    ])


# --- duplicates --------------------------------------------------------------------------------------------

def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of every set of identical rows. Copies fold together before the shuffle."""
    return df.dropDuplicates()


def duplicate_groups(df: DataFrame, top: int | None = None) -> DataFrame:
    """Rows that occur more than once with their count, most frequent first; all of them for ``top=None``."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("occurrences")) \
        .where(F.col("occurrences") > 1)
    if top is None:
        return groups
    return groups.orderBy(F.desc("occurrences"), *[F.asc_nulls_first(col(c)) for c in df.columns]).limit(top)


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows, duplicate groups, their instances, redundant rows with share, and rows left after the drop."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    total, repeated = F.coalesce(F.sum("n"), F.lit(0)), F.when(F.col("n") > 1, F.col("n"))
    redundant = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return groups.agg(
        total.alias("total_rows"), F.count(repeated).alias("duplicate_groups"),
        F.coalesce(F.sum(repeated), F.lit(0)).alias("duplicate_instances"), redundant.alias("redundant_rows"),
        share(redundant, total, 100.0).alias("redundant_pct"), F.count(F.lit(1)).alias("rows_after"))


# --- missing values ------------------------------------------------------------------------------------------

def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells and share of rows per column, all columns in one pass."""
    counts = per_column(df, df.columns, lambda c: {"missing": f"count(1) - count_if({present_sql(df, c)})"}, "count(1)")
    return counts.select("column", "missing", share(F.col("missing"), F.col("shared"), 100.0).alias("missing_pct"))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most affected first."""
    return missing_counts(df).where(F.col("missing") > 0).orderBy(F.desc("missing"), F.asc("column"))


def fill_strategy(p: Profile) -> str:
    return "mean" if p.skew is not None and abs(p.skew) < R.SKEW_SYMMETRIC else "median"


def fill_strategies(df: DataFrame, columns=None) -> DataFrame:
    """Mode for text, mean for near-symmetric numbers, median otherwise."""
    columns = [*text_columns(df), *numeric_columns(df)] if columns is None else columns
    profiles = fit_profiles(df, [c for c in columns if c in numeric_columns(df)], quantiles=False, mad=False)
    rows = [(c, profiles[c].skew if c in profiles else None, fill_strategy(profiles[c]) if c in profiles else "mode")
            for c in columns]
    return small_frame(df.sparkSession, "column string, skewness double, strategy string", rows)


def missing_preview(df: DataFrame) -> DataFrame:
    """Missing report with class, skewness and planned fill strategy."""
    found = [(r["column"], r["missing"], r["missing_pct"]) for r in missing_report(df).collect()]
    numeric = [c for c, _, _ in found if c in numeric_columns(df)]
    profiles = fit_profiles(df, numeric, quantiles=False, mad=False)
    rows = [(c, "Numeric" if c in profiles else "Categorical", n, pct, profiles[c].skew if c in profiles else None,
             fill_strategy(profiles[c]).capitalize() if c in profiles else "Mode") for c, n, pct in found]
    return small_frame(df.sparkSession, "column string, class string, missing bigint, missing_pct double, "
                                        "skewness double, strategy string", rows)


def fit_fill_values(df: DataFrame) -> dict:
    """Fill value per column that has missing cells."""
    gaps = {r["column"] for r in missing_counts(df).where(F.col("missing") > 0).collect()}
    numeric = [c for c in numeric_columns(df) if c in gaps]
    texts = [c for c in text_columns(df) if c in gaps]
    values = {}
    for p in fit_profiles(df, numeric, mad=False).values():
        value = p.mean if fill_strategy(p) == "mean" else p.median
        if value is not None:
            values[p.column] = round(value) if p.integral else value
    if texts:
        values.update({r["column"]: r["mode"] for r in column_modes(df, texts).collect()})
    return values


def impute(df: DataFrame, values: dict | None = None) -> DataFrame:
    """Fill missing cells; whole-number columns take the half-even rounded value, all-NULL text stays NULL."""
    values = fit_fill_values(df) if values is None else values
    picks = []
    for c in df.columns:
        if c not in values:
            picks.append(col(c))
            continue
        kind = df.schema[c].dataType
        known = F.when(present(col(c), kind), col(c))
        picks.append(F.coalesce(known, F.lit(values[c]).cast(kind)).alias(c))
    return df.select(*picks)
