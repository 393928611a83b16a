"""The nine cleaning and feature steps as one plan.

Every step is fitted on the output of the step before. The source is read once, into its different rows with their counts; types, casing and
placeholders are decided on the frequencies of their values. The table is written after the duplicates are gone, after the outliers are capped
and after labels have codes, so that later fits read its columns from Parquet instead of repeating the shuffles before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import is_noise, numeric_columns, text_columns
from peoplelens.functions.frames import small_frame
from peoplelens.operators import cleaning as C
from peoplelens.operators import features as X
from peoplelens.operators.audit import duplicate_count, equal_rows
from peoplelens.operators.frequency import text_frequency
from peoplelens.operators.outliers import outlier_counts, treat_auto
from peoplelens.session import staged


@dataclass
class Outcome:
    cleaned: DataFrame
    encoded: DataFrame
    comparison: list = field(default_factory=list)
    statistics: dict = field(default_factory=dict)
    scaling: dict = field(default_factory=dict)


def _noise(freq: DataFrame, rules: R.Rules) -> int:
    return freq.agg(F.coalesce(F.sum(F.when(
        is_noise(F.col("value"), rules.noise_tokens), F.col("n"))), F.lit(0)).alias("n")).first()["n"]


def clean(df: DataFrame, rules: R.Rules = R.Rules()) -> tuple[DataFrame, list, dict]:
    """Steps 1 to 5 → cleaned table, before/after figures, counts."""
    return _clean(df, rules)[:3]


def _standardized(df: DataFrame, groups: DataFrame, n: str, rules: R.Rules) -> tuple[DataFrame, DataFrame]:
    """Step 1 on the groups of equal rows → typed groups, and the frequencies of their text columns over all rows."""
    trimmed = C.trim_text(groups)
    freq = staged(text_frequency(trimmed, text_columns(df), weight=n), "frequency")
    mapping = staged(C.casing_map(trimmed, freq=freq), "casing")
    # Non-text columns are counted by different rows here; only the targets are used.
    typed = C.cast_types(C.unify_casing(trimmed, mapping=mapping), rules, C.decide_types(groups.drop(n), rules, freq))
    after = text_columns(typed)
    values = freq.join(mapping, ["column", "value"], "left").where(F.col("column").isin(after)).select(
        "column", F.coalesce("replacement", "value").alias("value"), "n")
    new = [c for c in after if c not in text_columns(df)]
    return typed, values.unionByName(text_frequency(typed, new, weight=n)) if new else values


def _clean(df: DataFrame, rules: R.Rules):
    """The same with the profiles of the cleaned table."""
    n = "_n"
    while n in {c.lower() for c in df.columns}:
        n += "_"
    groups = staged(equal_rows(df, n), "groups")
    before = duplicate_count(df, groups, n).first()
    typed, values = _standardized(df, groups, n, rules)
    noise = _noise(values, rules)
    quiet = C.clean_noise(typed.drop(n), "replace_nan", rules=rules)
    unique = staged(C.drop_duplicates(quiet), "unique")
    rows_left = unique.count()
    full = C.impute(unique)
    found = outlier_counts(full, rules=rules)
    cleaned = staged(treat_auto(full, rules=rules, found=found), "cleaned")
    after = duplicate_count(cleaned, n=n).first()
    again = outlier_counts(cleaned, rules=rules)
    outliers = sum(r["real"] for r in found.values())
    comparison = [
        ("Missing Values", before["missing"] + noise, after["missing"], None),
        ("Noise Values", noise, _noise(text_frequency(cleaned), rules), None),
        ("Duplicate Rows", before["duplicates"], after["duplicates"], None),
        # Capped values sit on their fence, so none is left by the fitted limits; a fresh fit is shown beside it.
        ("Outliers", outliers, 0, sum(r["real"] for r in again.values())),
    ]
    counts = {"rows_before": before["rows"], "rows_after": rows_left, "duplicates_dropped": before["rows"] - rows_left,
              "outlier_columns": sum(1 for r in found.values() if r["real"])}
    return cleaned, comparison, counts, {c: r["profile"] for c, r in again.items()}


def engineer(cleaned: DataFrame, rules: R.Rules = R.Rules(), skip_binned: bool = False, rule_order: bool = False, profiles=None):
    """Steps 6 to 9 → encoded table, scaling plan, counts. ``profiles`` of the cleaned table may be given."""
    methods = {r["column"]: r["method"] for r in X.log_candidates(cleaned, skip_binned, rules, profiles).collect()}
    logged = X.log_transform(cleaned, methods)
    binned_names = [c for c in numeric_columns(logged) if rules.bin_rule(c)]
    binned = X.bin_and_group(logged, rules)
    plan = X.plan_encoding(binned, rules)
    order = {c: list(rules.bin_rule(c)[1]) for c in binned_names} if rule_order else None
    encoded = X.encode(binned, plan, binned=binned_names, order=order)
    # One-hot columns hold two values by construction and are never scaled.
    scaling = X.plan_scaling(encoded, [c for c in numeric_columns(encoded) if c in binned.columns])
    counts = {
        "logged": len(methods),
        "label_encoded": sum(e.encoding == X.LABEL for e in plan),
        "one_hot_encoded": sum(e.encoding == X.ONE_HOT for e in plan),
        "redundant_dropped": sum(e.encoding == X.DROP for e in plan),
        "standard_scaled": sum(m == X.STANDARD for _, m in scaling.values()),
        "robust_scaled": sum(m == X.ROBUST for _, m in scaling.values()),
    }
    return X.scale(encoded, scaling), scaling, counts


def run(df: DataFrame, rules: R.Rules = R.Rules(), skip_binned: bool = False, rule_order: bool = False) -> Outcome:
    """All nine steps. Writing the two tables is left to the sinks."""
    cleaned, comparison, first, profiles = _clean(df, rules)
    encoded, scaling, second = engineer(cleaned, rules, skip_binned, rule_order, profiles)
    return Outcome(cleaned, encoded, comparison, {**first, **second}, scaling)


def comparison_table(df: DataFrame, rules: R.Rules = R.Rules()) -> DataFrame:
    """Missing, noise, duplicates and outliers before and after cleaning."""
    return small_frame(df.sparkSession, "issue string, before bigint, after bigint, redetected bigint", clean(df, rules)[1])


def statistics_table(df: DataFrame, rules: R.Rules = R.Rules()) -> DataFrame:
    """Rows, duplicates, encoded and scaled columns of a run."""
    stats = run(df, rules).statistics
    return small_frame(df.sparkSession, ", ".join(f"{k} bigint" for k in stats), [tuple(stats.values())])


