"""Insight record, dataset context and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import col, is_target, number, numeric_columns, pearson, present_sql, share
from peoplelens.functions.frames import small_frame
from peoplelens.operators.association import strength_label
from peoplelens.operators.audit import health_score, integrity
from peoplelens.operators.cleaning import missing_report
from peoplelens.operators.exploration import highest, lowest, rates_of_many
from peoplelens.operators.outliers import outlier_counts

# A second alias set, in which education may fall back on its number.
INSIGHT_ALIASES = {
    "income": ("income", "salary", "incomelabel"),
    "age": ("age",),
    "education": ("education", "educationnum"),
    "occupation": ("occupation", "job"),
    "hours": ("hoursperweek", "workinghours", "hours"),
    "sex": ("sex", "gender"),
    "race": ("race", "ethnicity"),
    "workclass": ("workclass",),
    "marital": ("maritalstatus", "marital"),
    "capital_gain": ("capitalgain", "capgain"),
}


def numeric_against_target(df: DataFrame, x: Column, target: Column) -> DataFrame:
    """Correlation with its strength word, and the mean in each class."""
    r = pearson(x, target.cast("double"))
    return df.agg(r.alias("r"), F.avg(F.when(target, x)).alias("mean_high"), F.avg(F.when(~target, x)).alias("mean_low")) \
        .select("r", strength_label(F.col("r")).alias("strength"), "mean_high", "mean_low")


def ceiling_check(df: DataFrame, x: Column, ceiling: float = R.CEILING) -> DataFrame:
    """Share of rows above zero, maximum, and rows at or above the ceiling."""
    return df.agg(share(F.count_if(x > 0), F.count(F.lit(1)), 100.0).alias("pct_positive"), F.max(x).alias("max_value"),
                  F.count_if(x >= ceiling).alias("at_ceiling"))


def insight_record(df: DataFrame, rules: R.Rules = R.Rules()) -> DataFrame:
    """About thirty findings in one row: scalars, rates by education, occupation and gender, and the integrity block.

    Three scans: one wide aggregate, one shuffle for the rates of all grouping fields, one for the groups of equal rows. Rates by field are
    rounded to one digit before they are compared, as are the figures derived from them.
    """
    fields = R.resolve_fields(df.columns, INSIGHT_ALIASES)
    if fields["income"] is None:
        return df.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(len(df.columns)).cast("bigint").alias("cols"))
    target = is_target(col(fields["income"]))
    n = F.count(F.lit(1))
    aggs = [n.alias("n"), F.count_if(target).alias("n_high"), share(F.count_if(target), n, 100.0).alias("pct_high")]
    numeric = numeric_columns(df)
    if fields["hours"] in numeric:
        h = number(df, fields["hours"])
        aggs += [pearson(h, target.cast("double")).alias("hours_r"), F.avg(F.when(target, h)).alias("hours_mean_high"),
                 F.avg(F.when(~target, h)).alias("hours_mean_low")]
    if fields["capital_gain"] in numeric:
        g = number(df, fields["capital_gain"])
        aggs += [share(F.count_if(g > 0), n, 100.0).alias("gain_pct_positive"), F.max(g).cast("bigint").alias("gain_max"),
                 F.count_if(g >= R.CEILING).alias("gain_at_ceiling")]
    out = df.agg(*aggs).select("*", F.lit(len(df.columns)).cast("bigint").alias("cols"))

    groups = [fields[k] for k in ("education", "occupation", "sex") if fields[k]]
    if groups:
        rates = rates_of_many(df, groups, target).select("feature", "label", F.round(F.col("rate") * 100, 1).alias("rate"))
        picks, derived = [], []
        for key in ("education", "occupation"):
            if fields[key]:
                own = F.col("feature") == fields[key]
                rate, name = F.when(own, F.col("rate")), F.col("label")
                picks += [highest(rate, name).alias(f"{key}_best"), F.max(rate).alias(f"{key}_best_pct"),
                          lowest(rate, name).alias(f"{key}_worst"), F.min(rate).alias(f"{key}_worst_pct")]
        if fields["education"]:
            derived.append(F.round(F.col("education_best_pct") / F.greatest(F.col("education_worst_pct"), F.lit(1.0)), 1).alias("education_ratio"))
        if fields["occupation"]:
            derived.append(F.round(F.col("occupation_best_pct") - F.col("occupation_worst_pct"), 1).alias("occupation_spread"))
        if fields["sex"]:
            own, low = F.col("feature") == fields["sex"], F.lower("label")
            tests = {"men": low.contains("male") & ~low.contains("fe"), "women": low.contains("female") | (low == "f")}
            for who, test in tests.items():
                first = F.min(F.when(own & test, F.struct("label", "rate")))
                picks += [first["label"].alias(f"{who}_label"), first["rate"].alias(f"{who}_pct")]
            derived.append(F.round(F.col("men_pct") - F.col("women_pct"), 1).alias("gender_gap"))
        packed = rates.agg(*picks).select("*", *derived).select(F.struct("*")).scalar()
        out = out.select("*", packed.alias("_groups")).select("*", "_groups.*").drop("_groups")
    block = integrity(df, rules)
    return out.select("*", block.select(F.struct("*")).scalar().alias("_block")).select("*", "_block.*").drop("_block")


def dataset_context(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicates, missing share and the (column, missing) pairs of columns with gaps, from the groups of equal rows."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    gaps = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(F.when(~F.expr(present_sql(df, c)), F.col("_n"))), F.lit(0)).alias("missing"))
                     for c in sorted(df.columns)])
    found = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), gaps.alias("gaps"))
    total = F.aggregate("gaps", F.lit(0).cast("bigint"), lambda a, g: a + g["missing"])
    return found.select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("cols"), "duplicates",
        F.coalesce(share(total, F.col("rows") * F.lit(len(df.columns)), 100.0), F.lit(0.0)).alias("missing_pct"),
        F.filter("gaps", lambda g: g["missing"] > 0).alias("gaps"))


def report_tables(df: DataFrame, rules: R.Rules = R.Rules()) -> dict[str, DataFrame]:
    """Summary row, missing profile and outlier counts (IQR limits) of an audit report."""
    summary = health_score(df, rules).select(
        "health_score", "rows", "cols", "duplicates",
        share(F.col("missing"), F.col("rows") * F.col("cols"), 100.0).alias("missing_pct"))
    outliers = [(c, r["raw"]) for c, r in outlier_counts(df).items() if r["raw"] > 0]
    return {
        "summary": summary,
        "missing_profile": missing_report(df),
        "outlier_counts": small_frame(df.sparkSession, "column string, outliers bigint", outliers),
    }


def report_long(df: DataFrame, rules: R.Rules = R.Rules()) -> DataFrame:
    """All report tables as (section, item, value)."""
    t = report_tables(df, rules)
    fields = t["summary"].columns
    out = t["summary"].select(F.inline(F.array(*[
        F.struct(F.lit("summary").alias("section"), F.lit(c).alias("item"), col(c).cast("double").alias("value"))
        for c in fields])))
    out = out.unionByName(t["missing_profile"].select(
        F.lit("missing").alias("section"), F.col("column").alias("item"), F.col("missing").cast("double").alias("value")))
    return out.unionByName(t["outlier_counts"].select(
        F.lit("outliers").alias("section"), F.col("column").alias("item"), F.col("outliers").cast("double").alias("value")))
