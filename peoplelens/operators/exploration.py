"""Exploration of a binary target: rates, cross-tabs, compositions, gaps, profile of the target group.

Groups are labels, with NULL as the label ``nan``. Ties for best and worst go to the smallest label.

The counting operators read rows, or counted cells of rows: ``weight`` is then the number of rows that a cell stands for, as ``counted_cells`` gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import col, first_int, gender, label, name_sql, ranked_first, share, strip
from peoplelens.functions.frames import melt
from peoplelens.functions.quantiles import column_quantiles, grouped_quantiles
from peoplelens.operators.association import association_scores
from peoplelens.session import staged

# Labels of the four segments.
SEGMENTS = ("High & Has CapGain", "High & No CapGain", "Std & Has CapGain", "Std & No CapGain")


def _n(weight: Column | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def _n_if(condition: Column, weight: Column | None) -> Column:
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))


def _rate(target: Column, weight: Column | None = None) -> Column:
    return F.avg(target.cast("double")) if weight is None else share(_n_if(target, weight), _n_if(target.isNotNull(), weight))


def counted_cells(df: DataFrame, sets: list[tuple[str, ...]], flags: tuple[str, ...]) -> dict[tuple[str, ...], DataFrame]:
    """For each set of columns its cells (the set's columns, the flags, n), all from one pass over the rows.

    One aggregate by grouping sets, folded on each task first and written; a set's cells are then a filter of what was written.
    """
    columns = [*dict.fromkeys(c for one in sets for c in one), *flags]
    grouped = df.groupingSets([[col(c) for c in (*one, *flags)] for one in sets], *[col(c) for c in columns])
    cells = staged(grouped.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n")), "cells")
    number = {one: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in one and c not in flags) for one in sets}
    return {one: cells.where(F.col("_set") == number[one]).select(*map(col, (*one, *flags)), "n") for one in sets}


def highest(value: Column, name: Column) -> Column:
    """Aggregate: name with the largest value, ties to the smallest name; an undefined value never wins."""
    return F.min(F.when(value.isNotNull(), F.struct((-value).alias("v"), name.alias("name"))))["name"]


def lowest(value: Column, name: Column) -> Column:
    return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), name.alias("name"))))["name"]


# --- rates -----------------------------------------------------------------------------------------------------

def target_split(df: DataFrame, target: Column, weight: Column | None = None) -> DataFrame:
    """Counts and shares of both classes and the ratio of the standard to the target class."""
    n, high = _n(weight), _n_if(target, weight)
    return df.agg(n.alias("total"), high.alias("n_high"), (n - high).alias("n_std"),
                  share(high, n, 100.0).alias("pct_high"), share(n - high, n, 100.0).alias("pct_std"),
                  share(n - high, F.greatest(high, F.lit(1))).alias("ratio"))


def rate_by(df: DataFrame, group: Column, target: Column, top: int | None = None, weight: Column | None = None) -> DataFrame:
    """Target rate per label. ``top`` keeps the labels with the most rows, NULL not competing."""
    if top is not None:
        df = df.where(group.isNotNull())
    rates = df.groupBy(label(group).alias("label")).agg(_n(weight).alias("n"), _rate(target, weight).alias("rate"))
    return rates if top is None else rates.orderBy(F.desc("n"), F.asc("label")).limit(top)


def best_and_worst(rates: DataFrame) -> DataFrame:
    """Label with the highest and lowest rate, both in %, and the gap in points."""
    return rates.agg(
        highest(F.col("rate"), F.col("label")).alias("best"), (F.max("rate") * 100).alias("best_pct"),
        lowest(F.col("rate"), F.col("label")).alias("worst"), (F.min("rate") * 100).alias("worst_pct"),
        ((F.max("rate") - F.min("rate")) * 100).alias("gap"))


def rates_of_many(df: DataFrame, columns, target: Column) -> DataFrame:
    """Target rate per (feature, label) of several columns from one shuffle."""
    long = melt(df, {c: f"coalesce(CAST({name_sql(c)} AS STRING), 'nan')" for c in columns}, {"high": target.cast("double")})
    return long.groupBy(F.col("column").alias("feature"), F.col("value").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("high").alias("rate"))


def top_feature_rates(df: DataFrame, target_column: str, target: Column, k: int = 4) -> DataFrame:
    """(feature, association, label, n, rate): every label of the k columns most associated with the target.

    No rows where no column reaches the association threshold.
    """
    top = association_scores(df, target_column, target=target).limit(k)
    scores = {r["attribute"]: r["association"] for r in top.collect()}
    if not scores:
        return df.sparkSession.createDataFrame([], "feature string, association double, label string, n bigint, rate double")
    score = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    return rates_of_many(df, list(scores), target).select(
        "feature", score[F.col("feature")].alias("association"), "label", "n", "rate")


def top_feature_breakdown(df: DataFrame, target_column: str, target: Column, k: int = 4) -> DataFrame:
    """Best and worst label, their rates and the gap for the k columns most associated with the target."""
    return top_feature_rates(df, target_column, target, k).groupBy("feature").agg(
        F.max("association").alias("association"),
        highest(F.col("rate"), F.col("label")).alias("best"), (F.max("rate") * 100).alias("best_pct"),
        lowest(F.col("rate"), F.col("label")).alias("worst"), (F.min("rate") * 100).alias("worst_pct"),
        ((F.max("rate") - F.min("rate")) * 100).alias("gap"))


# --- cross-tabs --------------------------------------------------------------------------------------------------

def rate_cells(df: DataFrame, row: Column, column: Column, target: Column, weight: Column | None = None) -> DataFrame:
    """Count and target rate per non-empty cell."""
    return df.groupBy(label(row).alias("row"), label(column).alias("col")).agg(
        _n(weight).alias("n"), _rate(target, weight).alias("rate"))


def rate_grid(df: DataFrame, row: Column, column: Column, target: Column) -> DataFrame:
    """Target rate of a cross-tab in long form. Pairs of labels that no row has are absent and stand for rate 0 of 0 rows (``dense``)."""
    return rate_cells(df, row, column, target)


def dense(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of the row and column labels that the cells have, 0 in the pairs that are absent; a grid of its own for each value of ``by``.

    Every row repeats the list of column labels, so the result has rows times columns cells, as any grid. NULL in ``by`` is a value.
    No cells give no grid.
    """
    cells = staged(cells, "cells")
    keys = [*by, "row", "col"]
    other = [c for c in cells.columns if c not in keys]
    rows = cells.select(*by, "row").distinct()
    if by:
        lists = cells.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.collect_set("col").alias("_cols"))
        rows = rows.join(lists, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]).select(*by, "row", "_cols")
    else:
        rows = rows.withColumn("_cols", cells.agg(F.collect_set("col")).scalar())
    held = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], *other)
    grid = rows.select(*by, "row", F.explode("_cols").alias("col"))
    return grid.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(
        *keys, *[F.coalesce(F.col(c), F.lit(0)).cast(cells.schema[c].dataType).alias(c) for c in other])


def best_and_worst_cell(cells: DataFrame, min_rows: int = 0) -> DataFrame:
    """Cells with the highest and lowest rate among those with enough rows."""
    name = F.struct("row", "col")
    out = cells.where(F.col("n") >= min_rows).agg(
        highest(F.col("rate"), name).alias("b"), (F.max("rate") * 100).alias("best_pct"),
        lowest(F.col("rate"), name).alias("w"), (F.min("rate") * 100).alias("worst_pct"))
    return out.select(F.col("b.row").alias("best_row"), F.col("b.col").alias("best_col"), "best_pct",
                      F.col("w.row").alias("worst_row"), F.col("w.col").alias("worst_col"), "worst_pct",
                      (F.col("best_pct") - F.col("worst_pct")).alias("gap"))


def best_cell(cells: DataFrame, min_rows: int = R.MIN_CELL_ROWS) -> DataFrame:
    """The cell with the highest rate among those with enough rows and a rate above zero."""
    return best_and_worst_cell(cells.where(F.col("rate") > 0), min_rows).select("best_row", "best_col", "best_pct")


def label_order(df: DataFrame, group: Column, target: Column, by: str = "rate") -> DataFrame:
    """Labels in display order: by rate, or by the first number in the label, descending."""
    rates = rate_by(df, group, target).withColumn("sort_number", F.coalesce(first_int(F.col("label")), F.lit(0)))
    key = F.desc("rate") if by == "rate" else F.desc("sort_number")
    return rates.select("label", "sort_number", "rate").orderBy(key, F.asc("label"))


def hours_cells(df: DataFrame, group: Column, hours: Column, target: Column, weight: Column | None = None) -> DataFrame:
    """Count, rate and bubble size per (group, hours) cell with the group's hours-weighted total.

    The weight of an hours label is its first number, 999 without one.
    """
    cells = rate_cells(df, group, hours, target, weight).withColumn("weight", F.coalesce(first_int(F.col("col")), F.lit(999)))
    per_group = Window.partitionBy("row")
    size = F.greatest(F.lit(8.0), share(F.col("n"), cells.agg(F.max("n")).scalar(), 55.0))
    return cells.select("row", "col", "n", "rate", size.alias("size"),
                        F.sum(F.col("n") * F.col("weight")).over(per_group).alias("total_hours"))


def median_hours_by(df: DataFrame, group: Column, hours: Column) -> DataFrame:
    """Median of the first number in the hours label per group."""
    long = df.select(label(group).alias("key"), first_int(hours.cast("string")).cast("double").alias("value"))
    return grouped_quantiles(long, (0.5,)).select(F.col("key").alias("label"), F.col("quantiles")[0].alias("median_hours"))


def top_median(medians: DataFrame) -> DataFrame:
    return medians.agg(highest(F.col("median_hours"), F.col("label")).alias("label"),
                       F.max("median_hours").alias("median_hours"))


# --- compositions --------------------------------------------------------------------------------------------------

def composition(df: DataFrame, row: Column, column: Column, weight: Column | None = None) -> DataFrame:
    """Share in % of every column label within its row label."""
    cells = df.groupBy(label(row).alias("row"), label(column).alias("col")).agg(_n(weight).alias("n"))
    return cells.select("row", "col", "n", share(F.col("n"), F.sum("n").over(Window.partitionBy("row")), 100.0).alias("pct"))


def level_share(shares: DataFrame, levels=("Advanced", "Bachelors")) -> DataFrame:
    """Combined share of some column labels per row."""
    return shares.groupBy("row").agg(F.sum(F.when(F.col("col").isin(*levels), F.col("pct")).otherwise(0.0)).alias("pct"))


def best_and_worst_share(per_row: DataFrame) -> DataFrame:
    return per_row.agg(highest(F.col("pct"), F.col("row")).alias("best"), F.max("pct").alias("best_pct"),
                       lowest(F.col("pct"), F.col("row")).alias("worst"), F.min("pct").alias("worst_pct"))


def segment(target: Column, gain: Column) -> Column:
    """Target class crossed with having a capital gain; an unknown gain counts as none."""
    has = F.coalesce(gain > 0, F.lit(False))
    return (F.when(target & has, SEGMENTS[0]).when(target, SEGMENTS[1]).when(has, SEGMENTS[2]).otherwise(SEGMENTS[3]))


def segment_composition(df: DataFrame, group: Column, target: Column, gain: Column, sex: Column | None = None,
                        weight: Column | None = None) -> DataFrame:
    """Share in % of the four segments per label, those with the largest target share first; within each gender if ``sex`` is given."""
    w = F.lit(1) if weight is None else weight
    flags = df.select(label(group).alias("label"), segment(target, gain).alias("s"), w.alias("w"),
                      *([gender(sex).alias("gender")] if sex is not None else []))
    keys = ["label"] if sex is None else ["gender", "label"]
    n = _n(F.col("w"))
    wide = (flags if sex is None else flags.where(F.col("gender").isin("male", "female"))).groupBy(*keys).agg(n.alias("n"), *[
        share(_n_if(F.col("s") == s, F.col("w")), n, 100.0).alias(s) for s in SEGMENTS])
    return wide.orderBy(*keys[:-1], F.desc(F.col(f"`{SEGMENTS[0]}`") + F.col(f"`{SEGMENTS[1]}`")), F.asc("label"))


def dual_rate_by(df: DataFrame, group: Column, target: Column, gain: Column, weight: Column | None = None) -> DataFrame:
    """Share of rows per label that are in the target class and have a gain."""
    both = target & F.coalesce(gain > 0, F.lit(False))
    return rate_by(df, group, both, weight=weight)


def dual_rate_by_gender(df: DataFrame, sex: Column, target: Column, gain: Column, weight: Column | None = None) -> DataFrame:
    """Target share and share with target and gain, for each gender."""
    both = target & F.coalesce(gain > 0, F.lit(False))
    return df.withColumn("_gender", gender(sex)).where(F.col("_gender").isin("male", "female")).groupBy(F.col("_gender").alias("gender")).agg(
        (_rate(target, weight) * 100).alias("target_pct"), (_rate(both, weight) * 100).alias("dual_pct"))


def prevalence_grid(df: DataFrame, row: Column, column: Column, target: Column, x: Column, weight: Column | None = None) -> DataFrame:
    """Share in % with x > 0 per pair of labels within each target class; absent pairs stand for 0 (``dense``)."""
    has = F.coalesce(x > 0, F.lit(False))
    return df.groupBy(target.alias("high"), label(row).alias("row"), label(column).alias("col")).agg(
        (_rate(has, weight) * 100).alias("pct"))


def prevalence_peak(grid: DataFrame) -> DataFrame:
    """The cell of the target class with the highest prevalence."""
    name = F.struct("row", "col")
    return grid.where("high").agg(highest(F.col("pct"), name).alias("b"), F.max("pct").alias("pct")) \
        .select(F.col("b.row").alias("row"), F.col("b.col").alias("col"), "pct")


# --- target against numbers and gender -----------------------------------------------------------------------------

def numeric_by_target(df: DataFrame, x: Column, target: Column) -> DataFrame:
    """Mean and share above zero per class, and the ratio of the means."""
    high_mean, std_mean = F.avg(F.when(target, x)), F.avg(F.when(~target, x))
    return df.agg(
        std_mean.alias("std_mean"), high_mean.alias("high_mean"),
        F.coalesce(share(F.count_if(~target & (x > 0)), F.count_if(~target), 100.0), F.lit(0.0)).alias("std_pct_positive"),
        F.coalesce(share(F.count_if(target & (x > 0)), F.count_if(target), 100.0), F.lit(0.0)).alias("high_pct_positive"),
        F.when(std_mean > 0, high_mean / std_mean).otherwise(0.0).alias("multiplier"))


def target_by_gender(df: DataFrame, sex: Column, target: Column, weight: Column | None = None) -> DataFrame:
    """Counts of both classes and target share per gender, and the gap in points."""
    g = gender(sex)

    def n(who, cls):
        return _n_if((g == who) & cls, weight)

    male, female = n("male", F.lit(True)), n("female", F.lit(True))
    pm = F.coalesce(share(n("male", target), male, 100.0), F.lit(0.0))
    pf = F.coalesce(share(n("female", target), female, 100.0), F.lit(0.0))
    return df.agg(n("male", target).alias("male_high"), n("male", ~target).alias("male_std"),
                  n("female", target).alias("female_high"), n("female", ~target).alias("female_std"),
                  pm.alias("male_pct"), pf.alias("female_pct"), (pm - pf).alias("gap"))


def gender_rates(df: DataFrame, group: Column, sex: Column, target: Column, weight: Column | None = None) -> DataFrame:
    """Male and female target rate per label in one aggregate, 0 where a gender is absent, by their mean."""
    g = gender(sex)

    def rate(who):
        return F.coalesce(share(_n_if((g == who) & target, weight), _n_if((g == who) & target.isNotNull(), weight)), F.lit(0.0))

    rates = df.groupBy(label(group).alias("label")).agg(
        rate("male").alias("male_rate"), rate("female").alias("female_rate"), _n_if(g.isin("male", "female"), weight).alias("n")).where(F.col("n") > 0)
    return rates.select("label", "male_rate", "female_rate", ((F.col("male_rate") + F.col("female_rate")) / 2).alias("mean_rate"),
                        ((F.col("male_rate") - F.col("female_rate")) * 100).alias("gap")).orderBy("mean_rate", "label")


def gender_gap(rates: DataFrame) -> DataFrame:
    """Mean rates over labels and the labels with the widest and narrowest signed gap."""
    return rates.agg((F.avg("male_rate") * 100).alias("avg_male"), (F.avg("female_rate") * 100).alias("avg_female"),
                     ((F.avg("male_rate") - F.avg("female_rate")) * 100).alias("gap"),
                     highest(F.col("gap"), F.col("label")).alias("widest"), F.max("gap").alias("widest_gap"),
                     lowest(F.col("gap"), F.col("label")).alias("narrowest"), F.min("gap").alias("narrowest_gap"))


def archetype(df: DataFrame, target: Column, fields: dict[str, Column], age: Column | None = None, hours: Column | None = None,
              gain: Column | None = None) -> DataFrame:
    """Typical member of the target class: top label and share per field, median age, mean hours, % with a gain.

    Long form (item, label, value), so it has the same shape for any set of fields. The field ``sex`` is stripped before it is counted.
    """
    high = df.where(target)
    none = F.lit(None).cast("string")
    parts = []
    if fields:
        cells = {k: label(strip(c) if k == "sex" else c) for k, c in fields.items()}
        counts = melt(high, cells).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        # Every field has a label in every row, so a field's counts add up to the rows of the class.
        parts.append(counts.groupBy("column").agg(
            ranked_first(F.col("value"), F.col("n")).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total")).select(
            F.col("column").alias("item"), "label", share(F.col("n"), F.col("total"), 100.0).alias("value")))
    if age is not None:
        median = grouped_quantiles(high.select(F.lit("median_age").alias("key"), age.cast("double").alias("value")), (0.5,))
        parts.append(median.select(F.col("key").alias("item"), none.alias("label"), F.floor(F.col("quantiles")[0]).cast("double").alias("value")))
    numbers = {}
    if hours is not None:
        numbers["mean_hours"] = F.avg(hours.cast("double"))
    if gain is not None:
        numbers["gain_pct"] = share(F.count_if(gain > 0), F.count(F.lit(1)), 100.0)
    if numbers:
        parts.append(high.agg(F.array(*[F.struct(F.lit(k).alias("item"), none.alias("label"), v.alias("value"))
                                        for k, v in numbers.items()]).alias("x")).select(F.inline("x")))
    if not parts:
        return df.sparkSession.createDataFrame([], "item string, label string, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kpis(df: DataFrame, target: Column, age: Column | None = None, sex: Column | None = None, hours: Column | None = None) -> DataFrame:
    """Header figures: size, target share, age quartiles, gender shares, hours, mean age gap; those of an absent field are NULL."""
    nothing = F.lit(None)
    a, h = (F.lit(None).cast("double") if c is None else c.cast("double") for c in (age, hours))
    g = nothing.cast("string") if sex is None else gender(sex)
    quartiles = (None, None, None) if age is None else column_quantiles(df.select(a.alias("_age")), {"age": "_age"}, (0.25, 0.5, 0.75))["age"]
    n, high = F.count(F.lit(1)), F.count_if(target)
    male, female = F.count_if(g == "male"), F.count_if(g == "female")
    both = F.greatest(male + female, F.lit(1))
    whole = [F.lit(None if quartiles[i] is None else int(quartiles[i])).cast("bigint") for i in (1, 0, 2)]

    def known(c, value):
        return nothing.cast("double") if c is None else value

    return df.agg(
        n.alias("total"), high.alias("n_high"), (n - high).alias("n_std"), share(high, n, 100.0).alias("pct_high"),
        male.alias("male_n"), female.alias("female_n"), known(sex, share(male, both, 100.0)).alias("pct_male"),
        known(sex, share(female, both, 100.0)).alias("pct_female"), F.avg(h).alias("avg_hours"),
        share(F.count_if(h > 40), F.count(h), 100.0).alias("pct_overtime"),
        (F.avg(F.when(target, a)) - F.avg(F.when(~target, a))).alias("age_gap")).select(
        "*", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), whole[0].alias("median_age"), whole[1].alias("q1_age"),
        whole[2].alias("q3_age"))
