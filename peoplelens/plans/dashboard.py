"""The exploration dashboard as named tables over one binned table.

What only counts rows (27 of the 33 sections) is a projection of the cells of one aggregate by grouping sets; numbers, associations and the
profile of the target group read the binned table itself. Each section names the fields it needs and is left out where one is absent, so any table with a target has a dashboard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import col, is_target, to_number
from peoplelens.operators import exploration as E
from peoplelens.operators.association import association_scores
from peoplelens.operators.features import bin_and_group
from peoplelens.session import staged

RAW = ("age", "hours", "capital_gain")
#: Sets of fields whose cells are counted, each with the target and having a gain.
COUNTED = ((), ("relationship", "sex"), ("marital", "sex"), ("age", "education"), ("age", "occupation"), ("education", "occupation"),
           ("occupation", "hours"), ("occupation", "sex"), ("marital",), ("occupation",), ("sex",))


def binned_with_raw(df: DataFrame, fields: dict, rules: R.Rules) -> DataFrame:
    """Binned table plus the raw numbers and the target flag the sections need, in one projection."""
    raw = [to_number(df, fields[k]).alias(f"_{k}") for k in RAW if fields[k]]
    gain = (F.col("_capital_gain") > 0) if fields["capital_gain"] else F.lit(False)
    table = df.select("*", *raw, is_target(col(fields["income"])).alias("_high")).withColumn("_gain", F.coalesce(gain, F.lit(False)))
    return bin_and_group(table, rules)


def count_cells(b: DataFrame, names: dict[str, str]) -> dict[tuple[str, ...], DataFrame]:
    """The cells of each set of ``COUNTED`` whose fields are present, by the fields' names."""
    sets = {fields: tuple(names[f] for f in fields) for fields in COUNTED if all(f in names for f in fields)}
    cells = E.counted_cells(b, list(sets.values()), ("_high", "_gain"))
    return {fields: cells[columns] for fields, columns in sets.items()}


def sections(b: DataFrame, cells: dict[tuple[str, ...], DataFrame], columns: list[str], c: dict[str, Column], income: str) -> dict[str, tuple]:
    """Section → (fields it needs, function that makes its table)."""
    high, has, n = F.col("_high"), F.col("_gain").cast("int"), F.col("n")
    age, hours, gain = (F.col(f"_{k}") if k in c else None for k in RAW)
    plain = b.select(*map(col, columns))
    target = is_target(c["income"])

    def pair(row, column, best=0):
        """Cells of two fields, and the best and worst of them."""
        def rates():
            return E.rate_cells(cells[row, column], c[row], c[column], high, n)
        return rates, lambda: E.best_and_worst_cell(rates(), best)

    def shares(rows=None):
        both = cells["education", "occupation"]
        return E.composition(both if rows is None else both.where(rows), c["occupation"], c["education"], n)

    def prevalence():
        return E.prevalence_grid(cells["education", "occupation"], c["education"], c["occupation"], high, has, n)

    def segments(field):
        return lambda: E.segment_composition(cells[field,], c[field], high, has, weight=n)

    def dual(field):
        return E.dual_rate_by(cells[field,], c[field], high, has, n)

    def genders():
        return E.gender_rates(cells["occupation", "sex"], c["occupation"], c["sex"], high, n)

    def hours_rates():
        return E.rate_cells(cells["occupation", "hours"], c["occupation"], c["hours"], high, n)

    relation, relation_ends = pair("relationship", "sex", R.MIN_CELL_ROWS)
    marital, marital_ends = pair("marital", "sex", R.MIN_CELL_ROWS)
    schooling, schooling_ends = pair("age", "education")
    trade, trade_ends = pair("age", "occupation", R.MIN_CELL_ROWS)
    return {
        "kpi": ((), lambda: E.kpis(b, high, age, c.get("sex"), hours).drop("n_cols")),
        "target_split": ((), lambda: E.target_split(cells[()], high, n)),
        "associations": ((), lambda: association_scores(plain, income)),
        "feature_rates": ((), lambda: E.top_feature_rates(plain, income, target)),
        "breakdown": ((), lambda: E.top_feature_breakdown(plain, income, target)),
        "relationship_by_sex": (("relationship", "sex"), relation),
        "relationship_by_sex_ends": (("relationship", "sex"), relation_ends),
        "marital_by_sex": (("marital", "sex"), marital),
        "marital_by_sex_ends": (("marital", "sex"), marital_ends),
        "age_by_education": (("age", "education"), schooling),
        "age_by_education_ends": (("age", "education"), schooling_ends),
        "age_by_occupation": (("age", "occupation"), trade),
        "age_by_occupation_ends": (("age", "occupation"), trade_ends),
        "education_in_occupation": (("education", "occupation"), shares),
        "top_education_share": (("education", "occupation"), lambda: E.best_and_worst_share(E.level_share(shares()))),
        "occupation_by_hours": (("occupation", "hours"), lambda: E.hours_cells(cells["occupation", "hours"], c["occupation"], c["hours"], high, n)),
        "occupation_by_hours_best": (("occupation", "hours"), lambda: E.best_cell(hours_rates())),
        "gain_by_target": (("capital_gain",), lambda: E.numeric_by_target(b, gain, high)),
        "gain_prevalence": (("education", "occupation", "capital_gain"), prevalence),
        "gain_prevalence_peak": (("education", "occupation", "capital_gain"), lambda: E.prevalence_peak(prevalence())),
        "segments_by_marital": (("marital", "capital_gain"), segments("marital")),
        "segments_by_occupation": (("occupation", "capital_gain"), segments("occupation")),
        "segments_by_gender_and_occupation": (("occupation", "sex", "capital_gain"), lambda: E.segment_composition(
            cells["occupation", "sex"], c["occupation"], high, has, c["sex"], n)),
        "dual_by_marital": (("marital", "capital_gain"), lambda: dual("marital")),
        "dual_by_marital_ends": (("marital", "capital_gain"), lambda: E.best_and_worst(dual("marital"))),
        "dual_by_occupation": (("occupation", "capital_gain"), lambda: dual("occupation")),
        "dual_by_occupation_ends": (("occupation", "capital_gain"), lambda: E.best_and_worst(dual("occupation"))),
        "target_by_gender": (("sex",), lambda: E.target_by_gender(cells["sex",], c["sex"], high, n)),
        "gender_by_occupation": (("occupation", "sex"), genders),
        "gender_gap": (("occupation", "sex"), lambda: E.gender_gap(genders())),
        "dual_by_gender": (("sex", "capital_gain"), lambda: E.dual_rate_by_gender(cells["sex",], c["sex"], high, has, n)),
        "archetype": ((), lambda: E.archetype(b, high, {k: c[k] for k in ("sex", "marital", "education", "occupation") if k in c}, age, hours, gain)),
        "education_of_target": (("education", "occupation"), lambda: shares(high)),
    }


def dashboard(df: DataFrame, rules: R.Rules = R.Rules()) -> dict[str, DataFrame]:
    """Tables by section name. Raises without a target column."""
    f = R.resolve_fields(df.columns)
    if f["income"] is None:
        raise ValueError("no target column found")
    # Written once; the sections that need rows read the columns they need.
    b = staged(binned_with_raw(df, f, rules), "dashboard")
    c = {k: col(v) for k, v in f.items() if v}
    cells = count_cells(b, {k: v for k, v in f.items() if v})
    return {name: make() for name, (needed, make) in sections(b, cells, df.columns, c, f["income"]).items() if all(k in c for k in needed)}


def dashboard_long(df: DataFrame, rules: R.Rules = R.Rules(), digits: int = 6) -> DataFrame:
    """Every section as (section, key, value): the text cells of a row, in column order, name it; each number is a row of its own."""
    out = None
    for name, table in dashboard(df, rules).items():
        words = [x for x, kind in table.dtypes if kind in ("string", "boolean")]
        numbers = [x for x, _ in table.dtypes if x not in words]
        key = F.concat_ws("|", *[F.coalesce(col(w).cast("string"), F.lit("")) for w in words]) if words else F.lit("")
        cells = F.array(*[F.struct(F.lit(x).alias("measure"), (F.round(col(x).cast("double"), digits) + 0.0).alias("value")) for x in numbers]) \
            if numbers else F.array(F.struct(F.lit("row").alias("measure"), F.lit(1.0).alias("value")))
        part = table.select(F.lit(name).alias("section"), key.alias("key"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out
