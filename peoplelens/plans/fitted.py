"""The nine steps as a fitted plan that can be kept and applied to other rows.

``fit`` runs the steps once and keeps what they learned: a parameter table with one row for each step and column (JSON), the table of casing
replacements and the table of label codes. The two tables stay DataFrames, so their size is no matter for the driver. ``save`` writes
the three as Parquet, ``load`` reads them, ``apply`` turns any table of the same columns into features without looking at more than one row at a time.

Defined rules for rows that the fit has not seen: a gap takes the fitted fill value of its column, also where the fitted table had no gap; a spelling
that is new stays as it is; a value without a code is NULL in a label-coded column and sets no cell of the one-hot vector; a bin without rows in
the fitted table likewise. Numbers are capped by the fitted limits. ``apply`` keeps every row (dropping repeated rows is part of the fit only).
A column that is missing raises; columns that the fit has not seen are left out.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.expr import (
    col, cut, integral_columns, label, number, numeric_columns, replace_by, text_columns,
)
from peoplelens.functions.frames import apply_replacements, small_frame
from peoplelens.operators import cleaning as C
from peoplelens.operators import features as X
from peoplelens.operators.frequency import column_modes
from peoplelens.operators.outliers import capped, choose_method, default_threshold
from peoplelens.operators.profile import Profile, fit_profiles
from peoplelens.session import staged

PARAMETERS = "position int, step string, column string, parameters string"
ONE_HOT = "one_hot"


def fill_values(df: DataFrame) -> dict:
    """Fill value of every column, whether it has gaps or not."""
    values = {p.column: p.mean if C.fill_strategy(p) == "mean" else p.median for p in fit_profiles(df, numeric_columns(df), mad=False).values()}
    whole = {c: round(values[c]) for c in integral_columns(df) if values.get(c) is not None}
    modes = {r["column"]: r["mode"] for r in column_modes(df).collect()} if text_columns(df) else {}
    return {c: v for c, v in (values | whole | modes).items() if v is not None}


def _capped(df: DataFrame, limits: dict) -> DataFrame:
    """``limits``: column → profile, method and safe zone."""
    picks = {c: capped(df, c, p, m, default_threshold(m), zone) for c, (p, m, zone) in limits.items() if c in df.columns}
    return df.select(*[picks[c].alias(c) if c in picks else col(c) for c in df.columns])


def _named(df: DataFrame, bins: dict, groups: dict) -> DataFrame:
    """Bins (an absent number is the category ``nan``) and groups."""
    picks = {c: label(cut(number(df, c), edges, labels)) for c, (edges, labels) in bins.items()}
    picks |= {c: replace_by(col(c), mapping) for c, mapping in groups.items()}
    return df.select(*[picks[c].alias(c) if c in picks else col(c) for c in df.columns])


@dataclass
class FittedPlan:
    """``steps``: {step: {column: parameters}} in the order of ``columns``; ``replacements`` (column, value, replacement); ``levels`` (column, value, code)."""

    columns: list[str]
    steps: dict[str, dict]
    replacements: DataFrame
    levels: DataFrame

    # --- keep --------------------------------------------------------------------------------------------------

    def parameters(self) -> DataFrame:
        rows = [(i, "column", c, "null") for i, c in enumerate(self.columns)]
        rows += [(i, step, c, json.dumps(p)) for step, found in self.steps.items() for i, (c, p) in enumerate(found.items())]
        return small_frame(self.levels.sparkSession, PARAMETERS, rows)

    def save(self, folder: str) -> str:
        """Write the plan to a folder that does not exist yet."""
        for name, table in (("replacements", self.replacements), ("levels", self.levels), ("parameters", self.parameters())):
            table.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")
        return folder

    # --- apply -------------------------------------------------------------------------------------------------

    def _profiles(self, step: str) -> dict:
        return {c: (Profile(**p), *rest) for c, (p, *rest) in self.steps.get(step, {}).items()}

    def cleaned(self, df: DataFrame) -> DataFrame:
        """Steps 1 to 5 without the removal of repeated rows."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns of the plan are missing: {', '.join(missing)}")
        out = apply_replacements(C.trim_text(df.select(*map(col, self.columns))), self.replacements, list(self.steps.get("casing", {})))
        decisions = [C.TypeDecision(c, "", kind, "", 0, 0) for c, kind in self.steps.get("type", {}).items()]
        out = C.cast_types(out, decisions=decisions)
        out = C.clean_noise(out, "replace_nan", rules=R.Rules(noise_tokens=tuple(self.steps["noise"]["tokens"])))
        return _capped(C.impute(out, self.steps.get("fill", {})), self._profiles("limit"))

    def coded(self, df: DataFrame) -> DataFrame:
        """Steps 1 to 8: numbers, label codes, and ``one_hot`` (size, indices, values), a sparse vector over all nominal columns."""
        return self.encoded(self.cleaned(df))

    def encoded(self, out: DataFrame) -> DataFrame:
        """Steps 6 to 8 on cleaned rows."""
        logs = self.steps.get("log", {})
        out = X.log_transform(out, {c: m for c, (m, _) in logs.items()}, {c: lam for c, (_, lam) in logs.items()})
        out = _named(out, self.steps.get("bins", {}), self.steps.get("groups", {}))
        kinds = {c: kind for c, (kind, _) in self.steps.get("encoding", {}).items()}
        for c, kind in kinds.items():
            if kind != X.DROP:
                side = self.levels.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
                out = out.join(side, col(c).cast("string") == F.col("_value"), "left").select(
                    *[F.col("_code").alias(c) if k == c else col(k) for k in out.columns])
        cells = [F.when(col(c) > 0, col(c) + F.lit(start - 1)) for c, start in self.offsets().items()]
        size = sum(n - 1 for kind, n in self.steps.get("encoding", {}).values() if kind == X.ONE_HOT and n)
        vector = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<bigint>")
        numbers = [col(c) for c in out.columns if kinds.get(c) not in (X.DROP, X.ONE_HOT)]
        return out.select(*numbers, vector.alias("_cells")).select(*numbers, F.struct(
            F.lit(size).cast("bigint").alias("size"), F.col("_cells").alias("indices"),
            F.transform("_cells", lambda x: F.lit(1.0)).alias("values")).alias(ONE_HOT))

    def offsets(self) -> dict[str, int]:
        """First index of each one-hot column; its first level has no index."""
        nominal = {c: max(n - 1, 0) for c, (kind, n) in self.steps.get("encoding", {}).items() if kind == X.ONE_HOT}
        return dict(zip(nominal, accumulate(nominal.values(), initial=0)))

    def apply(self, df: DataFrame) -> DataFrame:
        """All steps for every row of ``df``."""
        return X.scale(self.coded(df), self._profiles("scale"))


def fit(df: DataFrame, rules: R.Rules = R.Rules(), skip_binned: bool = False) -> FittedPlan:
    """Fit the steps one after another, each on the output of the step before."""
    steps: dict[str, dict] = {"noise": {"tokens": sorted(rules.noise_tokens)}}
    trimmed = staged(C.trim_text(df), "trimmed")
    replacements = staged(C.casing_map(trimmed), "casing")
    steps["casing"] = {c: None for c in sorted(r["column"] for r in replacements.select("column").distinct().collect())}
    unified = apply_replacements(trimmed, replacements, list(steps["casing"]))
    decisions = C.decide_types(unified, rules)
    steps["type"] = {d.column: d.target for d in decisions}
    unique = staged(C.drop_duplicates(C.clean_noise(C.cast_types(unified, rules, decisions), "replace_nan", rules=rules)), "unique")
    steps["fill"] = fill_values(unique)
    full = C.impute(unique, steps["fill"])
    profiles = {c: p for c, p in fit_profiles(full).items() if p.n >= 3}
    limits = {c: (p, choose_method(p).method, rules.zone(c)) for c, p in profiles.items()}
    steps["limit"] = {c: (asdict(p), m, zone) for c, (p, m, zone) in limits.items()}
    cleaned = staged(_capped(full, limits), "cleaned")
    methods = {r["column"]: r["method"] for r in X.log_candidates(cleaned, skip_binned, rules).collect()}
    lambdas = X.fit_yeo_johnson(cleaned, [c for c, m in methods.items() if m == X.YEO_JOHNSON])
    steps["log"] = {c: (m, lambdas.get(c)) for c, m in methods.items()}
    logged = X.log_transform(cleaned, methods, lambdas)
    steps["bins"] = {c: rules.bin_rule(c) for c in numeric_columns(logged) if rules.bin_rule(c)}
    steps["groups"] = {c: dict(rules.group_rule(c)) for c in text_columns(logged) if rules.group_rule(c)}
    named = staged(_named(logged, steps["bins"], steps["groups"]), "named")
    kinds = {e.column: e.encoding for e in X.plan_encoding(X.bin_and_group(logged, rules), rules)}
    levels = staged(X.level_codes(named, [c for c, kind in kinds.items() if kind != X.DROP]), "levels")
    sizes = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.count("*").alias("n")).collect()}
    steps["encoding"] = {c: (kind, sizes.get(c, 0)) for c, kind in kinds.items()}
    plan = FittedPlan(df.columns, steps, replacements, levels)
    coded = staged(plan.encoded(cleaned), "coded")
    scaling = X.plan_scaling(coded, numeric_columns(coded))
    steps["scale"] = {c: (asdict(p), m) for c, (p, m) in scaling.items()}
    return plan


def load(spark: SparkSession, folder: str) -> FittedPlan:
    """Read a saved plan."""
    read = lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    columns, steps = [], {}
    for r in read("parameters").orderBy("step", "position").collect():
        if r["step"] == "column":
            columns.append(r["column"])
        else:
            steps.setdefault(r["step"], {})[r["column"]] = json.loads(r["parameters"])
    return FittedPlan(columns, steps, read("replacements"), read("levels"))
