"""A fitted plan that is kept and applied to other rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.operators import features as X
from peoplelens.plans import fitted
from peoplelens.session import new_folder, staged

RULES = R.Rules(expected=(), safe_zones={"pay": (0, None)}, bins={"years": ((0, 10, float("inf")), ("new", "old"))}, groups={"town": {"south": ("Ulm",), "north": ("Kiel",)}})


def rows(spark):
    data = [(i % 7 + 1, float(10 + i % 13), ["Ulm", "Kiel", "ulm", "Bonn"][i % 4], f"team {i % 5}", ["yes", "no"][i % 2], float(i % 29)) for i in range(200)]
    data += [(3, 1000.0, "Ulm", "?", "yes", None), (40, None, None, "team 1", "no", 3.0), (3, 11.0, " Ulm ", "team 1", None, 4.0)]
    return spark.createDataFrame(data, "age int, pay double, town string, team string, member string, years double")


@pytest.fixture(scope="module")
def plan(spark):
    return fitted.fit(rows(spark), RULES)


def values(df):
    return sorted(map(str, (json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())))


def test_saving_and_loading_changes_nothing(spark, plan):
    folder = plan.save(new_folder(spark, "plan"))
    again = fitted.load(spark, folder)
    assert again.columns == plan.columns and values(again.parameters()) == values(plan.parameters()) and again.offsets() == plan.offsets()
    assert values(again.apply(rows(spark))) == values(plan.apply(rows(spark)))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        plan.save(folder)


def test_every_row_is_kept_and_coded_by_the_fitted_levels(spark, plan):
    done = plan.apply(rows(spark))
    assert done.count() == rows(spark).count()
    levels = {}
    for r in plan.levels.collect():
        levels.setdefault(r["column"], {})[r["value"]] = r["code"]
    for column, codes in levels.items():
        assert [codes[v] for v in sorted(codes)] == list(range(len(codes)))
    assert set(levels["town"]) == {"south", "north", "Bonn"} and set(levels["years"]) <= {"new", "old", "nan"}
    kinds = {c: kind for c, (kind, _) in plan.steps["encoding"].items()}
    nominal = [c for c, kind in kinds.items() if kind == X.ONE_HOT]
    size = sum(len(levels[c]) - 1 for c in nominal)
    for r in done.collect():
        assert r.one_hot.size == size and r.one_hot.indices == sorted(set(r.one_hot.indices)) and r.one_hot.values == [1.0] * len(r.one_hot.indices)
        assert len(r.one_hot.indices) <= len(nominal) and all(0 <= i < size for i in r.one_hot.indices)


def test_vector_equals_the_wide_columns(spark, plan):
    """Index by index the sparse vector is the 0/1 columns of ``one_hot`` over the same levels."""
    cleaned = staged(plan.cleaned(rows(spark)), "t")
    logs = plan.steps["log"]
    logged = X.log_transform(cleaned, {c: m for c, (m, _) in logs.items()}, {c: lam for c, (_, lam) in logs.items()})
    named = staged(fitted._named(logged, plan.steps["bins"], plan.steps["groups"]), "t")
    nominal = list(plan.offsets())
    wide = X.one_hot(named.select(*nominal), nominal, X.one_hot_levels(named, nominal))
    want = [wide.agg(F.sum(F.col(f"`{c}`"))).first()[0] for c in wide.columns]
    got = {r["i"]: r["count"] for r in plan.encoded(cleaned).select(F.explode("one_hot.indices").alias("i")).groupBy("i").count().collect()}
    assert [got.get(i, 0) for i in range(len(want))] == want


def test_rows_that_the_fit_has_not_seen(spark, plan):
    other = spark.createDataFrame([(None, None, "Rome", "new team", "maybe", None, 1), (500, -5000.0, "KIEL", None, "no", 99.0, 2)],
                                  "age int, pay double, town string, team string, member string, years double, extra int")
    seen = plan.cleaned(other).collect()
    assert plan.apply(other).columns == plan.apply(rows(spark)).columns and plan.apply(other).count() == 2
    assert all(v is not None for v in seen[0]) and seen[0].town == "Rome" and seen[1].pay >= 0
    first = plan.apply(other).collect()
    label_coded = [c for c, (kind, _) in plan.steps["encoding"].items() if kind == X.LABEL]
    assert any(r[c] is None for r in first for c in label_coded)
    with pytest.raises(ValueError, match="town"):
        plan.apply(other.drop("town"))
    assert plan.apply(other.limit(0)).isEmpty()


def test_level_codes_of_all_columns(spark):
    df = spark.createDataFrame([(f"v{i % 300:03}", None if i % 3 else f"x{i % 7}", "same") for i in range(2000)], "a string, b string, c string").repartition(6)
    got = {(r["column"], r["value"]): r["code"] for r in X.level_codes(df, ["a", "b", "c"]).collect()}
    want = {}
    for c in "abc":
        for i, r in enumerate(sorted({r[c] for r in df.collect()} - {None})):
            want[c, r] = i
    assert got == want and X.level_codes(df, []).isEmpty()
