"""Literal tables with hand-computed answers for null, tie, rounding and parsing rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from peoplelens.functions import expr as X
from peoplelens.functions.frames import small_frame
from peoplelens.operators import association as A
from peoplelens.operators import cleaning as C
from peoplelens.operators import exploration as E
from peoplelens.operators import features as T
from peoplelens.operators import frequency as V
from peoplelens.operators import profile as S
from peoplelens.rules import Rules, resolve_fields
from peoplelens.sources.scan import null_tokens


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(spark, values, kind, make):
    df = column(spark, values, kind).select("i", make(F.col("v")).alias("r")).orderBy("i")
    return [r["r"] for r in df.collect()]


def test_number_parsing(spark):
    given = ["12d", "1_000", " 12 ", "1e3", "inf", "0x10", "1,000", "", "True", "+5", ".5", "5.", None]
    want = [None, None, 12.0, 1000.0, float("inf"), None, None, None, None, 5.0, 0.5, 5.0, None]
    assert evaluate(spark, given, "string", X.parse_number) == want


def test_strip_removes_unicode_whitespace(spark):
    given = ["\ta　", "  ", "a b", "", None, "\xa0é ", "x "]
    assert evaluate(spark, given, "string", X.strip) == ["a", "", "a b", "", None, "é", "x"]


def test_noise(spark):
    given = ["é", "²", "½", "a", "1", "/", "?", "_", " ", " N/A ", "#REF!", "n.a", "Unknown", ""]
    want = [False] * 5 + [True] * 6 + [False, True, True]
    assert evaluate(spark, given, "string", X.is_noise) == want


def test_null_tokens(spark):
    given = ["", "NA", "N/A", "n/a", "null", "NULL", "None", "none", "nan", "NaN", "?", "-", "#N/A", "unknown", "<NA>", "Na"]
    kept = [r["v"] for r in null_tokens(column(spark, given, "string")).collect() if r["v"] is not None]
    assert sorted(kept) == sorted(["none", "?", "-", "unknown", "Na"])


def test_target_and_label(spark):
    assert evaluate(spark, [" >50K. ", "<=50K", None], "string", X.is_target) == [True, False, False]
    rates = E.rate_by(spark.createDataFrame([("a", True), (None, False), ("a", True)], "g string, t boolean"),
                      F.col("g"), F.col("t")).collect()
    assert {r["label"]: r["rate"] for r in rates} == {"a": 1.0, "nan": 0.0}


def test_skewness(spark):
    def skew(values):
        return S.fit_profiles(column(spark, values, "double"), ["v"], quantiles=False, mad=False)["v"].skew

    assert skew([1.0, 2.0, 3.0, 10.0]) == 1.764
    assert skew([5.0, 5.0, 5.0]) == 0.0
    assert skew([1.0, 2.0]) is None


def test_quantiles_mad_std(spark):
    p = S.fit_profiles(column(spark, [1.0, 2.0, 3.0, 10.0, None, float("nan")], "double"), ["v"])["v"]
    assert (p.q1, p.median, p.q3, p.mad) == (1.75, 2.5, 4.75, 1.0)
    assert p.std == pytest.approx(4.0825, abs=1e-4)
    assert (p.n, p.missing) == (4, 2)


def test_mode_tie_takes_smallest(spark):
    assert V.column_modes(column(spark, list("babaz"), "string"), ["v"]).first()["mode"] == "a"


def test_half_even_cast(spark):
    rules = Rules(expected=(("v", "int64", "numeric"),))
    got = C.cast_types(column(spark, ["0.5", "1.5", "2.5", "x", "9007199254740993"], "string"), rules).orderBy("i")
    assert [r["v"] for r in got.collect()] == [0, 2, 2, None, 9007199254740993]


def test_cut(spark):
    given = [0.0, 25.0, 25.5, 120.0, 121.0, -1.0, None]
    assert evaluate(spark, given, "double", lambda c: X.cut(c, (0, 25, 35, 120), ("a", "b", "c"))) == \
        ["a", "a", "b", "c", None, None, None]


def test_one_hot_drops_first(spark):
    got = T.one_hot(column(spark, ["b", "a", None, "c"], "string").withColumnRenamed("v", "c"), ["c"]).orderBy("i")
    assert [(r["c_b"], r["c_c"]) for r in got.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "a string, b string")
    assert C.duplicate_summary(df).first()["redundant_rows"] == 1


def test_expected_count_and_v():
    assert 900 * 1300 / 2000 == 585
    assert (450 / (2000 * 1)) ** 0.5 == pytest.approx(0.474, abs=5e-4)


def test_v_of_a_known_table(spark):
    cells = {("hs", "low"): 800, ("hs", "high"): 100, ("ba", "low"): 300, ("ba", "high"): 300, ("ma", "low"): 200, ("ma", "high"): 300}
    df = small_frame(spark, "a string, b string, n int", [(a, b, n) for (a, b), n in cells.items()])
    rows = df.select("a", "b", F.explode(F.sequence(F.lit(1), F.col("n"))))
    total = sum(cells.values())
    chi = 0.0
    for (a, b), o in cells.items():
        e = sum(v for k, v in cells.items() if k[0] == a) * sum(v for k, v in cells.items() if k[1] == b) / total
        chi += (o - e) ** 2 / e
    r = A.cramers_v(rows, F.col("a"), F.col("b")).first()
    assert r["chi2"] == pytest.approx(chi) and r["v"] == pytest.approx((chi / total) ** 0.5)


def test_v_degenerate_and_yates(spark):
    one = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    assert A.cramers_v(one, F.col("a"), F.col("b")).first()["v"] == 0.0
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 15}
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    chi, n = 0.0, 75
    for (a, b), o in cells.items():
        e = sum(v for k, v in cells.items() if k[0] == a) * sum(v for k, v in cells.items() if k[1] == b) / n
        chi += (abs(o - e) - 0.5) ** 2 / e
    assert A.cramers_v(spark.createDataFrame(rows, "a string, b string"), F.col("a"), F.col("b")).first()["chi2"] == pytest.approx(chi)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(0.1, float(i)) for i in range(20)], "c double, x double")
    got = {(r["x"], r["y"]): r["r"] for r in S.correlations(df).collect()}
    assert got[("c", "x")] is None and got[("c", "c")] is None and got[("x", "x")] == pytest.approx(1.0)
    assert A.point_biserial(df, F.col("c"), F.col("x") > 5).first()["r"] is None
    assert A.point_biserial(df.limit(5), F.col("x"), F.col("x") > 2).first()["r"] == 0.0


def test_fields_and_rules():
    assert resolve_fields(["Gender", "Hours-per-Week"])["sex"] == "Gender"
    assert resolve_fields(["Gender", "Hours-per-Week"])["hours"] == "Hours-per-Week"
    rules = Rules.from_dict({"safe_zones": {"Base Pay": {"min": 1}}, "noise_tokens": ["N.V."],
                             "binning": {"Age": {"type": "bin", "bins": [0, 1], "labels": ["a", "b"]},
                                         "Team": {"type": "map", "groups": {"g": ["x", "y"], "h": ["y"]}}}})
    assert rules.zone("base_pay") == (1, None) and rules.noise_tokens == ("n.v.",)
    assert rules.bin_rule("age") is None and rules.group_rule("team") == {"x": "g", "y": "h"}
