"""Audit state: parts of batches that add up to the audit of all rows."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from peoplelens import rules as R
from peoplelens.functions.quantiles import column_quantiles
from peoplelens.operators import audit, frequency, state
from peoplelens.operators.profile import moments
from peoplelens.session import HUGE_METHOD, create_file, new_folder

RULES = R.Rules(expected=(), safe_zones={"pay": (0, 500)}, bins={}, groups={})
SCHEMA = "pay double, `Team Name` string, born timestamp, code int"


def rows(spark, start=0, stop=300):
    data = [(float((i * 37) % 101) ** 2, ["Ulm", "ulm", " Ulm", "?", None][i % 5], None, i % 4) for i in range(start, stop)]
    return spark.createDataFrame([*data, *data[:9], (float("nan"), "n/a", None, None), (-0.0, None, None, 1), (0.0, None, None, 1)], SCHEMA)


def fresh(spark):
    return state.AuditState(spark, new_folder(spark, "state"), RULES)


def values(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def merged(spark):
    a, b = fresh(spark), fresh(spark)
    assert a.add("one", rows(spark)) and a.add("two", rows(spark, 300, 650)) and b.add("three", rows(spark, 100, 400))
    assert b.add("empty", rows(spark).limit(0))
    whole = rows(spark).unionByName(rows(spark, 300, 650)).unionByName(rows(spark, 100, 400))
    return a.merged_into(new_folder(spark, "state"), b), whole


def test_merged_audit_is_the_audit_of_all_rows(merged):
    got, whole = merged
    wanted = audit.audit_result(whole, RULES).where("section NOT IN ('low_variance', 'outliers')")
    assert values(got.audit()) == values(wanted)
    assert got.batches() == ["empty", "one", "three", "two"]


def test_moments_and_distinct_values(merged):
    got, whole = merged
    wanted = {r["column"]: r for r in moments(whole).collect()}
    found = {r["column"]: r for r in got.profile().collect()}
    for c, r in wanted.items():
        f = found[c]
        assert f["rows"] - f["missing"] == r["n"] and f["missing"] == r["missing"] and (f["low"], f["high"]) == (r["min"], r["max"])
        for name in ("mean", "std", "skewness"):
            assert f[name] == pytest.approx(r[name], rel=1e-9, abs=1e-9)
    assert found["born"]["missing"] == whole.count() and found["born"]["mean"] is None
    exact = {r["column"]: r["distinct_values"] for r in audit.distinct_counts(whole).collect()}
    assert all(found[c]["distinct_estimate"] == pytest.approx(exact.get(c, 0), rel=0.05) for c in found)


def test_exact_quantiles_from_merged_sketches(spark):
    many = spark.range(40_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("x"), F.lit(5.0).alias("flat"), F.lit(None).cast("double").alias("gone"))
    s = fresh(spark)
    for i in range(3):
        s.add(f"b{i}", many.where(F.pmod(F.hash("x"), F.lit(3)) == i))
    probs = (0.0, 0.25, 0.5, 0.999, 1.0)
    wanted = many.select(F.expr(f"percentile(x, array{probs})")).first()[0]
    assert s.quantiles(many, probs) == {"x": pytest.approx(wanted), "flat": [5.0] * 5, "gone": [None] * 5}


def test_brackets_that_miss_their_ranks_are_noticed(spark):
    many = spark.range(30_000).selectExpr("double(id) AS x", "double(id % 10) AS y")
    wrong = {"x": (30_000, 0.0, 29_999.0, [3.0, 9.0]), "y": (30_000, 0.0, 9.0, [9.0, 9.0])}
    assert column_quantiles(many, {"x": "x", "y": "y"}, (0.5,), wrong, certain=False) == {"x": [14_999.5], "y": [4.5]}


def test_a_batch_counts_once_and_only_when_committed(spark):
    s = fresh(spark)
    assert s.batches() == [] and s.profile().count() == 0
    assert s.add("one", rows(spark)) and not s.add("one", rows(spark, 0, 20))
    before = values(s.audit())
    s._write("data-broken", {"columns": state._column_parts(rows(spark), RULES), "values": s.values(), "rows": s.rows()})
    create_file(spark, f"{s.folder}/commits/two", "")  # an attempt that broke off between creating and writing its commit
    assert s.batches() == ["one"] and values(s.audit()) == before
    assert s.add("two", rows(spark, 300, 400)) and s.batches() == ["one", "two"]
    with pytest.raises(ValueError):
        s.add("no/name", rows(spark))
    with pytest.raises(ValueError):
        s.merged_into(new_folder(spark, "state"), s)


def test_columns_absent_reordered_or_of_another_kind(spark):
    s = fresh(spark)
    s.add("one", spark.createDataFrame([(1, "a"), (2, None)], "x int, t string"))
    s.add("two", spark.createDataFrame([("b", 2), ("c", 3), ("c", 4)], "t string, x int"))
    s.add("three", spark.createDataFrame([(5,)], "x int"))
    found = {r["column"]: (r["rows"], r["missing"], r["mean"]) for r in s.profile().collect()}
    assert found == {"x": (6, 0, pytest.approx(17 / 6)), "t": (6, 2, None)}
    again = s.merged_into(new_folder(spark, "state"))
    assert {r["column"]: (r["rows"], r["missing"]) for r in again.profile().collect()} == {"x": (6, 0), "t": (6, 2)}
    s.add("four", spark.createDataFrame([("5",)], "x string"))
    with pytest.raises(Exception, match="several kinds"):
        s.profile().collect()


def test_signatures_tell_rows_apart_as_grouping_does(spark):
    data = [("a", "bc", 0.0, b"1"), ("ab", "c", 0.0, b"1"), ("a", "bc", -0.0, b"1"), (None, "bc", 0.0, b"1"), ("-", "bc", 0.0, b"1"),
            ("", "bc", 0.0, None), ("", "bc", float("nan"), None), ("", "bc", float("nan"), None)]
    df = spark.createDataFrame(data, "a string, b string, c double, d binary").withColumn("e", F.array("a", "b"))
    assert df.select(state.signature(df)).distinct().count() == df.distinct().count() == 6


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_one_folder_are_not_added_up_again(merged):
    got, whole = merged
    assert "Exchange" not in plan(got.rows()) and "Exchange" not in plan(got.values())
    assert got.rows().agg(F.sum("n"), F.count("*")).first()[:] == (whole.count(), whole.select(state.signature(whole)).distinct().count())
    assert got.rows().select("signature").distinct().count() == got.rows().count()


def test_text_columns_are_counted_from_their_values_alone(spark, tmp_path):
    many = spark.range(3_000).selectExpr("double(id % 70) AS x", "CASE WHEN id % 3 > 0 THEN concat('t', id % 40) END AS `Team Name`", "CAST(NULL AS STRING) AS gone")
    many.write.parquet(f"{tmp_path}/many")
    held = spark.read.parquet(f"{tmp_path}/many")
    frequency.text_frequency(held).write.parquet(f"{tmp_path}/values")
    parts = state._column_parts(held, RULES, spark.read.parquet(f"{tmp_path}/values"))
    scans = [line for line in plan(parts).splitlines() if "FileScan" in line and "values" not in line]
    assert len(scans) == 1 and "Team Name" not in scans[0].split("ReadSchema:")[1]
    for found in (parts, state._column_parts(held, RULES)):
        rows = {r["column"]: r for r in found.selectExpr("*", "hll_sketch_estimate(distinct_values) AS d").collect()}
        assert {c: (r["kind"], r["position"], r["rows"], r["filled"], r["outside"], r["mean"]) for c, r in rows.items()} == {
            "x": ("number", 0, 3_000, 3_000, 0, pytest.approx(many.agg(F.avg("x")).first()[0])), "Team Name": ("text", 1, 3_000, 2_000, 0, None),
            "gone": ("text", 2, 3_000, 0, 0, None)}
        assert rows["Team Name"]["d"] == pytest.approx(40, abs=1) and rows["gone"]["d"] is None and rows["Team Name"]["numbers"] is None


def test_parts_are_written_as_methods_that_hotspot_compiles(spark, monkeypatch):
    s, limits, held = fresh(spark), [], spark.conf.get(HUGE_METHOD)
    write = state.compiled_methods

    @contextmanager
    def seen(session):
        with write(session):
            limits.append(session.conf.get(HUGE_METHOD))
            yield
            limits.append(session.conf.get(HUGE_METHOD))

    monkeypatch.setattr(state, "compiled_methods", seen)
    try:
        spark.conf.set(HUGE_METHOD, "65535")
        s.add("one", rows(spark))
        assert set(limits) == {"8000"} and spark.conf.get(HUGE_METHOD) == "65535"
    finally:
        spark.conf.set(HUGE_METHOD, held)


def test_batches_of_the_query_compute_the_table_once(spark, folk, monkeypatch):
    from catalog import audit as queries

    calls, given = [], []
    add = state.AuditState.add
    monkeypatch.setattr(queries, "people", lambda *a: calls.append(a) or folk)
    monkeypatch.setattr(state.AuditState, "add", lambda self, batch, df: given.append(df) or add(self, batch, df))
    found = values(queries.q22_state(spark, "unused"))
    wanted = audit.audit_result(folk).where("section NOT IN ('low_variance', 'outliers')")
    assert [r[:2] for r in found] == [r[:2] for r in values(wanted)] and [r[2] for r in found] == pytest.approx([r[2] for r in values(wanted)], abs=1e-5)
    assert len(calls) == 1 and all("orders.parquet" not in plan(df) and "PartitionFilters: [isnotnull(part" in plan(df) for df in given)
    assert sum(df.count() for df in given) == 2 * folk.count() and given[0].columns == folk.columns
