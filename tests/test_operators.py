"""Brute-force comparisons, properties, and the ways taken beyond the size bounds."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peoplelens.functions import quantiles as Q
from peoplelens.operators import association as A, audit, cleaning as C, exploration as E, features as T, frequency as V, insights as N, outliers as O
from peoplelens.operators.profile import correlations, fit_profiles, histogram
from peoplelens.plans import dashboard, nine_step
from peoplelens.rules import Rules
from peoplelens.sources import scan, sink

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def samples():
    rng = random.Random(3)
    return {
        "unique": [rng.gauss(0, 1e6) for _ in range(4000)],
        "spike": [0.0] * 3000 + [rng.random() for _ in range(1000)],
        "heavy": [math.exp(rng.gauss(0, 12)) for _ in range(4000)],
        "few": [float(rng.randrange(5)) for _ in range(4000)],
    }


@pytest.mark.parametrize("accuracy", [2_000, 200])
def test_column_quantiles_against_numpy(spark, monkeypatch, accuracy):
    """With the coarse sketch the brackets of 4000 rows are real ones; with the fine one all rows are ranked."""
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    monkeypatch.setattr(Q, "GRID", min(Q.GRID, accuracy // 10))
    data = samples()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(4)
    got = Q.column_quantiles(df, {c: c for c in data}, PROBS)
    for c, values in data.items():
        np.testing.assert_allclose(got[c], np.percentile(values, [p * 100 for p in PROBS]), rtol=1e-12)


def jobs_of(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(tracker.getJobIdsForGroup(group))


def test_profiles_take_few_jobs_whatever_the_shape(spark):
    rng = np.random.default_rng(4)
    values = np.exp(rng.normal(0, 3, 30_000))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    # Three scans each for quartiles and MAD; an adaptive plan runs every shuffle as a job of its own.
    assert jobs_of(spark, lambda: fit_profiles(df)) <= 16
    p = fit_profiles(df)["x"]
    np.testing.assert_allclose([p.q1, p.median, p.q3], np.percentile(values, [25, 50, 75]))
    assert p.mad == pytest.approx(np.median(np.abs(values - np.median(values))))


def scans(df):
    """Scans of files or rows in the plan that Spark runs, a reused exchange counting once."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_scan_counts(spark, folk):
    assert scans(audit.dataset_metrics(folk)) == 1
    assert scans(audit.integrity(folk)) == 1
    assert scans(V.hierarchy(folk, ["sex", "race", "education"])) == 1
    assert scans(A.cramers_v(folk, F.col("education"), F.col("occupation"))) == 1
    assert scans(N.dataset_context(folk)) == 1
    assert scans(N.insight_record(folk)) <= 3


def test_quantiles_of_infinite_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None), (2.0, None)], "a double, b double")
    got = Q.column_quantiles(df, {"a": "a", "b": "b"}, (0.0, 0.5))
    assert got == {"a": [1.0, 2.0], "b": [None, None]}


def test_grouped_quantiles_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 4}", rng.choice([rng.random(), 0.5])) for i in range(3000)]
    got = Q.grouped_quantiles(spark.createDataFrame(rows, "key string, value double"), (0.25, 0.5, 0.9))
    for r in got.collect():
        np.testing.assert_allclose(r["quantiles"], np.percentile([v for k, v in rows if k == r["key"]], [25, 50, 90]))


def test_hundred_columns_take_two_scans(spark, tmp_path):
    """Pairwise-complete r of all pairs of a wide table with gaps, an infinite value and a constant column, from one pass for means and one for sums."""
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 100)) @ rng.normal(size=(100, 100)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[3, 11], x[:, 12] = 5.0, np.inf, np.nan
    path = str(tmp_path / "wide")
    spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"c{i} double" for i in range(100))).write.parquet(path)
    found = correlations(spark.read.parquet(path))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["x"], r["y"]): r["r"] for r in found.collect()}
    assert len(got) == 100 * 100
    for i in range(0, 100, 3):
        for j in range(100):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[f"c{i}", f"c{j}"]
            if {i, j} & {7, 12} or 11 in (i, j) and both[3]:
                assert r is None or np.isnan(r)
            else:
                assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert correlations(spark.read.parquet(path), []).isEmpty()


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(1e6, 3, 500)
    b = a * 2 + rng.normal(0, 5, 500)
    df = spark.createDataFrame([(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    keep = np.arange(500) % 7 != 0
    got = {(r["x"], r["y"]): r["r"] for r in correlations(df).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1], abs=1e-9)


def test_yeo_johnson_lambda(spark):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(0, 0.8, 3000)) - 1.5
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double")

    def likelihood(lam, v):
        p, n = v >= 0, v < 0
        t = np.empty_like(v)
        t[p] = np.log1p(v[p]) if lam == 0 else ((v[p] + 1) ** lam - 1) / lam
        t[n] = -np.log1p(-v[n]) if lam == 2 else -((1 - v[n]) ** (2 - lam) - 1) / (2 - lam)
        return -len(v) / 2 * np.log(t.var()) + (lam - 1) * np.sum(np.sign(v) * np.log1p(np.abs(v)))

    for c, v in (("x", x), ("y", -x)):
        lo, hi = -4.0, 6.0
        for _ in range(80):
            a, b = lo + (hi - lo) * 0.381966, lo + (hi - lo) * 0.618034
            lo, hi = (lo, b) if likelihood(a, v) > likelihood(b, v) else (a, hi)
        assert T.fit_yeo_johnson(df, ["x", "y"])[c] == pytest.approx((lo + hi) / 2, abs=1e-5)


def test_label_codes_beyond_literals(spark):
    values = [f"v{i:04d}" for i in range(700)]
    df = spark.createDataFrame([(v, v) for v in values] + [(None, None)], "k string, v string").repartition(5)
    got = {r["k"]: r["v"] for r in T.label_encode(df, ["v"]).collect()}
    assert got == {**{v: i for i, v in enumerate(values)}, None: None}


@pytest.mark.parametrize("n", [300, 1200])
def test_explicit_orders_of_any_length(spark, n):
    values = [f"v{i:04d}" for i in range(n)]
    df = spark.createDataFrame([(v, v) for v in values] + [(None, None)], "k string, v string")
    got = {r["k"]: r["v"] for r in T.label_encode(df, ["v"], {"v": values[::-1]}).collect()}
    assert got == {**{v: n - 1 - i for i, v in enumerate(values)}, None: None}


@pytest.mark.parametrize("n", [300, 1200])
def test_one_hot_of_many_values(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("v"))
    hot = T.one_hot(df, ["v"])
    assert len(hot.columns) == n - 1
    assert T.one_hot_long(df.withColumn("k", F.col("v")), "k", ["v"]).select(F.sum("level")).first()[0] == n * (n - 1) // 2


def test_one_hot_names_never_clash(spark, tmp_path):
    df = spark.createDataFrame([("A", "c"), ("a", "b_c"), ("b", "x"), (None, "x")], "a string, a_b string")
    hot = T.one_hot(df, ["a", "a_b"])
    assert len({c.lower() for c in hot.columns}) == len(hot.columns) == 4
    hot.write.parquet(str(tmp_path / "hot"))
    assert hot.select(*[F.col(f"`{c}`") for c in hot.columns]).count() == 4
    twice = T.one_hot(spark.createDataFrame([("x", 1), ("Private", 2), ("private", 3)], "w string, w_private int"), ["w"])
    assert twice.columns == ["w_private", "w_private_2", "w_x"]


def test_replacements_with_null_and_hot_values(spark):
    rows = ["Male"] * 50 + ["MALE"] * 3 + ["male"] * 2 + ["x", "X", "X"] + [None] * 60
    got = C.unify_casing(spark.createDataFrame([(v, v) for v in rows], "a string, b string")).collect()
    assert sorted((r["a"] or "-") for r in got) == sorted(["Male"] * 55 + ["X"] * 3 + ["-"] * 60)


def test_long_identifiers_stay_apart(spark):
    df = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 1,), (2 ** 53 + 2,)], "id bigint")
    row = V.dominance(df).first()
    assert row["distinct_values"] == 3 and row["dominant_pct"] == pytest.approx(100 / 3)
    assert V.low_variance(df).isEmpty()


def test_low_variance_by_the_median(spark):
    rng = random.Random(1)
    rows = [(0.0 if i % 10 < 8 else rng.random(), 7 if i % 10 < 7 else i, None) for i in range(1000)]
    got = V.low_variance(spark.createDataFrame(rows, "a double, b int, c double")).collect()
    assert [(r["column"], r["dominant_value"], r["dominant_pct"], r["distinct_values"]) for r in got] == [("a", 0.0, 80.0, 201)]
    with pytest.raises(ValueError):
        V.low_variance(spark.createDataFrame(rows, "a double, b int, c double"), threshold=0.4)


def test_distinct_counts_ignore_nan_in_both_modes(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "x double")
    assert audit.distinct_counts(df).first()["distinct_values"] == audit.distinct_counts(df, exact=False).first()["distinct_values"] == 1


def test_yeo_johnson_without_spread(spark):
    df = spark.createDataFrame([(0.0, -5.0, None)] * 4, "a double, b double, c double")
    assert T.fit_yeo_johnson(df, ["a", "b", "c"]) == {"a": None, "b": None, "c": None}
    assert T.log_transform(df, {"b": T.YEO_JOHNSON}).first()["b"] == -5.0


def test_associations_of_nothing(spark):
    lone = spark.createDataFrame([(">50K",), ("<=50K",)] * 20, "income string")
    assert A.association_scores(lone, "income").isEmpty()
    assert E.top_feature_breakdown(lone, "income", F.col("income") == ">50K").isEmpty()
    # Ten values of its own make a column worth ranking, even where few of them have a target.
    rows = [("a" if i % 2 else "b", (">50K" if i % 2 else "<=50K") if i < 6 else None) for i in range(12)]
    assert A.association_scores(spark.createDataFrame(rows, "x string, income string"), "income").count() == 1


def test_archetype_strips_sex(spark):
    df = spark.createDataFrame([(" Male",), ("Male ",), ("Male",), ("Female",), ("Female",)], "sex string")
    got = E.archetype(df, F.lit(True), {"sex": F.col("sex")}).first()
    assert (got["label"], got["value"]) == ("Male", 60.0)


def test_grids_of_many_labels(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("r"), (F.col("id") % 1100).cast("string").alias("c"), (F.col("id") % 2 == 0).alias("t"))
    assert E.rate_grid(df, F.col("r"), F.col("c"), F.col("t")).count() == 1200
    assert V.grouped_counts(df, "r", "c").count() == 1200


def test_source_bytes(spark, folk, tmp_path):
    folder = tmp_path / "x"
    folk.repartition(3).write.parquet(str(folder))
    row = audit.source_bytes(spark.read.parquet(str(folder))).first()
    files = list(folder.glob("*.parquet"))
    assert (row["files"], row["bytes"]) == (len(files), sum(f.stat().st_size for f in files))


def test_capping_is_idempotent_and_respects_zones(spark):
    rows = [(float(v), int(v)) for v in [*range(20, 60), 200, -50]]
    df = spark.createDataFrame(rows, "x double, age int")
    once = O.treat(df, "iqr_capping", ["x", "age"])
    p = fit_profiles(df, ["x"])["x"]
    low, high = O.fences(p, O.IQR)
    got = once.agg(F.min("x"), F.max("x"), F.min("age"), F.max("age")).first()
    assert tuple(got) == (low, high, 10, 90)
    assert once.schema["age"].dataType.simpleString() == "int"


def test_fractional_fence_promotes_whole_numbers(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 6, 100]], "v bigint")
    got = O.treat(df, "iqr_capping", ["v"])
    assert got.schema["v"].dataType.simpleString() == "double"


def test_properties(spark, folk):
    shares = E.composition(folk, F.col("occupation"), F.col("education")).groupBy("row").agg(F.sum("pct").alias("s"))
    assert all(r["s"] == pytest.approx(100) for r in shares.collect())
    assert 0 <= audit.health_score(folk).first()["health_score"] <= 100
    scaled = T.robust_scale(folk.select("fnlwgt"), ["fnlwgt"])
    assert fit_profiles(scaled, ["fnlwgt"], mad=False)["fnlwgt"].median == pytest.approx(0)
    hot = T.one_hot(folk.select("race"), ["race"])
    assert hot.agg(F.max(sum(F.col(f"`{c}`") for c in hot.columns))).first()[0] == 1
    assert histogram(folk, "age", 30).agg(F.sum("n")).first()[0] == folk.where("age IS NOT NULL").count()


def test_empty_table(spark, folk):
    empty = folk.where("1 = 0")
    assert audit.health_score(empty).first()["health_score"] == 0.0
    assert audit.dataset_metrics(empty).first()["missing_pct"] == 0.0
    assert audit.consistency(empty).count() == 0
    assert {r["method"] for r in O.method_table(empty).collect()} == {"IQR"}


def test_result_does_not_depend_on_partitions(folk):
    def answers(df):
        return [sorted(map(str, f(df).collect())) for f in (
            audit.consistency, C.noise_report, C.missing_counts, O.method_table, O.preview,
            lambda d: T.label_encode(d.select("workclass"), ["workclass"]).groupBy("workclass").count())]

    assert answers(folk.repartition(1)) == answers(folk.repartition(8))


def test_quarantine_gives_each_record_its_reasons(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Age, City \n"Ann, B",31,Rome\nBob,x,NA\nCy,,"Os\nlo"\n\nDi,4,Bern,more\nEd\n,7,NULL\n"q""q",8,Ulm\n')
    schema = StructType().add("age", "integer").add("name", "string").add("city", "string")
    good, bad = scan.quarantine(spark, str(tmp_path), schema, required=("name", "city"), multiline=True)
    assert good.schema == schema
    assert {tuple(r) for r in good.collect()} == {(31, "Ann, B", "Rome"), (None, "Cy", "Os\nlo"), (8, 'q"q', "Ulm")}
    reasons = {r[scan.RECORD].strip(): sorted(r[scan.REASONS]) for r in bad.collect()}
    assert reasons == {"Bob,x,NA": ["missing:city", "unparsable:age"], "Di,4,Bern,more": ["fields"], "Ed": ["fields"], ",7,NULL": ["missing:city", "missing:name"]}
    assert good.count() == 3 and bad.count() == 4  # whichever columns are read
    with pytest.raises(scan.SchemaRejected):
        scan.quarantine(spark, str(tmp_path), StructType().add("age", "integer").add("town", "string"))


def test_csv_round_trip_gate_and_sinks(spark, folk, tmp_path):
    folder = str(tmp_path)
    census = folk.drop("joined_date", "body_weight", "team", "badge_no")
    path = sink.write_versioned(census.toDF(*[c.title().replace("_", " ") for c in census.columns]), folder, "people", fmt="csv")
    back = C.cast_types(scan.read_csv(spark, path))
    assert back.columns == census.columns
    table, warnings = scan.gate(back)
    assert not warnings and table.exceptAll(C.cast_types(census)).count() == 0
    assert sink.write_versioned(census, folder, "people", fmt="csv").endswith("people_cleaned_1")
    with pytest.raises(scan.SchemaRejected):
        scan.gate(folk)
    with pytest.raises(ValueError):
        scan.normalise_header(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))
    assert spark.read.parquet(sink.write_snapshot(census.limit(3), folder, "s")).count() == 3


def test_nine_steps(spark, folk):
    done = nine_step.run(folk)
    assert audit.missing_total(done.cleaned).first()["missing"] == 0
    assert {f.dataType.simpleString() for f in done.encoded.schema.fields} <= {"bigint", "double", "int"}
    assert "education" not in done.encoded.columns and "workclass_Public" in done.encoded.columns
    assert done.encoded.count() == done.statistics["rows_after"] == done.cleaned.count()
    assert done.statistics["duplicates_dropped"] > 0
    issues = {c[0]: c for c in done.comparison}
    assert issues["Missing Values"][2] == 0 and issues["Noise Values"][2] == 0


def test_nine_steps_read_their_source_once(spark, folk):
    """Also with a column that is called like the counts of equal rows would be."""
    reads = spark.sparkContext.accumulator(0)
    source = folk.unionAll(folk.limit(20))

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    done = nine_step.run(source.mapInArrow(counted, source.schema))
    assert reads.value == source.count() == done.statistics["rows_before"]
    named = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "?", "b"), (2, " A", "b")], "_n int, t string, _n_ string")
    cleaned, _, counts = nine_step.clean(named)
    assert cleaned.columns == ["_n", "t", "_n_"] and (counts["rows_before"], counts["rows_after"]) == (4, 3)


def test_rule_order_gives_ordinal_codes(spark, folk):
    ages = [20, 30, 40, 50, 60, 70] * 20
    cleaned = spark.createDataFrame([(a, f"{a}", ">50K" if a > 45 else "<=50K") for a in ages], "age bigint, tag string, income string")
    for by_rule, want in ((True, sorted(set(ages))), (False, [30, 40, 50, 60, 70, 20])):
        plan = T.plan_encoding(T.bin_and_group(cleaned), Rules())
        order = {"age": list(Rules().bin_rule("age")[1])} if by_rule else None
        encoded = T.label_encode(T.bin_and_group(cleaned).select("age", "tag"), ["age"], order)
        codes = {int(r["tag"]): r["age"] for r in encoded.collect()}
        # Without the rule order the code is the rank of the text, in which "26-35" < ">65" < "≤25".
        assert sorted(codes, key=codes.get) == want
        assert {e.column: e.encoding for e in plan}["age"] == T.LABEL


FIELDS = ["age", "workclass", "education", "marital_status", "occupation", "relationship", "sex", "capital_gain", "hours_per_week"]


def test_dashboard_sections(folk):
    tables = dashboard.dashboard(folk)
    assert len(tables) == 33
    total = folk.count()
    assert tables["target_split"].first()["total"] == total
    assert tables["marital_by_sex"].agg(F.sum("n")).first()[0] == total
    with pytest.raises(ValueError):
        dashboard.dashboard(folk.drop("income"))


def test_counted_sections_come_from_one_pass(folk):
    """Their plans read the counted cells only, and equal the operators on rows."""
    f = dashboard.R.resolve_fields(folk.columns)
    b = dashboard.binned_with_raw(folk, f, Rules())
    names = {k: v for k, v in f.items() if v}
    cells = dashboard.count_cells(b, names)
    assert cells.keys() == set(dashboard.COUNTED)
    tables, high, gain = dashboard.dashboard(folk), F.col("_high"), F.col("_capital_gain")
    c = {k: F.col(v) for k, v in names.items()}
    by_rows = {
        "marital_by_sex": E.rate_cells(b, c["marital"], c["sex"], high), "education_of_target": E.composition(b.where(high), c["occupation"], c["education"]),
        "gain_prevalence": E.prevalence_grid(b, c["education"], c["occupation"], high, gain), "target_split": E.target_split(b, high),
        "segments_by_gender_and_occupation": E.segment_composition(b, c["occupation"], high, gain, c["sex"]),
        "gender_by_occupation": E.gender_rates(b, c["occupation"], c["sex"], high), "target_by_gender": E.target_by_gender(b, c["sex"], high),
        "dual_by_gender": E.dual_rate_by_gender(b, c["sex"], high, gain), "dual_by_marital": E.dual_rate_by(b, c["marital"], high, gain),
        "occupation_by_hours": E.hours_cells(b, c["occupation"], c["hours"], high)}
    for name, rows in by_rows.items():
        assert [[pytest.approx(x) if isinstance(x, float) else x for x in r] for r in sorted(map(tuple, rows.collect()))] == \
            [list(r) for r in sorted(map(tuple, tables[name].collect()))], name
    of_rows = {"kpi", "associations", "feature_rates", "breakdown", "gain_by_target", "archetype"}
    folders = {name: {file.split("/part-")[0].rsplit("/", 1)[-1].split("-")[0] for file in t.inputFiles()} for name, t in tables.items()}
    assert all(folders[name] == {"cells"} for name in tables.keys() - of_rows)


@pytest.mark.parametrize("field", FIELDS)
def test_dashboard_without_a_field(folk, field):
    tables = dashboard.dashboard(folk.drop(field))
    assert "target_split" in tables and len(tables) <= 33
    assert all(t.columns for t in tables.values())
    assert tables["kpi"].count() == 1 and tables["archetype"].count() >= 1


def test_dashboard_of_a_target_alone(spark):
    lone = spark.createDataFrame([(">50K", 1), ("<=50K", 2)] * 20, "income string, other int")
    assert set(dashboard.dashboard(lone)) == {"kpi", "target_split", "associations", "feature_rates", "breakdown", "archetype"}
    assert dashboard.dashboard_long(lone).where("section = 'target_split' AND measure = 'pct_high'").first()["value"] == 50.0


def test_rules_without_data(folk):
    from peoplelens.functions.expr import numeric_columns, text_columns
    from peoplelens.rules import resolve_fields

    assert resolve_fields(folk.columns)["hours"] == "hours_per_week"
    assert (len(text_columns(folk)), len(numeric_columns(folk))) == (13, 6)
    found = audit.schema_validation(folk).first()
    assert found["status"] == "fail" and sorted(found["extra_columns"]) == ["badge_no", "body_weight", "joined_date", "team"]


def test_rejected_rows_are_kept_apart(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (None, 3.0), (4, float("nan"))], "k int, x double")
    good, bad = scan.split_rows(df, ["k", "x"])
    assert good.count() == 1 and bad.count() == 3


def test_grouped_density_is_a_density(spark):
    import numpy as np

    from peoplelens.operators.profile import grouped_density

    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.normal(0, 1, 3000)] + [("b", float(v)) for v in rng.normal(4, 0.5, 2000)] + [("flat", 1.0)] * 5 + [("one", 2.0), (None, None)]
    rows = grouped_density(spark.createDataFrame(data, "g string, v double"), "v", "g", points=128).collect()
    assert {r.grp for r in rows} == {"a", "b"}
    for g in "ab":
        own = sorted((r.x, r.density) for r in rows if r.grp == g)
        v = np.array([x for k, x in data if k == g])
        h = v.std(ddof=1) * len(v) ** -0.2
        want = [np.exp(-((x - v) / h) ** 2 / 2).sum() / (len(v) * h * np.sqrt(2 * np.pi)) for x, _ in own]
        assert len(own) == 128 and max(abs(d - w) for (_, d), w in zip(own, want)) < 0.01
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, v double")
    assert grouped_density(flat, "v", "g").isEmpty() and grouped_density(flat.limit(0), "v", "g").isEmpty()


def test_binned_scatter_counts_every_complete_pair(spark):
    from peoplelens.operators.profile import binned_scatter

    data = [(float(i % 17), float(i % 23), "a" if i % 3 else None) for i in range(1000)] + [(None, 1.0, "a"), (1.0, None, "a")]
    df = spark.createDataFrame(data, "x double, y double, hue string")
    rows = binned_scatter(df, "x", "y", "hue", bins=8).collect()
    assert sum(r.n for r in rows) == 1000 and len(rows) <= 8 * 8 * 2 and {r.hue for r in rows} == {"a", "nan"}
    assert all(0 <= r.x_bin < 8 and 0 <= r.y_bin < 8 and abs(r.x - (r.x_bin + 0.5) * 2) < 1e-9 for r in rows)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, y double")
    assert [(r.x_bin, r.y_bin, r.n) for r in binned_scatter(same, "x", "y").collect()] == [(0, 0, 2)] and binned_scatter(same.limit(0), "x", "y").isEmpty()


def test_broken_overwrite_leaves_the_old_snapshot(spark, tmp_path):
    from peoplelens.session import create_file, names_in

    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sink.read_snapshot(spark, folder, "t")
    sink.write_snapshot(spark.range(3), folder, "t")
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sink.write_snapshot(broken, folder, "t")
    assert sink.read_snapshot(spark, folder, "t").count() == 3
    assert create_file(spark, f"{folder}/t/commits/000000000002", "") and sink.read_snapshot(spark, folder, "t").count() == 3
    assert not create_file(spark, f"{folder}/t/commits/000000000002", "other")
    old = sink.read_snapshot(spark, folder, "t")
    sink.write_snapshot(old.union(old), folder, "t")
    assert sink.read_snapshot(spark, folder, "t").count() == 6 and old.count() == 3
    for n in (1, 2):
        sink.write_snapshot(spark.range(n), folder, "t")
    assert sink.read_snapshot(spark, folder, "t").count() == 2
    assert len([n for n in names_in(spark, f"{folder}/t") if n.startswith("data-")]) == 3
