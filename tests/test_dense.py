"""Cross-tabs with all pairs of labels."""

from __future__ import annotations

from peoplelens.operators import exploration as E


def grid(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_absent_cells_are_zero(spark):
    cells = spark.createDataFrame([("a", "x", 3, 0.5), ("b", "y", 1, 1.0), ("nan", "x", 2, 0.0)], "row string, col string, n bigint, rate double")
    done = E.dense(cells)
    assert done.schema["n"].dataType == cells.schema["n"].dataType
    assert grid(done) == [("a", "x", 3, 0.5), ("a", "y", 0, 0.0), ("b", "x", 0, 0.0), ("b", "y", 1, 1.0), ("nan", "x", 2, 0.0), ("nan", "y", 0, 0.0)]
    assert E.dense(cells.limit(0)).collect() == []


def test_a_grid_for_each_class_null_included(spark):
    cells = spark.createDataFrame([(True, "a", "x", 1.0), (True, "b", "y", 2.0), (None, "a", "x", 3.0), (None, "a", "z", 4.0)],
                                  "high boolean, row string, col string, pct double")
    assert grid(E.dense(cells, ("high",))) == [(None, "a", "x", 3.0), (None, "a", "z", 4.0), (True, "a", "x", 1.0), (True, "a", "y", 0.0), (True, "b", "x", 0.0), (True, "b", "y", 2.0)]
