"""Exact quantiles (linear interpolation) at any number of rows, distinct values and groups.

Columns: Spark's percentile sketch brackets every wanted rank (its rank error is known), a second sketch of the values inside each bracket
narrows it by another factor of fifty, and the few values left are ranked: three scans (``column_quantiles``). What is ranked is about one in
25 000 rows.

Groups: distinct values are range-partitioned with their counts, partitions are counted, and a value's rank is its place in its partition plus
the partitions before it. No task ever holds all values of a key (``grouped_quantiles``).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peoplelens.functions.expr import double_sql
from peoplelens.functions.frames import per_column
from peoplelens.session import staged

#: Accuracy of the sketch: a rank is met up to 1 / ACCURACY of the rows.
ACCURACY = 2_000
#: Steps of the second sketch, each some errors of the sketch wide.
GRID = 200


def _ranked(freq: DataFrame) -> DataFrame:
    """(key, value, first, last, total) of a (key, value, n) table: ranks from 0 of the rows with that value."""
    placed = staged(freq.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()), "ranks")
    totals = placed.groupBy("key", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(
        "key", "part", (F.sum("rows").over(before) - F.col("rows")).alias("offset"),
        F.sum("rows").over(Window.partitionBy("key")).alias("total"))
    inside = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["key", "part"]).select(
        "key", "value", "total", (F.col("offset") + F.col("upto") - F.col("n")).alias("first"),
        (F.col("offset") + F.col("upto") - 1).alias("last"))


def grouped_quantiles(long: DataFrame, probs) -> DataFrame:
    """Quantiles per key of a (key, value) table → (key, quantiles array). Keys whose values are all NULL are absent."""
    freq = long.where(F.col("value").isNotNull()).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    picks = []
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        picks.append(F.max(F.when(low.between(F.col("first"), F.col("last")), F.col("value"))).alias(f"a{i}"))
        picks.append(F.max(F.when(high.between(F.col("first"), F.col("last")), F.col("value"))).alias(f"b{i}"))
        picks.append(F.max(position - low).alias(f"w{i}"))
    mix = [F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(
        F.col(f"a{i}") * (1 - F.col(f"w{i}")) + F.col(f"b{i}") * F.col(f"w{i}")) for i in range(len(probs))]
    return _ranked(freq).groupBy("key").agg(*picks).select("key", F.array(*mix).alias("quantiles"))


def sketch_sql(x: str, probs) -> str:
    """Aggregate: for each probability a value certainly not above and one certainly not below its ranks.

    Two errors to either side: the sketch may miss by one, and from 2 * ACCURACY rows on the other is at least the two ranks by which
    interpolation may reach further.
    """
    margin = 2 / ACCURACY
    wanted = [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]
    return f"percentile_approx({x}, array({', '.join(f'{w!r}D' for w in wanted)}), {ACCURACY})"


@dataclass
class _Bracket:
    """A range of one column's values that holds some of the wanted ranks."""

    column: str
    low: float
    high: float
    ranks: list


def _brackets(column: str, n: int, ranks, edges, low: float, high: float) -> list[_Bracket]:
    """Brackets that do not overlap, from the two edges of each rank. Ranks near the ends reach to the extremes, which the sketch may miss, and
    so do all ranks of fewer rows than a sketch can tell apart."""
    found: list[_Bracket] = []
    slack = n if n < 2 * ACCURACY else 2 + 2 * n // ACCURACY
    for near, (a, b) in zip(ranks, edges):
        a = low if min(near) <= slack else a
        b = high if max(near) >= n - 1 - slack else b
        if found and a <= found[-1].high:
            last = found[-1]
            last.low, last.high, last.ranks = min(a, last.low), max(b, last.high), sorted({*last.ranks, *near})
        else:
            found.append(_Bracket(column, a, b, sorted(near)))
    return found


def column_quantiles(df: DataFrame, columns: dict[str, str], probs, sketches: dict[str, tuple] | None = None,
                     certain: bool = True) -> dict[str, list]:
    """Quantiles of several double expressions (SQL text) in three scans, all columns in each.

    ``sketches`` gives (rows, lowest, highest, sketch) per column where a pass of the caller has taken them along. If they only probably hold the
    ranks (not ``certain``), every bracket is counted, and a column with a rank outside of them is sketched anew.
    """
    if not columns:
        return {}
    if sketches is None:
        sketches = {r["column"]: (r["n"], r["low"], r["high"], r["sketch"]) for r in per_column(df, list(columns), lambda c: {
            "n": f"count({columns[c]})", "low": f"min({columns[c]})", "high": f"max({columns[c]})",
            "sketch": sketch_sql(columns[c], probs)}).collect()}
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    open_: list[_Bracket] = []
    for c in columns:
        n, low, high, edges = sketches[c]
        if n:
            ranks = [{floor((n - 1) * probs[i]), ceil((n - 1) * probs[i])} for i in order]
            open_ += _brackets(c, n, ranks, [(edges[2 * i], edges[2 * i + 1]) for i in order], low, high)
    lost: set[str] = set()
    if certain:
        open_ = _settled(open_, found)
    if open_:
        smaller, lost = _narrowed(df, columns, open_)
        open_ = _settled(smaller, found)
    if open_:
        _rank_inside(df, columns, open_, found)
    anew = column_quantiles(df, {c: columns[c] for c in lost}, probs)
    return anew | {c: [None] * len(probs) if not sketches[c][0] else [_between(found[c], (sketches[c][0] - 1) * p) for p in probs]
                   for c in columns if c not in lost}


def _settled(open_: list[_Bracket], found: dict) -> list[_Bracket]:
    """Brackets of a single value answer their ranks; the others are left."""
    for b in open_:
        if b.low == b.high:
            found[b.column].update(dict.fromkeys(b.ranks, b.low))
    return [b for b in open_ if b.low != b.high]


def _narrowed(df: DataFrame, columns: dict[str, str], open_: list[_Bracket]) -> tuple[list[_Bracket], set[str]]:
    """The same ranks in smaller brackets: a grid of quantiles of the values inside each, and the number of values below it.

    Columns with a rank outside its bracket are left out and named.
    """
    grid = [i / GRID for i in range(GRID + 1)]
    cells = []
    for b in open_:
        x, low, high = columns[b.column], double_sql(b.low), double_sql(b.high)
        inside = f"CASE WHEN {x} BETWEEN {low} AND {high} THEN {x} END"
        cells.append(f"struct(count_if({x} < {low}) AS below, count({inside}) AS n, min({inside}) AS low, max({inside}) AS high, "
                     f"percentile_approx({inside}, array({', '.join(f'{g!r}D' for g in grid)}), {ACCURACY}) AS grid)")
    out = []
    counted = list(zip(open_, df.agg(F.expr(f"array({', '.join(cells)})").alias("x")).first()["x"]))
    lost = {b.column for b, r in counted if any(not r["below"] <= rank < r["below"] + r["n"] for rank in b.ranks)}
    for b, r in counted:
        if b.column in lost:
            continue
        ranks, edges = [], []
        for rank in b.ranks:
            at = (rank - r["below"]) / r["n"]
            ranks.append({rank - r["below"]})
            edges.append((r["grid"][max(0, floor(at * GRID) - 1)], r["grid"][min(GRID, ceil(at * GRID) + 1)]))
        for smaller in _brackets(b.column, r["n"], ranks, edges, r["low"], r["high"]):
            smaller.ranks = [rank + r["below"] for rank in smaller.ranks]
            out.append(smaller)
    return out, lost


def _rank_inside(df: DataFrame, columns: dict[str, str], open_: list[_Bracket], found: dict) -> None:
    """Rank the values inside the brackets.

    Values below a column's first bracket or between two of them are counted without being told apart: they carry the number of the next bracket
    and no value. So the running count over a column's few cells is the rank among all its values.
    """
    names = list(dict.fromkeys(b.column for b in open_))
    parts = []
    for k, c in enumerate(names):  # one cell per column, as its brackets do not overlap
        own = sorted((b for b in open_ if b.column == c), key=lambda b: b.low)
        keys = " ".join(f"WHEN {columns[c]} <= {double_sql(b.high)} THEN {i}" for i, b in enumerate(own))
        values = " ".join(f"WHEN {columns[c]} < {double_sql(b.low)} THEN NULL WHEN {columns[c]} <= {double_sql(b.high)} THEN {columns[c]}" for b in own)
        parts.append(f"named_struct('col', {k}, 'key', CASE {keys} END, 'value', CASE {values} END)")
    members = df.select(F.expr(f"inline(array({', '.join(parts)}))")).where("key IS NOT NULL")
    upto = Window.partitionBy("col").orderBy("key", F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    placed = members.groupBy("col", "key", "value").agg(F.count(F.lit(1)).alias("n")).select("col", "value", "n", F.sum("n").over(upto).alias("upto"))
    wanted = {c: sorted({r for b in open_ if b.column == c for r in b.ranks}) for c in names}
    hits = " OR ".join(f"(col = {k} AND {r} >= upto - n AND {r} < upto)" for k, c in enumerate(names) for r in wanted[c])
    for row in placed.where(f"value IS NOT NULL AND ({hits})").collect():
        c = names[row["col"]]
        found[c].update({r: row["value"] for r in wanted[c] if row["upto"] - row["n"] <= r < row["upto"]})


def _between(values: dict[int, float], position: float) -> float:
    low, high = values[floor(position)], values[ceil(position)]
    return low if low == high else low + (high - low) * (position - floor(position))
