"""Helpers that move small, bounded tables between driver and plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peoplelens.functions.expr import col, text_sql


def small_frame(spark: SparkSession, schema: str, rows) -> DataFrame:
    """Report table with one row per column, rule or step."""
    return spark.createDataFrame(list(rows), schema=schema)


def melt(df: DataFrame, columns: dict[str, Column | str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Long form (column, value) of same-typed expressions (SQL text or columns), optional extra columns kept."""
    kept = [c.alias(n) for n, c in (extra or {}).items()]
    if all(isinstance(c, str) for c in columns.values()):
        structs = ", ".join(f"named_struct('column', {text_sql(n)}, 'value', {c})" for n, c in columns.items())
        return df.select(*kept, F.expr(f"inline(array({structs}))"))
    items = F.array(*[F.struct(F.lit(n).alias("column"), c.alias("value")) for n, c in columns.items()])
    return df.select(*kept, F.inline(items))


def per_column(df: DataFrame, columns, make, shared: str = "") -> DataFrame:
    """One aggregate pass over all columns → one row per column.

    ``make(column)`` gives the aggregates of a column as {field: SQL text}; ``shared`` is an aggregate that every
    row repeats under the name ``shared``.
    """
    rows = []
    for c in columns:
        parts = {**({"shared": shared} if shared else {}), **make(c)}
        rows.append(f"named_struct('column', {text_sql(c)}, "
                    + ", ".join(f"'{f}', {e}" for f, e in parts.items()) + ")")
    return df.agg(F.expr(f"array({', '.join(rows)})").alias("rows")).select(F.inline("rows"))


def first_per_column(df: DataFrame, order, k: int, keep: str = "value", by: str = "column") -> DataFrame:
    """The k first values of every column as a list; only k rows per column leave a task."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return ranked.groupBy(by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rank", keep))), lambda s: s[keep]).alias("examples")
    )


def apply_replacements(df: DataFrame, mapping: DataFrame, columns) -> DataFrame:
    """Replace values of the named columns by a (column, value, replacement) table with unique keys.

    One left join per column. Spark broadcasts a side that it knows to be small; beyond that it is a shuffle join, whose hot values
    adaptive execution splits.
    """
    for name in columns:
        side = mapping.where(F.col("column") == name).select(F.col("value").alias("_from"), F.col("replacement").alias("_to"))
        df = df.join(side, col(name) == F.col("_from"), "left").select(*[
            F.coalesce(F.col("_to"), col(c)).alias(c) if c == name else col(c) for c in df.columns])
    return df
