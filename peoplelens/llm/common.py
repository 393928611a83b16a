"""Pieces the operators share: tables, intermediate tables, the split of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peoplelens.session import delete, names_in, new_folder, staged

__all__ = ["delete", "names_in", "new_folder", "remainder", "row_key", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by these columns; never NULL."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))
