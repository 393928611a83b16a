"""Writing tables: versioned files that never overwrite, and a snapshot that does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peoplelens.session import create_file, delete, names_in


def free_path(spark: SparkSession, folder: str, stem: str, suffix: str) -> str:
    """``<stem>_<suffix>``, then ``<stem>_<suffix>_1`` and so on, whichever the folder does not hold yet."""
    taken = names_in(spark, folder)
    name, i = f"{stem}_{suffix}", 0
    while (name if not i else f"{name}_{i}") in taken:
        i += 1
    return f"{folder.rstrip('/')}/{name if not i else f'{name}_{i}'}"


def write_versioned(df: DataFrame, folder: str, stem: str, suffix: str = "cleaned", fmt: str = "parquet") -> str:
    """Write to a path of its own; a concurrent writer of the same path makes this fail, not overwrite."""
    path = free_path(df.sparkSession, folder, stem, suffix)
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        # Quotes are doubled, and outer spaces kept, as other CSV readers and writers do.
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, data folder) of the committed snapshots, latest first; a commit that broke off before it was written counts for nothing."""
    names = sorted((n for n in names_in(spark, f"{path}/commits") if n.isdigit()), reverse=True)
    if not names:
        return []
    held = spark.read.text([f"{path}/commits/{n}" for n in names], wholetext=True).select("value", F.input_file_name().alias("file")).collect()
    return sorted(((int(r["file"].rsplit("/", 1)[-1]), r["value"]) for r in held if r["value"]), reverse=True)


def write_snapshot(df: DataFrame, folder: str, name: str, keep: int = 2) -> str:
    """Replace the latest snapshot of a table; returns the folder of its data.

    The data goes to a folder of its own and is named last, in a commit file that only one writer can create. Until then readers see the snapshot
    before it, whatever happens to this one. Of two writers the later to commit is the latest. The last ``keep`` snapshots stay, so that a
    running reader keeps its files; what was never committed is left alone, as it may be another writer's.
    """
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{name}"
    data = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{data}")
    taken = [int(n) for n in names_in(spark, f"{path}/commits") if n.isdigit()]
    number = max(taken, default=0) + 1
    while not create_file(spark, f"{path}/commits/{number:012}", data):
        number += 1
    for old, unused in _commits(spark, path)[keep:]:
        delete(spark, f"{path}/commits/{old:012}")
        delete(spark, f"{path}/{unused}")
    return f"{path}/{data}"


def snapshot_path(spark: SparkSession, folder: str, name: str) -> str:
    """Folder of the latest committed snapshot; raises where there is none."""
    path = f"{folder.rstrip('/')}/{name}"
    found = _commits(spark, path)
    if not found:
        raise FileNotFoundError(f"no snapshot of {name} in {folder}")
    return f"{path}/{found[0][1]}"


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The latest committed snapshot."""
    return spark.read.parquet(snapshot_path(spark, folder, name))
