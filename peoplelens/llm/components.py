"""Connected components of a graph in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import delete, new_folder


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least of its closed neighbourhood.

    Large star moves the greater neighbours, small star the node and its smaller neighbours. The least neighbour comes
    from a summed aggregate and is joined back; a node's neighbours are never gathered in one place.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if large:
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.filter("a <> m").select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node with an edge, and the least node it can reach. ``edges`` has longs ``a`` and ``b``.

    Each round is written in the shared folder and the one before it deleted. The rounds end when neither the number of edges nor
    the sum of their ends changes: then every edge is a node and its component.
    """
    spark = edges.sparkSession
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    folder, seen = None, None
    while True:
        fresh = new_folder(spark, "edges")
        current.write.parquet(fresh)
        if folder:
            delete(spark, folder)
        folder = fresh
        written = spark.read.parquet(folder)
        now = written.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")),
                          F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        current = _star(_star(written, large=True), large=False)
    return written.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        written.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
