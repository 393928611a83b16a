"""Site-relative line deduplication: lines that a large share of a host's pages hold are boilerplate.

Only DataFrame functions. A line is compared after trimming spaces; blank lines are neither counted nor dropped.
A host's boilerplate is the set of lines with ``pages holding it > ratio * pages of the host`` on at least ``min_pages``
pages. The set is small for any host: a ratio r leaves at most (mean distinct lines of a page) / r lines.

Defined cases: a NULL host counts as the host ''. A NULL text has no lines and stays NULL; an empty text stays empty. Repeated
rows are pages of their own. A page made of boilerplate lines only is left whole: nothing of its own would remain, and
copies of whole pages are the work of near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

RATIO = 0.1
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits, so that different lines do not meet even among 10^12 of them."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, pages, host_pages) of each boilerplate line. Counts are summed on each task before the shuffle."""
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    distinct = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""))
    per_line = (pages.select("host", F.explode(distinct).alias("line"))
                .groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("pages"))
                .filter(F.col("pages") >= min_pages))
    per_host = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return per_line.join(per_host, "host").filter(F.col("pages") > F.col("host_pages") * F.lit(ratio))


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
               min_pages: int = MIN_PAGES) -> DataFrame:
    """(row, text, lines_total, lines_dropped): ``row`` holds all given columns, ``text`` the kept lines.

    The boilerplate is written first, so that its measured size decides whether the join broadcasts it or shuffles.
    """
    found = staged(boilerplate(docs, text, host, ratio, min_pages)
                   .groupBy("host").agg(F.collect_list("key").alias("keys")), "boilerplate")
    pages = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(host), F.lit("")).alias("host"),
                        F.col(text).alias("whole"))
    joined = pages.join(found, "host", "left").withColumn(
        "kept", F.when(F.col("keys").isNotNull(), F.filter(
            _lines(F.col("whole")), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("keys"), _key(F.trim(x))))))
    total = F.coalesce(F.size(F.filter(_lines(F.col("whole")), lambda x: F.trim(x) != "")), F.lit(0))
    dropped = F.coalesce(F.size(_lines(F.col("whole"))) - F.size("kept"), F.lit(0))
    some = (F.col("dropped") > 0) & F.exists("kept", lambda x: F.trim(x) != "")
    return (joined.withColumns({"total": F.when(F.col("whole").isNull(), 0).otherwise(total),
                                "dropped": F.when(F.col("whole").isNull(), 0).otherwise(dropped)})
            .select("row", F.when(some, F.array_join("kept", "\n")).otherwise(F.col("whole")).alias("text"),
                    F.col("total").cast("int").alias("lines_total"),
                    F.when(some, F.col("dropped")).otherwise(0).cast("int").alias("lines_dropped")))
