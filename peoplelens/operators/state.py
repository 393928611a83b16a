"""Audit state: the additive parts of a table's audit, kept per batch of rows and merged.

A state is a shared folder. Adding a batch reads that batch alone and writes three small tables of it: ``columns`` (one row per column: rows,
filled cells, moments, extremes, values outside the safe zone, a KLL sketch of the numbers, an HLL sketch of the distinct values), ``values``
(column, value, n of the text columns) and ``rows`` (a signature of 128 bits and the number of rows that have it). Merging is addition: of
counts, of moments about the common mean, of sketches. So the audit of a table that grows costs each new batch once.

A batch counts once its commit file names its data, which is written last; what a broken attempt left is never read. One writer at a time adds
a batch of a given name; different batches may be added side by side.

Defined cases: an empty batch adds no rows; a column absent from a batch is missing in all of that batch's rows; a text column and a numeric
column of one name do not merge and raise. NaN counts as missing. Rows are equal if all columns are, NULL equal to NULL, zeros of both signs
equal. Equal rows must come with the same columns in the same order and types, whatever the batch. Signatures are cut SHA-256 values; rows of one
signature are taken as equal. Safe zones and placeholders are those of ``rules``; zones are counted when a batch is added.
Not in the state, as they need the rows again: outliers and low variance.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peoplelens import rules as R
from peoplelens.functions.expr import col, is_noise, name_sql, number_sql, numeric_columns, present_sql, text_columns, text_sql
from peoplelens.functions.frames import per_column
from peoplelens.functions.quantiles import column_quantiles
from peoplelens.operators.audit import consistency, scored
from peoplelens.operators.frequency import text_frequency
from peoplelens.operators.outliers import outside_sql
from peoplelens.session import compiled_methods, create_file, delete, names_in, staged

#: Size of the KLL sketches. A rank is met up to 0.25 % of the rows in 99 of 100 cases, so brackets reach MARGIN to either side; a rank
#: that lies outside all the same is noticed by counting.
KLL_K = 2_000
MARGIN = 0.006
HLL_K = 12

COLUMNS = ("column string, kind string, position int, rows bigint, filled bigint, mean double, m2 double, m3 double, low double, high double, "
           "outside bigint, numbers binary, distinct_values binary, part string")
VALUES = "column string, value string, n bigint"
ROWS = "signature binary, n bigint"


def _column_parts(df: DataFrame, rules: R.Rules, values: DataFrame | None = None) -> DataFrame:
    """One row per column from one aggregate without a shuffle of rows.

    Text columns are taken from their frequency table, which may be given: the row scan works on the other columns only.
    """
    numbers, texts = set(numeric_columns(df)), set(text_columns(df))
    fields = [f for f in T.StructType.fromDDL(COLUMNS).fields if f.name != "part"]

    def make(c: str) -> dict[str, str]:
        # Nothing is aggregated that is the same for all rows: Spark would update it for every row all the same.
        known = {"kind": text_sql("number" if c in numbers else "text" if c in texts else "other"), "position": f"{df.columns.index(c)}"}
        if c not in texts:
            held = f"CASE WHEN {present_sql(df, c)} THEN CAST({name_sql(c)} AS STRING) END"
            known |= {"filled": f"count_if({present_sql(df, c)})",
                      "distinct_values": f"CASE WHEN count_if({present_sql(df, c)}) > 0 THEN hll_sketch_agg({held}, {HLL_K}) END"}
        if c in numbers:
            x, zone = number_sql(df, c), rules.zone(c)
            known |= {
                "mean": f"avg({x})", "m2": f"var_pop({x}) * count({x})",
                # The third moment, from the skewness; a constant column has none.
                "m3": f"CASE WHEN min({x}) < max({x}) THEN skewness({x}) * count({x}) * pow(var_pop({x}), 1.5D) WHEN count({x}) > 0 THEN 0D END",
                "low": f"min({x})", "high": f"max({x})", "outside": f"count_if({outside_sql(x, zone)})" if zone else "0L",
                "numbers": f"CASE WHEN count({x}) > 0 THEN kll_sketch_agg_double({x}, {KLL_K}) END"}
        else:
            known["outside"] = "0L"
        return {f.name: f"CAST({known.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in fields if f.name not in ("column", "rows")}

    found = per_column(df, df.columns, make, "count(1)").withColumnRenamed("shared", "rows").select(*[f.name for f in fields])
    if not texts:
        return found
    words = (text_frequency(df) if values is None else values).groupBy(F.col("column").alias("text_column")).agg(
        F.sum("n").alias("cells"), F.hll_sketch_agg("value", HLL_K).alias("sketch"))
    text = F.col("kind") == "text"
    return found.join(words, text & (F.col("column") == F.col("text_column")), "left").withColumns({
        "filled": F.when(text, F.coalesce("cells", F.lit(0))).otherwise(F.col("filled")),
        "distinct_values": F.when(text, F.col("sketch")).otherwise(F.col("distinct_values"))}).select(*[f.name for f in fields])


def signature(df: DataFrame) -> Column:
    """128 bits that stand for a whole row. Cells are joined as length and text, so that no two rows have one text."""
    def cell(f: T.StructField) -> Column:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double") + F.lit(0.0)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            c = F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        text = c.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.unhex(F.substring(F.sha2(F.concat(*[cell(f) for f in df.schema.fields]).cast("binary"), 256), 1, 32))


class AuditState:
    def __init__(self, spark: SparkSession, folder: str, rules: R.Rules = R.Rules()) -> None:
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def _commits(self) -> dict[str, str]:
        """Data folder by committed batch."""
        names = names_in(self.spark, f"{self.folder}/commits")
        names = [n for n in names if not n.startswith((".", "_"))]
        if not names:
            return {}
        held = self.spark.read.text([f"{self.folder}/commits/{n}" for n in names], wholetext=True).select("value", F.input_file_name().alias("file"))
        return {r["file"].rsplit("/", 1)[-1]: r["value"] for r in held.collect() if r["value"]}

    def batches(self) -> list[str]:
        return sorted(self._commits())

    def _commit(self, batch: str, data: str) -> None:
        if not create_file(self.spark, f"{self.folder}/commits/{batch}", data):
            raise RuntimeError(f"batch {batch} is being added by another writer")

    def add(self, batch: str, df: DataFrame) -> bool:
        """Add the rows of one batch; False, and nothing done, if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError("a batch name is made of letters, digits, _ and -")
        if batch in self._commits():
            return False
        delete(self.spark, f"{self.folder}/commits/{batch}")  # an empty file of an attempt that broke off
        data = f"data-{uuid.uuid4().hex}"
        self._write(data, {
            "values": text_frequency(df),
            "rows": df.select(signature(df).alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))})
        self._write(data, {"columns": _column_parts(df, self.rules, self._read("values", VALUES, [f"{self.folder}/{data}"]))})
        self._commit(batch, data)
        return True

    def _write(self, data: str, parts: dict[str, DataFrame]) -> None:
        for kind, part in parts.items():
            part = part.withColumn("part", F.lit(data)) if kind == "columns" else part
            with compiled_methods(self.spark):
                part.write.mode("errorifexists").parquet(f"{self.folder}/{data}/{kind}")

    def _held(self) -> list[str]:
        """The committed data folders."""
        return [f"{self.folder}/{data}" for data in sorted(set(self._commits().values()))]

    def _read(self, kind: str, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{f}/{kind}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _added(self, kind: str, schema: str, *keys: str) -> DataFrame:
        """The counts of all data folders by ``keys``. Keys occur once in a folder, so a single one is added up already."""
        held = self._held()
        parts = self._read(kind, schema, held)
        return parts if len(held) == 1 else parts.groupBy(*keys).agg(F.sum("n").alias("n"))

    def values(self) -> DataFrame:
        """(column, value, n) of the text columns."""
        return self._added("values", VALUES, "column", "value")

    def rows(self) -> DataFrame:
        """(signature, n) of the different rows."""
        return self._added("rows", ROWS, "signature")

    def columns(self) -> DataFrame:
        """One merged row per column, in the layout of a batch's. Reads one small row per batch and column."""
        parts = self._read("columns", COLUMNS, self._held())
        n = F.when(F.col("kind") == "number", F.col("filled")).otherwise(0)
        total = parts.groupBy("part").agg(F.max("rows").alias("rows")).agg(F.sum("rows")).scalar()
        means = parts.groupBy("column").agg(F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("centre"), F.count_distinct("kind").alias("kinds"))
        off = F.col("mean") - F.col("centre")
        sketches = F.when(F.sum(n) > 0, F.expr(f"kll_merge_agg_double(numbers, {KLL_K})"))
        merged = parts.join(means, "column").groupBy("column").agg(
            F.when(F.max("kinds") > 1, F.raise_error(F.concat(F.lit("column of several kinds: "), F.first("column")))).otherwise(F.min("kind")).alias("kind"),
            F.min("position").alias("position"), F.sum("filled").alias("filled"), F.max("centre").alias("mean"),
            F.sum(F.col("m2") + n * off * off).alias("m2"), F.sum(F.col("m3") + 3 * off * F.col("m2") + n * off * off * off).alias("m3"),
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("outside").alias("outside"), sketches.alias("numbers"),
            F.when(F.sum("filled") > 0, F.expr("hll_union_agg(distinct_values)")).alias("distinct_values"))
        return merged.select("column", "kind", "position", total.alias("rows"), *merged.columns[3:])

    def profile(self, columns: DataFrame | None = None) -> DataFrame:
        """One row per column: rows, missing, mean, std, adjusted skewness, extremes, and the distinct values as the sketch estimates them.

        The merged ``columns`` may be given.
        """
        n, number = F.col("filled").cast("double"), F.col("kind") == "number"
        skew = F.when(~number | (n < 3), F.lit(None)).when(F.col("low") == F.col("high"), 0.0).otherwise(
            F.sqrt(n) * F.col("m3") / F.pow("m2", F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2))
        return (self.columns() if columns is None else columns).select(
            "column", "kind", "rows", (F.col("rows") - F.col("filled")).alias("missing"), "mean",
            F.when(number & (n > 1), F.sqrt(F.col("m2") / (n - 1))).alias("std"), skew.alias("skewness"), "low", "high",
            F.coalesce(F.hll_sketch_estimate("distinct_values"), F.lit(0)).alias("distinct_estimate"))

    def _totals(self, columns: DataFrame, values: DataFrame, findings: DataFrame) -> DataFrame:
        noise = values.agg(F.coalesce(F.sum(F.when(is_noise(F.col("value"), self.rules.noise_tokens), F.col("n"))), F.lit(0)))
        inconsistent = findings.agg(F.coalesce(F.sum("count"), F.lit(0)))
        duplicates = self.rows().agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
        return columns.agg(
            F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("cols"),
            F.coalesce(F.sum(F.col("rows") - F.col("filled")), F.lit(0)).alias("missing")).select(
            "rows", "cols", "missing", noise.scalar().alias("noise"), inconsistent.scalar().alias("inconsistent"), duplicates.scalar().alias("duplicates"))

    def audit(self) -> DataFrame:
        """The full audit (section, item, value) without the sections that need the rows: totals, consistency, noise, safe zones, missing, skewed."""
        columns, values = staged(self.columns(), "columns"), staged(self.values(), "frequency")
        findings = staged(consistency(values, freq=values), "findings")
        totals = scored(self._totals(columns, values, findings))

        def rows(section: str, frame: DataFrame, item: Column, value: Column) -> DataFrame:
            return frame.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))

        out = totals.select(F.inline(F.array(*[F.struct(
            F.lit("totals").alias("section"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in totals.columns])))
        noisy = values.where(is_noise(F.col("value"), self.rules.noise_tokens)).groupBy("column").agg(F.sum("n").alias("n"))
        found = findings.groupBy("column", "issue").agg(F.sum("count").alias("n"))
        gaps = F.col("rows") - F.col("filled")
        for part in (
                rows("consistency", found, F.concat_ws(": ", "column", "issue"), F.col("n")), rows("noise", noisy, F.col("column"), F.col("n")),
                rows("safe_zone", columns.where("outside > 0"), F.col("column"), F.col("outside")),
                rows("missing", columns.where(gaps > 0), F.col("column"), gaps),
                rows("skewed", self.profile(columns).where(F.abs(F.round("skewness", 3)) > R.SKEW_STRONG), F.col("column"), F.lit(1))):
            out = out.unionByName(part)
        return out

    def quantiles(self, df: DataFrame, probs) -> dict[str, list]:
        """Exact quantiles of the numeric columns of ``df``, the rows of all committed batches.

        The merged sketches bracket the ranks without reading a row; two scans narrow the brackets, check them by counting, and rank what is left.
        """
        wanted = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)})
        edges = F.expr(f"kll_sketch_get_quantile_double(numbers, array({', '.join(f'{w!r}D' for w in wanted)}))")
        held = {r["column"]: r for r in self.columns().where("kind = 'number'").select(
            "column", "filled", "low", "high", F.when(F.col("filled") > 0, edges).alias("edges")).collect()}
        sketches = {}
        for c in numeric_columns(df):
            r = held[c]
            at = dict(zip(wanted, r["edges"] or []))
            sketches[c] = (r["filled"], r["low"], r["high"], [at.get(min(1.0, max(0.0, p + d))) for p in probs for d in (-MARGIN, MARGIN)])
        return column_quantiles(df, {c: number_sql(df, c) for c in sketches}, probs, sketches, certain=False)

    def merged_into(self, folder: str, *others: AuditState) -> AuditState:
        """A new state of this one's and the others' batches, whose parts are added up once; also compacts a state of many batches.

        A batch must be in one of them only. Adding any of these batches to the new state does nothing.
        """
        new = AuditState(self.spark, folder, self.rules)
        if new.batches():
            raise ValueError("the new folder holds a state")
        everything = [self, *others]
        names = [b for s in everything for b in s.batches()]
        if len(names) != len(set(names)):
            raise ValueError("a batch is in several of the states")
        union = _Union(everything)
        data = f"data-{uuid.uuid4().hex}"
        new._write(data, {"columns": union.columns(), "values": union.values(), "rows": union.rows()})
        for name in names:
            new._commit(name, data)
        return new


class _Union(AuditState):
    """Several states read as one."""

    def __init__(self, states: list[AuditState]) -> None:
        super().__init__(states[0].spark, states[0].folder, states[0].rules)
        self.states = states

    def _held(self) -> list[str]:
        return [folder for s in self.states for folder in s._held()]
