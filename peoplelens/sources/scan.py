"""Reading tables: header normalisation, null tokens, schema gate, preview, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peoplelens import rules as R
from peoplelens.functions.expr import col, present, text_columns
from peoplelens.operators.audit import schema_findings


class SchemaRejected(ValueError):
    """Columns are missing or not expected."""


def normalise_header(df: DataFrame) -> DataFrame:
    """Column names stripped, lower-cased, spaces as underscores; a clash raises."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns become the same name: {', '.join(twice)}")
    return df.toDF(*names)


def null_tokens(df: DataFrame, tokens=R.CSV_NULL_TOKENS) -> DataFrame:
    """Empty-value tokens of a text file to NULL, all text columns in one projection."""
    texts = set(text_columns(df))
    return df.select(*[
        F.when(~col(c).isin(*tokens), col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header. Without a schema all columns are text, for the type step to cast.

    ``multiline`` accepts line breaks inside quotes, but a file is then read by one task.
    """
    reader = spark.read.options(header=True, escape='"', multiLine=multiline)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return null_tokens(normalise_header(df))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise_header(spark.read.parquet(path))


def gate(df: DataFrame, rules: R.Rules = R.Rules()) -> tuple[DataFrame, list]:
    """The table and its type warnings; raises when columns are missing or extra. Reads no data."""
    found = schema_findings(df, rules)
    if found["missing"] or found["extra"]:
        raise SchemaRejected(f"missing: {found['missing']}; not expected: {found['extra']}")
    return df, found["mismatches"]


def split_rows(df: DataFrame, required) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with a value in all required columns, and the others."""
    filled = F.lit(True)
    for c in required:
        filled = filled & present(col(c), df.schema[c].dataType)
    return df.where(filled), df.where(~filled)


#: Columns that a quarantine adds; a table that has them is refused.
RECORD, REASONS = "_record", "_reasons"


def quarantine(spark: SparkSession, path: str, schema: T.StructType, required=(), multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of CSV files with a header: the typed rows, and the others as ``_record`` text with ``_reasons``.

    Reasons are ``fields`` (a record with too many or too few fields, of which nothing else is said), ``missing:<column>`` for a required column that is empty or
    an empty-value token, and ``unparsable:<column>`` for a value that is not of its type; a record can have several. A header that lacks columns
    or has others raises ``SchemaRejected``; their order is free, but the same in all files. Every record is in exactly one of the two tables, and both are lazy projections of one scan.
    """
    options = dict(header=True, escape='"', multiLine=multiline)
    names = normalise_header(spark.read.options(**options).csv(path)).columns
    kinds = {f.name: f.dataType for f in schema.fields}
    missing, extra = sorted(set(kinds) - set(names)), sorted(set(names) - set(kinds))
    if missing or extra or {RECORD, REASONS} & set(names):
        raise SchemaRejected(f"missing: {missing}; not expected: {extra}")
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    # Without column pruning a record is always cut into all of its fields, so that their number is known.
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, columnPruning=False).schema(texts).csv(path)
    cut = raw.select(*[F.when(~col(c).isin(*R.CSV_NULL_TOKENS), col(c)).alias(c) for c in names], RECORD,
                     F.to_csv(F.struct(*[col(c) for c in names])).alias("_line"))
    typed = {c: col(c) if isinstance(kinds[c], T.StringType) else col(c).try_cast(kinds[c]) for c in names}
    broken = [F.when(col(c).isNull(), F.lit(f"missing:{c}")) for c in names if c in required]
    broken += [F.when(col(c).isNotNull() & typed[c].isNull(), F.lit(f"unparsable:{c}")) for c in names if not isinstance(kinds[c], T.StringType)]
    reasons = F.when(F.col(RECORD).isNotNull(), F.array(F.lit("fields"))).otherwise(
        F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    judged = cut.withColumn(REASONS, reasons)
    accepted = judged.where(F.size(REASONS) == 0).select(*[typed[f.name].alias(f.name) for f in schema.fields])
    rejected = judged.where(F.size(REASONS) > 0).select(F.coalesce(RECORD, "_line").alias(RECORD), REASONS)
    return accepted, rejected


def preview(df: DataFrame, order, rows: int = 10) -> DataFrame:
    """First rows in an explicit order."""
    return df.orderBy(*order).limit(rows)


def search(df: DataFrame, column: str, pattern: str, newest: str, page: int = 1, size: int = 5, tie: str | None = None) -> DataFrame:
    """Rows whose name matches a pattern in any case, newest first, one page of them."""
    hits = df.where(col(column).rlike("(?i)" + pattern)) if pattern else df
    return hits.orderBy(F.desc(newest), F.asc(tie or column)).offset((page - 1) * size).limit(size)
