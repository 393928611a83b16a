"""Column expressions: text, parsing, predicates, guarded arithmetic."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peoplelens import rules as R

# Every Unicode whitespace character.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def name_sql(name: str) -> str:
    """Column by exact name, in SQL text. Wide aggregates are built as text: one parse instead of many calls."""
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_sql(value: float) -> str:
    """Double literal with all digits."""
    value = float(value)
    return f"{value!r}D" if isfinite(value) else f"double('{value}')"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def integral_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}


def strip(c: Column) -> Column:
    """Without outer Unicode whitespace. Text that begins and ends with printable ASCII skips the search."""
    first, last = F.ascii(c), F.ascii(F.substring(c, -1, 1))
    return F.when(first.between(33, 126) & last.between(33, 126), c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def present_sql(df: DataFrame, name: str) -> str:
    """Not null, and for floating types not NaN either, in SQL text."""
    c = name_sql(name)
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return f"({c} IS NOT NULL AND NOT isnan({c}))" if floating else f"({c} IS NOT NULL)"


def present(c: Column, kind=None) -> Column:
    """Not null, and for floating types not NaN either."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def number_sql(df: DataFrame, name: str) -> str:
    """A numeric column as double with NaN mapped to NULL, in SQL text."""
    c = name_sql(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"CAST(CASE WHEN NOT isnan({c}) THEN {c} END AS DOUBLE)"
    return f"CAST({c} AS DOUBLE)"


def number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def parse_number(c: Column) -> Column:
    """Text to double, NULL when it is not a plain number."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """Number from a column of either class."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_number(col(name))
    return number(df, name)


def is_noise(c: Column, tokens=R.NOISE_TOKENS) -> Column:
    """Placeholder token, blank text, or a lone character that is no letter or digit."""
    return F.lower(strip(c)).isin("", *tokens) | ((F.length(c) == 1) & ~c.rlike(r"^[\p{L}\p{N}]$"))


def is_target(c: Column, token: str = R.TARGET_TOKEN) -> Column:
    """Binary target from its text; NULL counts as False."""
    return F.coalesce(F.lower(c.cast("string")).contains(token), F.lit(False))


def label(c: Column) -> Column:
    """Group label in which NULL becomes the text ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def gender(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def first_int(c: Column) -> Column:
    """First run of digits in a label, else NULL."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def outside(c: Column, zone) -> Column:
    """True where a value lies outside the inclusive range; a missing bound is no test.

    Without a range every value counts as outside, so nothing is protected.
    """
    if zone is None:
        return F.lit(True)
    low, high = zone
    test = F.lit(False)
    if low is not None:
        test = test | (c < F.lit(low))
    if high is not None:
        test = test | (c > F.lit(high))
    return test


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole · scale as double, NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale)


def pearson_sql(x: str, y: str) -> str:
    """Pairwise-complete correlation aggregate in SQL text; NULL when either side is constant.

    ``corr`` itself would raise on a constant side.
    """
    left, right = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({left}) * stddev_pop({right}))"


def pearson(x: Column, y: Column) -> Column:
    """The same for column expressions."""
    left, right = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(left) * F.stddev_pop(right))


def is_date(c: Column, formats=DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).isNotNull()


def cut(c: Column, edges, labels) -> Column:
    """Right-closed bins with the lowest edge included; outside the edges NULL."""
    branch = F.when((c >= F.lit(edges[0])) & (c <= F.lit(edges[1])), F.lit(labels[0]))
    for low, high, name in zip(edges[1:], edges[2:], labels[1:]):
        branch = branch.when((c > F.lit(low)) & (c <= F.lit(high)), F.lit(name))
    return branch


def replace_by(c: Column, mapping: dict) -> Column:
    """Lookup in a small literal map; unmapped values fall through."""
    if not mapping:
        return c
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(entries[c], c)


def ranked_first(value: Column, count: Column) -> Column:
    """Aggregate: the most frequent value, ties to the smallest value."""
    return F.min(F.struct((-count).alias("rank"), value.alias("value")))["value"]
