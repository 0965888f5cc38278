"""Schema helpers: the dtype families the analyses distinguish, and small
expression builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in schema order (bool, interval, nested excluded)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    """String and boolean columns (the 'object / category / bool' family)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, DATETIME_TYPES) and f.name not in exclude]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def q(name: str) -> Column:
    """Column reference that tolerates dots and spaces in names."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN and null apart; the analyses have one notion of missing."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.nanvl(q(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(q(f.name))
    return df.select(*cols)


def chunks(items, size):
    """Split a long column list so one aggregate stays inside codegen limits."""
    items = list(items)
    for i in range(0, len(items), size):
        yield items[i:i + size]


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null (a null group is a group); the keys come from the left."""
    keys = list(keys)
    r = right.select(*[q(c).alias(f"__r_{c}") if c in keys else q(c) for c in right.columns
                       if c in keys or how not in ("left_semi", "left_anti")])
    cond = F.lit(True)
    for k in keys:
        cond = cond & q(k).eqNullSafe(q(f"__r_{k}"))
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def maybe_broadcast(df: DataFrame, bytes_per_row: int = 128, limit: int = 32 << 20) -> DataFrame:
    """Broadcast ``df`` only after counting it proves the side small; else a shuffle join."""
    n = df.count()
    return F.broadcast(df) if n * bytes_per_row <= limit else df
