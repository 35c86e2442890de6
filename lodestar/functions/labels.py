"""Label rules: what counts as blank, and class order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that count as no label, after trim and lower.
BLANK = ("", "nan", "none")


def is_blank(c: Column, kind: T.DataType | None = None) -> Column:
    """Null, a blank text, or in a floating column NaN."""
    if isinstance(kind, T.FractionalType):
        return c.isNull() | F.isnan(c)
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*BLANK)


def labeled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(~is_blank(F.col(label), df.schema[label].dataType))


def blank_as_null(df: DataFrame, label: str) -> Column:
    c = F.col(label)
    return F.when(~is_blank(c, df.schema[label].dataType), c)


def number(c: Column, default: float | None = None) -> Column:
    """Text as a number; what is none becomes null or the default."""
    out = c.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))
