"""Output rendering: RFC 3339 timestamps and JSON rows with fixed field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import Kind, kind_of


def rfc3339(ts: Column) -> Column:
    """`2026-07-17T12:00:00.12Z`: UTC wall time, trailing fraction zeros dropped."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def render_timestamps(df: DataFrame) -> DataFrame:
    """Every timestamp column as RFC 3339 text; other columns unchanged."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            cols.append(rfc3339(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def plain_number(value: Column) -> Column:
    """A double in plain digits for magnitudes from 1e-6 to 1e21; others keep an exponent."""
    text, size = value.cast("string"), F.abs(value)
    exact = F.when(size < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
        text.try_cast("decimal(38,16)").cast("string"))
    digits = F.regexp_replace(exact, "0+$", "")
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(text.contains("E") & (size >= 1e-6) & (size < 1e21), digits).otherwise(text)


def json_rows(df: DataFrame, kind: str | Kind, out_col: str = "json") -> DataFrame:
    """One JSON object per row with the table's field names in order, doubles in plain digits.

    `id` is kept beside the text so callers can keep the newest-first order.
    """
    k = kind_of(kind)
    rendered = render_timestamps(df.select(*k.columns))

    def member(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DoubleType):
            return F.concat(F.lit(f'"{f.name}":'), plain_number(F.col(f.name)))
        one = F.to_json(F.struct(f.name))  # {"name":value}
        return F.substring(one, F.lit(2), F.length(one) - 2)

    text = F.concat(F.lit("{"), F.concat_ws(",", *[member(f) for f in k.schema]), F.lit("}"))
    return rendered.select("id", text.alias(out_col))
