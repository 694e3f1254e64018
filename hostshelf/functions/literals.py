"""Typed literals for filter values.

Values arrive as text (or Python values) and take the column's type. The cast
is applied to the *literal*, never to the column, so Catalyst folds it to a
constant and the comparison reaches the Parquet reader as a pushed filter.
ANSI casts raise on bad text (`12.5` for an int column, an empty string),
as the store would.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed_literal(value: Any, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType) and isinstance(value, str):
        # A zone suffix (`Z`, `+03:00`) is ignored for a timestamp without zone.
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(value).cast(dtype)


def parse_count(name: str, value: Any) -> int:
    """Integer argument of a paging filter (text or number)."""
    if isinstance(value, bool):
        raise ValueError(f"{name}: not an integer: {value!r}")
    if isinstance(value, int):
        return value
    try:
        return int(str(value).strip())
    except ValueError:
        raise ValueError(f"{name}: not an integer: {value!r}") from None


_WILDCARDS = "%_\\"


def like_pattern(pattern: str) -> str:
    """Normalize a LIKE pattern to Spark's escape rules.

    With backslash as the escape character, a backslash before any character
    means that character literally. Spark accepts an escape only before `%`,
    `_` or a backslash, so a backslash before an ordinary character is dropped
    (same meaning). A trailing lone backslash stays, and raises, as it should.
    """
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append(ch + nxt if nxt in _WILDCARDS else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)
