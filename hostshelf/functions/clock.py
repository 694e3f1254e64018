"""The store clock (SRC-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def current_time() -> Column:
    """Now, as a timestamp without zone (the session zone is UTC)."""
    return F.current_timestamp().cast("timestamp_ntz")
