"""Keep-newest-N retention (RT-1…6).

Parquet has no row delete, so retention returns the surviving rows as a new
DataFrame; :mod:`hostshelf.sinks.store` writes it as a new table version.
The rank cutoff is one literal, so old rows are dropped by a pushed filter
(and whole bucket folders are skipped), never by ranking every row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_MAX_GROUPS, DEFAULT_MAX_SESSION_KEYS
from .ranking import kth_largest


def as_timestamp(as_of) -> Column:
    """A clock value as a timestamp without zone (a Column passes through)."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of.replace(tzinfo=None)).cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def keep_newest_groups(table: DataFrame, keep: int, *, group_col: str = "group_id") -> DataFrame:
    """Rows of the `keep` newest groups (a group leaves with all its rows)."""
    if keep <= 0:
        return table.where(F.lit(False))
    cut = kth_largest(table, group_col, keep)
    if cut is None:
        return table
    return table.where(F.col(group_col) >= F.lit(cut).cast(table.schema[group_col].dataType))


def prune_before_insert(table: DataFrame, max_groups: int = DEFAULT_MAX_GROUPS, **kw) -> DataFrame:
    """RT-1…4: before a new group goes in, keep the newest ``max_groups - 1``."""
    return keep_newest_groups(table, max_groups - 1, **kw)


def append_and_retain(old: DataFrame, new: DataFrame, max_groups: int = DEFAULT_MAX_GROUPS,
                      **kw) -> DataFrame:
    """RT-5: prune then insert, so at most `max_groups` groups remain.

    A run that found no rows (an empty `new`) still prunes.
    """
    return prune_before_insert(old, max_groups, **kw).unionByName(new.select(*old.columns))


def retain_session_keys(keys: DataFrame, as_of, max_keys: int = DEFAULT_MAX_SESSION_KEYS) -> DataFrame:
    """RT-6: drop expired keys (valid_until < as_of) and keys beyond the newest
    ``max_keys - 1`` by id; the rank counts expired keys too."""
    keep = max_keys - 1
    if keep <= 0:
        return keys.where(F.lit(False))
    alive = F.col("valid_until") >= as_timestamp(as_of)
    cut = kth_largest(keys, "id", keep, distinct=False)
    if cut is None:
        return keys.where(alive)
    return keys.where(alive & (F.col("id") >= F.lit(cut).cast(keys.schema["id"].dataType)))
