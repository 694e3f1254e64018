"""Session-key table (SK-1…4), in bulk: many presented keys at once.

Membership tests are semi/anti joins on `session_key`. The planner chooses
the strategy from sizes; with AQE on, a side measured small at run time is
broadcast, a large one is shuffled on the key (no unchecked broadcast hint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_KEY_LIFETIME_MINUTES, DEFAULT_MAX_SESSION_KEYS
from .retention import as_timestamp, retain_session_keys


def keys_unseen(candidates: DataFrame, keys: DataFrame, key_col: str = "session_key") -> DataFrame:
    """SK-1: candidates with no row of the same key in the table, expired or not."""
    return candidates.join(keys.select(F.col("session_key").alias(key_col)), key_col, "left_anti")


def keys_valid(presented: DataFrame, keys: DataFrame, as_of, key_col: str = "session_key") -> DataFrame:
    """SK-2: presented keys that exist with ``valid_until > as_of`` (strict)."""
    live = keys.where(F.col("valid_until") > as_timestamp(as_of)).select(
        F.col("session_key").alias(key_col))
    return presented.join(live, key_col, "left_semi")


def key_expiry(created, minutes: int = DEFAULT_KEY_LIFETIME_MINUTES) -> Column:
    """SK-3: expiry = creation time + lifetime minutes."""
    base = created if isinstance(created, Column) else as_timestamp(created)
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def new_key_rows(new_keys: DataFrame, as_of, lifetime_minutes: int = DEFAULT_KEY_LIFETIME_MINUTES) -> DataFrame:
    """SNK-5: rows of new keys (`id`, `session_key`) created at `as_of`."""
    now = as_timestamp(as_of)
    return new_keys.select(F.col("id").cast("int").alias("id"), F.col("session_key"), now.alias("creation_datetime"),
                           key_expiry(now, lifetime_minutes).alias("valid_until"))


def session_key_save(keys: DataFrame, new_keys: DataFrame, as_of,
                     max_keys: int = DEFAULT_MAX_SESSION_KEYS,
                     lifetime_minutes: int = DEFAULT_KEY_LIFETIME_MINUTES) -> DataFrame:
    """SK-4: retain (RT-6), then insert the new keys created at `as_of`.

    `new_keys` carries `id` and `session_key` (ids from :mod:`.ids`). The stored
    form, with its own id mark, is :class:`hostshelf.sinks.store.KeyTable`.
    """
    return retain_session_keys(keys, as_of, max_keys).unionByName(new_key_rows(new_keys, as_of, lifetime_minutes))
