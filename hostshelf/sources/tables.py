"""Scans of stored tables (SRC-1…5): explicit schema, fixed column order, visible rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.clock import current_time
from ..schemas import Kind, kind_of

__all__ = ["current_time", "project", "read_session_keys", "read_table"]


def project(df: DataFrame, kind: str | Kind) -> DataFrame:
    """The table's row in its fixed column order (PRJ-1…4); an unknown kind raises (PRJ-7)."""
    return df.select(*kind_of(kind).columns)


def read_table(spark: SparkSession, kind: str | Kind, root: str) -> DataFrame:
    """Scan a stored metric table through its log, so that pruned and uncommitted rows stay out."""
    from ..sinks.store import SnapshotTable  # local import: sinks build on sources

    return SnapshotTable(spark, root, kind).read()


def read_session_keys(spark: SparkSession, root: str) -> DataFrame:
    from ..sinks.store import KeyTable

    return KeyTable(spark, root).read()
