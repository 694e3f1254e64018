"""Rows of an append (SNK-1…5, SNK-13): snapshot figures → table rows.

A collection run becomes table rows by drawing group ids after the table's
group mark (one group per run, or one per distinct sample key in a bulk
backfill), numbering rows after the id mark in insert order, and stamping
the insert time. Both ids come from one staging (see :mod:`.ids`). The physical
write is :meth:`SnapshotTable.append_run`; this is the DataFrame part, usable
on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import current_time
from ..schemas import Kind, kind_of
from . import ids


def insert_time(value=None) -> Column:
    """Insert time without zone: a fixed value, or the store clock."""
    if value is None:
        return current_time()
    return F.lit(value).cast("timestamp_ntz") if not isinstance(value, Column) else value.cast("timestamp_ntz")


def from_numbered(n: ids.Numbered, kind: str | Kind, *, group_mark: int, id_mark: int, keyed: bool, inserted_at=None) -> DataFrame:
    """Table rows of numbered rows, with ids after the marks; rows without a sample key are one new group."""
    group = F.col("key_no") if keyed else F.lit(0).cast("long")
    out = (n.rows.withColumn("group_id", ids.checked_int(group + F.lit(group_mark + 1).cast("long")))
           .withColumn("id", ids.checked_int(F.col("row_no") + F.lit(id_mark + 1).cast("long")))
           .withColumn("insertion_datetime", insert_time(inserted_at)))
    return out.select(*kind_of(kind).columns)


def drawn(rows: DataFrame, kind: str | Kind, *, group_mark: int, id_mark: int, sample_key: list[str] | None = None,
          order: list[str] | None = None, inserted_at=None) -> tuple[DataFrame, ids.Numbered]:
    """(table rows, the numbering behind them). Without `sample_key` all rows are one run (one new group)."""
    n = ids.numbered(rows, list(sample_key or []), list(order or []))
    return from_numbered(n, kind, group_mark=group_mark, id_mark=id_mark, keyed=bool(sample_key), inserted_at=inserted_at), n


def table_rows(rows: DataFrame, kind: str | Kind, **marks) -> DataFrame:
    """Table rows (the kind's columns, in order) for the runs in `rows`; see `drawn`.

    `rows` holds the kind's figure columns plus `sample_key` / `order`
    columns. The staged copy stays in the shared folder while the result is used.
    """
    return drawn(rows, kind, **marks)[0]
