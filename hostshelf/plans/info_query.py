"""`info_query`: one request against one snapshot table.

Order of work (as the store runs it): compatible filters → WHERE (typed
literals, AND) → group paging (ranks over the whole table) → newest-first
sort → offset → limit. The result is a lazy DataFrame; the only eager work is
computing the group / row cutoffs, each a single integer.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..functions.filters import QuerySpec, resolve
from ..operators.paging import group_bounds, page_rows
from ..schemas import Kind, kind_of
from ..sinks.store import SnapshotTable
from ..sources.tables import project


def build(table: DataFrame, spec: QuerySpec) -> DataFrame:
    base = project(table, spec.kind)
    out = base
    where = spec.where()
    if where is not None:
        out = out.where(where)
    groups = group_bounds(base, spec.limit_group, spec.offset_group)
    if groups is not None:
        out = out.where(groups)
    return page_rows(out, spec.limit, spec.offset)


def info_query(table: DataFrame, kind: str | Kind, form: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of `table` (of the given kind) that match the request fields.

    >>> info_query(cpu_df, "cpu", {"limit": "50", "start_datetime": "2026-07-01T00:00:00Z"})
    """
    return build(table, resolve(kind_of(kind), form))


def stored_query(table: SnapshotTable, form: Mapping[str, Any] | None = None) -> DataFrame:
    """`info_query` over a stored table. Group ranks, and without filters the page as well, come from its log entry."""
    spec, state = resolve(table.kind, form), table.state()
    where = spec.where()
    groups = {"limit_group": spec.limit_group, "offset_group": spec.offset_group}
    if where is None:
        return table.page(spec.limit, spec.offset, **groups, state=state)
    return page_rows(table.page(**groups, state=state, ordered=False).where(where), spec.limit, spec.offset)
