"""The filter registry: request names → predicates and paging arguments.

Rules (input side):

* each name is looked up in the queried table's registry; a name no table
  knows is ignored;
* a repeated name uses its first value, a name given with no values is
  skipped, an empty string is a value (and fails its cast);
* both the documented prefixed name (`cpu_utilization_min`) and the short
  name (`utilization_min`) are accepted; a short name is resolved within the
  queried table, so `total_min` means RAM `total` on `ram` and disk `total`
  on `file`;
* a name that belongs to another table only is an error (it can never
  apply), raised before any Spark work;
* predicates combine with AND; bounds are inclusive; patterns use LIKE with
  caller-supplied wildcards.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import Kind, kind_of
from .literals import like_pattern, parse_count, typed_literal

# The documented filter names. Range filters are
# `<prefix>_<column>_min` (column >= v) and `<prefix>_<column>_max`
# (column <= v); pattern filters are `<prefix>_<column>` (column LIKE v).
# The short name drops `<prefix>_`.
TABLE_PREFIX = {"cpu": "cpu", "ram": "ram", "net": "net", "file": "file"}
RANGE_COLUMNS = {
    "cpu": ("physical_cores", "logical_cores", "utilization", "current_speed_mhz",
            "base_speed_mhz", "processes_amount", "threads_amount", "handles_amount", "uptime"),
    "ram": ("total", "used", "free", "commited", "cached"),
    "net": ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "err_in", "err_out",
            "connections"),
    "file": ("total", "used", "free", "used_percent"),
}
PATTERN_COLUMNS = {"cpu": ("name",), "file": ("path",)}
# Common to all four tables.
TIME_FILTERS = {"start_datetime": ">=", "end_datetime": "<="}
GROUP_PAGING = ("limit_group", "offset_group")
ROW_PAGING = ("limit", "offset")


@dataclass(frozen=True)
class FilterDef:
    """One registry entry: documented name, short name, column, operator."""

    name: str
    short: str
    column: str
    op: str  # ">=", "<=", "like"

    def predicate(self, kind: Kind, value: Any) -> Column:
        col = F.col(self.column)
        if self.op == "like":
            return col.like(like_pattern(str(value)))
        lit = typed_literal(value, kind.field(self.column).dataType)
        return col >= lit if self.op == ">=" else col <= lit


def _registry() -> dict[str, dict[str, FilterDef]]:
    reg: dict[str, dict[str, FilterDef]] = {}
    for kind in TABLE_PREFIX:
        entries: dict[str, FilterDef] = {}
        for name, op in TIME_FILTERS.items():
            entries[name] = FilterDef(name, name, "insertion_datetime", op)
        prefix = TABLE_PREFIX[kind]
        for col in RANGE_COLUMNS[kind]:
            for suffix, op in (("min", ">="), ("max", "<=")):
                short = f"{col}_{suffix}"
                entries[f"{prefix}_{short}"] = FilterDef(f"{prefix}_{short}", short, col, op)
        for col in PATTERN_COLUMNS.get(kind, ()):
            entries[f"{prefix}_{col}"] = FilterDef(f"{prefix}_{col}", col, col, "like")
        reg[kind] = entries
    return reg


REGISTRY = _registry()


def _lookup_table(kind: str) -> dict[str, FilterDef]:
    """Both documented and short names of one table → definition."""
    out: dict[str, FilterDef] = {}
    for d in REGISTRY[kind].values():
        out[d.name] = d
        out[d.short] = d
    return out


_BY_NAME = {k: _lookup_table(k) for k in REGISTRY}
_ALL_NAMES = frozenset(n for t in _BY_NAME.values() for n in t) | set(GROUP_PAGING) | set(ROW_PAGING)


@dataclass
class QuerySpec:
    """A validated request: predicates (driver-side Column objects) and paging."""

    kind: Kind
    predicates: list[Column] = field(default_factory=list)
    applied: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    limit_group: int | None = None
    offset_group: int | None = None

    def where(self) -> Column | None:
        if not self.predicates:
            return None
        return functools.reduce(operator.and_, self.predicates)


def _first_value(values: Any) -> tuple[bool, Any]:
    if isinstance(values, (list, tuple)):
        return (True, values[0]) if values else (False, None)
    return True, values


def resolve(kind: str | Kind, form: Mapping[str, Any] | Sequence[tuple[str, Any]] | None) -> QuerySpec:
    """Turn request fields into a :class:`QuerySpec` for one table kind."""
    k = kind_of(kind)
    spec = QuerySpec(k)
    if not form:
        return spec
    items = form.items() if isinstance(form, Mapping) else form
    table = _BY_NAME[k.name]
    seen: set[str] = set()
    misfits: list[str] = []
    for name, values in items:
        if name in seen:
            continue  # repeated name: first value wins
        present, value = _first_value(values)
        if not present:
            continue
        seen.add(name)
        if name in ROW_PAGING or name in GROUP_PAGING:
            setattr(spec, name, parse_count(name, value))
            spec.applied.append(name)
        elif name in table:
            spec.predicates.append(table[name].predicate(k, value))
            spec.applied.append(name)
        elif name in _ALL_NAMES:
            misfits.append(name)
        # else: unknown everywhere → ignored
    if misfits:
        raise ValueError(f"filters {sorted(misfits)} do not apply to table kind {k.name!r}")
    return spec
