"""Row paging (newest first) and snapshot-group paging.

Row paging (`limit`, `offset`) sorts by `id` descending after all filters. A
page is an `id` range between exact cutoffs (see :mod:`.ranking`, both ends in
one descent) and a distributed range sort of the rows in it, whatever its size:
no task merges the best rows of all others.

Group paging (`limit_group`, `offset_group`) keeps rows whose group's dense
rank by `group_id` descending, computed over the **whole** table (not the
filtered rows), satisfies ``offset_group < rank <= limit_group``. Both
bounds are absolute ranks, so limit 10 + offset 10 is empty. The ranks turn
into one literal `group_id` range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import cutoffs


def _nothing(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def group_bounds(table: DataFrame, limit_group: int | None, offset_group: int | None,
                 *, group_col: str = "group_id") -> Column | None:
    """Predicate on `group_col` for ``offset_group < dense_rank <= limit_group``.

    `table` must be the unfiltered table: ranks come from all its groups.
    Returns None when no bound applies; ``lit(False)`` when nothing can match.
    A zero or negative bound compares like any number (no error).
    """
    conds: list[Column] = []
    g = F.col(group_col)
    typ = table.schema[group_col].dataType
    if limit_group is not None and limit_group <= 0:
        return F.lit(False)
    skip = offset_group if offset_group is not None and offset_group > 0 else None
    if limit_group is not None and skip is not None and skip >= limit_group:
        return F.lit(False)
    wanted = [k for k in (limit_group, skip) if k is not None]
    cuts = cutoffs(table, group_col, wanted)
    if limit_group is not None and cuts[limit_group] is not None:
        conds.append(g >= F.lit(cuts[limit_group].value).cast(typ))  # else fewer groups: all qualify
    if skip is not None:
        if cuts[skip] is None:  # every group is within the skipped ranks
            return F.lit(False)
        conds.append(g < F.lit(cuts[skip].value).cast(typ))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def page_groups(table: DataFrame, limit_group: int | None = None, offset_group: int | None = None,
                *, group_col: str = "group_id") -> DataFrame:
    """Rows of the groups ranked ``offset_group < rank <= limit_group`` (newest = 1)."""
    cond = group_bounds(table, limit_group, offset_group, group_col=group_col)
    return table if cond is None else table.where(cond)


def page_rows(df: DataFrame, limit: int | None = None, offset: int | None = None,
              *, order_col: str = "id", ordered: bool = True) -> DataFrame:
    """Newest-first rows, skipping `offset` then taking `limit` (offset before limit).

    `order_col` must be unique (as `id` is); a tie at an end of the page raises.
    ``ordered=False`` leaves out the final sort, for callers that write on.
    """
    if limit is not None and limit < 0:
        raise ValueError("LIMIT must not be negative")
    if offset is not None and offset < 0:
        raise ValueError("OFFSET must not be negative")
    skip, stop = offset or 0, None if limit is None else (offset or 0) + limit
    if limit == 0:
        df = _nothing(df)
    elif skip or stop is not None:
        cuts = cutoffs(df, order_col, sorted({k for k in (skip, stop) if k}), distinct=False)
        if any(c is not None and c.ties > 1 for c in cuts.values()):
            raise ValueError(f"{order_col} is not unique, the page has no fixed border")
        typ, c = df.schema[order_col].dataType, F.col(order_col)
        if skip:
            df = _nothing(df) if cuts[skip] is None else df.where(c < F.lit(cuts[skip].value).cast(typ))
        if stop is not None and cuts[stop] is not None:
            df = df.where(c >= F.lit(cuts[stop].value).cast(typ))
    return df.orderBy(F.desc(order_col)) if ordered else df


def distinct_groups(table: DataFrame, group_col: str = "group_id") -> DataFrame:
    """GP-6: the distinct group ids (two-phase aggregate, partial dedupe per task)."""
    return table.select(group_col).distinct()


def group_rank(table: DataFrame, group_col: str = "group_id", rank_col: str = "newest_rank",
               partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """GP-7: dense rank of distinct groups, newest = 1, when the rank itself is output.

    Ranks only the distinct ids. With ``partition_cols`` (e.g. a host column)
    each partition is ranked by a hash-partitioned window; without, the ids are
    numbered over range partitions (see :mod:`.ids`), never in one task.
    """
    from pyspark.sql import Window

    from . import ids

    d = table.select(*partition_cols, group_col).distinct()
    if not partition_cols:
        return ids.sequence(d, [F.desc(group_col)], rank_col)
    w = Window.partitionBy(*partition_cols).orderBy(F.desc(group_col))
    return d.withColumn(rank_col, F.dense_rank().over(w).cast("long"))
