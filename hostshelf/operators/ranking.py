"""Exact k-th largest value of an integer column: one range descent for every "newest N" rule.

Row offset and limit, `limit_group`, `offset_group` and retention all reduce
to cutoffs on `id` or `group_id`. A cutoff comes back to the driver as one
integer, so the final predicate (`group_id >= cut`) is a literal that Parquet
statistics and bucket folders can prune on.

1. A one-row aggregate gives the column's least and largest value.
2. The newest range, twice the largest rank wide, is read with literal bounds
   and counted per bucket of equal width (at most `BUCKETS` rows come back). If
   it holds too few values, the range grows by the factor `BUCKETS`.
3. For each rank the bucket that holds it is cut into buckets again, all ranks
   in one job, until a bucket is one value wide.

Counts are of rows or of distinct values; both are combined in the map tasks,
so a value that a third of all rows share sends one row per task. The same
steps run for every rank and every table size, and no step sorts rows or
collects anything but bucket counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
_LONG_MAX = (1 << 63) - 1


class Cutoff(NamedTuple):
    """A ranked value and how many rows (or distinct values) hold it."""
    value: int
    ties: int


class _Range(NamedTuple):
    lo: int
    hi: int

    @property
    def width(self) -> int:
        """Values per bucket."""
        return -(-(self.hi - self.lo + 1) // BUCKETS)

    def bucket(self, i: int) -> _Range:
        top = self.hi - i * self.width
        return _Range(max(self.lo, top - self.width + 1), top)


def _histogram(values: DataFrame, ranges: list[_Range], distinct: bool) -> dict[tuple[int, int], int]:
    """(range, bucket from its top) -> count, for all ranges in one job."""
    v = F.col("v")
    key = F.lit(None).cast("long")
    for i, r in enumerate(ranges):
        # A wide range is measured in decimals: hi - v can exceed a long.
        kind = "decimal(20,0)" if r.hi - r.lo > _LONG_MAX else "bigint"
        step = F.expr(f"(CAST('{r.hi}' AS {kind}) - CAST(v AS {kind})) div CAST('{r.width}' AS {kind})")
        key = F.when((v >= F.lit(r.lo)) & (v <= F.lit(r.hi)), step + F.lit(i * BUCKETS)).otherwise(key)
    inside = F.lit(False)
    for r in ranges:
        inside = inside | ((v >= F.lit(r.lo)) & (v <= F.lit(r.hi)))
    count = F.countDistinct("v") if distinct else F.count(F.lit(1))
    rows = values.where(inside).groupBy(key.alias("key")).agg(count.alias("n")).collect()
    return {divmod(r["key"], BUCKETS): r["n"] for r in rows}


def cutoffs(df: DataFrame, col: str, ranks: list[int], *, distinct: bool = True) -> dict[int, Cutoff | None]:
    """The value at each rank (1 = largest) among the distinct values or, with `distinct=False`, the rows.

    None where the column has fewer non-null values.
    """
    if any(k <= 0 for k in ranks):
        raise ValueError("k must be positive")
    dtype = df.schema[col].dataType
    if not isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        raise TypeError(f"{col} must be an integer column, not {dtype.simpleString()}")
    if not ranks:
        return {}
    values = df.select(F.col(col).cast("long").alias("v")).where(F.col("v").isNotNull())
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if ends["hi"] is None:
        return dict.fromkeys(ranks)
    span = 2 * max(ranks)
    while True:
        newest = _Range(max(ends["lo"], ends["hi"] - span + 1), ends["hi"])
        counts = _histogram(values, [newest], distinct)
        if sum(counts.values()) >= max(ranks) or newest.lo == ends["lo"]:
            break
        span *= BUCKETS
    found: dict[int, Cutoff | None] = {}
    ranges, at = [newest], {k: (0, k) for k in ranks}  # rank -> its range, the rank inside it
    while at:
        inner: dict[_Range, int] = {}
        below = {}
        for k, (i, rank) in at.items():
            for b in sorted(b for r, b in counts if r == i):
                if rank <= counts[i, b]:
                    r = ranges[i].bucket(b)
                    if r.lo == r.hi:
                        found[k] = Cutoff(r.hi, counts[i, b])
                    else:
                        below[k] = (inner.setdefault(r, len(inner)), rank)
                    break
                rank -= counts[i, b]
            else:
                found[k] = None
        ranges, at = list(inner), below
        counts = _histogram(values, ranges, distinct) if at else {}
    return {k: found[k] for k in ranks}


def kth_largest(df: DataFrame, col: str, k: int, *, distinct: bool = True) -> int | None:
    """The k-th largest (distinct) non-null value of integer column `col`, or None if there are fewer."""
    cut = cutoffs(df, col, [k], distinct=distinct)[k]
    return None if cut is None else cut.value
