"""Group and row identities (SNK-11, SNK-12) in one pass over staged rows.

1. One range partitioning by (sample key, order), sorted inside partitions. The
   order takes part in the range key, so the rows of one hot sample spread over
   as many partitions as they need.
2. Each task numbers its rows and its runs of equal keys as they stream by
   (Arrow batches; the other columns pass through untouched), and the result is
   staged once as Parquet in the session's shared folder: positions are part of
   the staged rows, so a re-read or a retried task cannot change them.
3. One row per partition (rows, runs, first and last key) gives all offsets; a
   key that a partition border cuts continues the run before it.
4. number = mark + offset of the partition + position, from a join with that
   small table (one row per partition).

Numbers are `long`; the casts to the tables' 32-bit ids raise when a number
does not fit. A null key is a key like any other and comes first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

INT_MAX = 2 ** 31 - 1


class Numbered(NamedTuple):
    """Rows with `row_no` and `key_no` (both from 0), their totals, and the staged folder behind them."""
    rows: DataFrame
    n_rows: int
    n_keys: int
    path: str

    def discard(self) -> None:
        """Remove the staged folder; `rows` cannot be read afterwards."""
        spark = self.rows.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, key: list[Column | str], order: list[Column | str] = ()) -> Numbered:
    """Number rows by (key, order) and distinct keys by key. Without either, rows are numbered as they lie."""
    spark = df.sparkSession
    names = [f"_k{i}" for i in range(len(key))]
    plain = [F.col(c) if isinstance(c, str) else c for c in (*key, *order)]
    rows = df.select("*", *[_value(c).alias(n) for c, n in zip(plain, names)])
    if plain:
        rows = rows.repartitionByRange(*plain).sortWithinPartitions(*plain)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "_row", "_run"))])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows.mapInArrow(_positions(names), schema).write.parquet(path)
    staged = spark.read.schema(schema).parquet(path)

    parts = (staged.groupBy("_part").agg(F.count("*").alias("rows"), F.max("_run").alias("last_run"))
             .orderBy("_part").collect())  # one row per partition
    edge = _edge_keys(staged, names, [(p["_part"], p["rows"]) for p in parts]) if names else {}
    offsets, n_rows, n_keys, before = [], 0, 0, None
    for p in parts:
        if names and before is not None and edge[p["_part"], 0] == before:
            n_keys -= 1  # the run goes on
        offsets.append((p["_part"], n_rows, n_keys))
        n_rows, n_keys = n_rows + p["rows"], n_keys + p["last_run"] + 1
        before = edge.get((p["_part"], p["rows"] - 1))
    small = spark.createDataFrame(offsets, "_part long, _rows_before long, _runs_before long")
    out = (staged.join(F.broadcast(small), "_part")  # one row per partition
           .withColumn("row_no", F.col("_rows_before") + F.col("_row"))
           .withColumn("key_no", F.col("_runs_before") + F.col("_run"))
           .select(*[F.col(f"`{c}`") for c in df.columns], "row_no", "key_no"))
    return Numbered(out, n_rows, n_keys, path)


def _edge_keys(staged: DataFrame, names: list[str], sizes: list[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
    """(partition, row) -> key of the first and last row of every partition."""
    ends = staged.sparkSession.createDataFrame(sorted({(p, r) for p, n in sizes for r in (0, n - 1)}), "_part long, _row long")
    rows = staged.select("_part", "_row", *names).join(F.broadcast(ends), ["_part", "_row"])  # two rows per partition
    return {(r["_part"], r["_row"]): tuple(r[n] for n in names) for r in rows.collect()}


def _value(c: Column) -> Column:
    """The value to compare runs by; a sort order (`desc`) has the same runs as its column."""
    name = c._jc.toString() if hasattr(c, "_jc") else str(c)
    for tail in (" DESC NULLS LAST", " DESC NULLS FIRST", " ASC NULLS FIRST", " ASC NULLS LAST"):
        if name.endswith(tail):
            return F.expr(name[:-len(tail)])
    return c


def _positions(names: list[str]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, run, last = TaskContext.get().partitionId(), 0, -1, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for name in names:
                values = b.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= np.diff(values) != 0
            first = tuple(b.column(name)[0].as_py() for name in names)
            new[0] = last is None or first != last
            runs = run + np.cumsum(new)
            extra = [np.full(n, part), np.arange(row, row + n), runs]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in extra)],
                                             names=[*b.schema.names, "_part", "_row", "_run"])
            row, run, last = row + n, int(runs[-1]), tuple(b.column(name)[n - 1].as_py() for name in names)
    return apply


def checked_int(number: Column) -> Column:
    """A 32-bit id; a number that does not fit raises."""
    return F.when(number <= F.lit(INT_MAX), number.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("id does not fit the table: "), number.cast("string"))).cast("int"))


def sequence(df: DataFrame, order: list[Column | str], out_col: str, start: int = 1) -> DataFrame:
    """Number rows from `start` on in `order` (the order key must be unique)."""
    return (numbered(df, [], order).rows.withColumn(out_col, F.col("row_no") + F.lit(start).cast("long"))
            .drop("row_no", "key_no"))


def assign_group_ids(samples: DataFrame, key_cols: list[str], high_water: int,
                     group_col: str = "group_id") -> DataFrame:
    """SNK-11: one new group id per distinct sample key, after `high_water`.

    The mark is stored by the table, not taken as ``max(group_id)``, so an id
    freed by retention is never drawn again. Keys are numbered in key order.
    """
    return (numbered(samples, key_cols).rows
            .withColumn(group_col, checked_int(F.col("key_no") + F.lit(high_water + 1).cast("long")))
            .drop("row_no", "key_no"))


def assign_row_ids(rows: DataFrame, order: list[Column | str], high_water: int,
                   id_col: str = "id") -> DataFrame:
    """SNK-12: row ids rising in insert order (`order`), after `high_water`."""
    return sequence(rows, order, id_col, start=high_water + 1).withColumn(id_col, checked_int(F.col(id_col)))
