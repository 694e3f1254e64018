"""Periodic collection as Structured Streaming (ST-1…5).

* ST-1 — one collection per interval: a tumbling window on the event time keeps
  the newest sample of each interval with all its rows (a disk run has one row
  per partition); late rows beyond the watermark are dropped.
* ST-2 — backfill first (``trigger(availableNow=True)``), then a live
  query with ``trigger(processingTime=...)`` on the same checkpoint.
* ST-3 — per micro-batch: fold the raw messages, allocate groups, prune, append
  (:meth:`SnapshotTable.append_run` inside ``foreachBatch``). The batch is
  computed once, when the append stages its rows.
* ST-4 — a replayed micro-batch carries the same query and batch id; the
  table's log recognises the pair, so a retry adds no group; `supervised`
  starts a failed collector again, at most three times in a row. An empty
  micro-batch is not a collection run: it draws no group and prunes nothing.
* ST-5 — each metric is its own query with its own checkpoint
  (see :mod:`.pipelines` for the four of them).

Event time: `withWatermark` needs a TIMESTAMP (with zone) column; tables use
TIMESTAMP_NTZ, so the stream casts with the session zone pinned to UTC and
casts back for the table.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import DEFAULT_INTERVAL_SECONDS, DEFAULT_RETRIES
from ..sinks.store import SnapshotTable


#: Keys over which a stream deals the rows of one interval.
SALTS = 16


def latest_per_interval(df: DataFrame, ts_col: str, interval: str = f"{DEFAULT_INTERVAL_SECONDS} seconds",
                        watermark: str | None = None, sample_col: str | None = None,
                        keys: tuple[str, ...] = ()) -> DataFrame:
    """All rows of the newest sample of each tumbling interval (and of each `keys` value, e.g. a host).

    The newest sample is the one of the row with the latest timestamp; without
    `sample_col` every row is a sample. Ties go to the greater sample id, then
    to the row whose other columns come last. Output: `window_start`, the other
    input columns, `sample_ts` (the newest row's time). Works on a batch or a
    streaming DataFrame. The newest row or sample id is a maximum, combined in
    the map tasks; with `sample_col` it is joined back to the rows, so an
    interval may hold any share of the table. On a stream that takes append
    mode and a `watermark`, and the state holds one row per row of an open
    interval. Empty input gives no rows; a row without a time is in no interval.
    """
    others = [c for c in df.columns if c != ts_col and c not in keys]
    ts = F.col(ts_col)
    src = df
    if watermark is not None:
        src = src.withColumn(ts_col, ts.cast("timestamp")).withWatermark(ts_col, watermark)
        ts = F.col(ts_col)
    if sample_col is not None:
        return _whole_samples(src, ts, interval, sample_col, keys, others)
    row = F.struct(ts.alias("t"), F.struct(*others).alias("x"))
    best = F.max_by(row, F.struct(ts, *_plain(df, others)))
    agg = src.groupBy(F.window(ts, interval).alias("w"), *keys).agg(_hashed(best).alias("r"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys,
                      *[F.col(f"r.x.{c}").alias(c) for c in others], F.col("r.t").cast("timestamp_ntz").alias("sample_ts"))


def _plain(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that can be ordered and hashed."""
    return [c for c in columns if "map<" not in df.schema[c].dataType.simpleString()]


def _hashed(value: Column) -> Column:
    """The aggregate `value` in an object hash aggregate: a struct's maximum alone would sort all rows before it combines them.

    That saves the sort while a task meets at most 128 groups (a live
    micro-batch); beyond that Spark sorts the rest of the task's rows, inside
    the task, and combines them before the shuffle as before. The list stays
    empty, since collect_list leaves nulls out.
    """
    return F.when(F.size(F.collect_list(F.lit(None).cast("int"))) == 0, value)


def _whole_samples(rows: DataFrame, ts: Column, interval: str, sample_col: str, keys: tuple[str, ...],
                   others: list[str]) -> DataFrame:
    """The newest (time, sample) of each interval, joined back to the rows.

    In a batch the join keys are not the aggregate's grouping (the window's
    start, not the window), so both sides get an exchange and a large sample
    can be split. A stream chains two stateful operators: the aggregate sends
    an interval's newest sample when the watermark has passed its end, and a
    stream join, whose state ends with the same watermark, meets it with the
    rows kept so far. A stream's join cannot be split at run time, so the rows
    of a sample are dealt over `SALTS` keys and the one newest row goes to each.
    """
    sample = [*keys, sample_col]
    renamed = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    window = F.window(ts, interval).alias("w")
    newest = (rows.groupBy(window, *keys)
              .agg(_hashed(F.max(F.struct(ts.alias("t"), F.col(sample_col).alias("s")))).alias("newest"))
              .select(F.col("w").alias("_w"), *renamed, F.col("newest.s").alias(f"_k{len(keys)}"),
                      F.col("newest.t").cast("timestamp_ntz").alias("sample_ts")))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(sample)]
    if rows.isStreaming:
        newest = newest.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = rows.select(window, *keys, *others, F.pmod(F.xxhash64(ts, *_plain(rows, others)), F.lit(SALTS)).cast("int").alias("_salt"))
        own = own.join(newest, [F.col("w") == F.col("_w"), F.col("_salt") == F.col("_s"), *same])
        own = own.withColumn("window_start", F.col("w.start"))
    else:
        own = rows.select(window, *keys, *others).withColumn("window_start", F.col("w.start")).drop("w")
        own = own.join(newest.withColumn("_w", F.col("_w.start")), [F.col("window_start") == F.col("_w"), *same])
    return own.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), *keys, *others, "sample_ts")


def _query_id(batch: DataFrame) -> str:
    """Id of the streaming query behind a micro-batch; a new checkpoint has a new one."""
    return batch._jdf.sparkSession().sparkContext().getLocalProperty("sql.streaming.queryId") or ""


def snapshot_writer(table: SnapshotTable, to_rows: Callable[[DataFrame], DataFrame],
                    sample_key: list[str] | None = None, order: list[str] | None = None,
                    insert_time=None, quarantine: bool = False) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body: append the batch's runs; empty and replayed batches add nothing.

    With `quarantine` bad rows are kept aside instead of failing the query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append_run(to_rows(batch), batch_id, writer=_query_id(batch), sample_key=sample_key, order=order,
                         insert_time=insert_time, skip_empty=True, quarantine=quarantine)

    return write


def start_collector(stream: DataFrame, table: SnapshotTable, to_rows: Callable[[DataFrame], DataFrame],
                    checkpoint: str, *, sample_key: list[str] | None = None,
                    order: list[str] | None = None, available_now: bool = False,
                    interval_seconds: int = DEFAULT_INTERVAL_SECONDS, insert_time=None,
                    quarantine: bool = False) -> StreamingQuery:
    """Start one metric pipeline (own checkpoint); backfill with `available_now`.

    Always in append mode: other modes send an interval again, which would
    become a new group each time.
    """
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.foreachBatch(snapshot_writer(table, to_rows, sample_key, order, insert_time, quarantine))
    w = w.trigger(availableNow=True) if available_now else w.trigger(
        processingTime=f"{interval_seconds} seconds")
    return w.start()


def backfill_then_live(stream: DataFrame, table: SnapshotTable, to_rows: Callable[[DataFrame], DataFrame],
                       checkpoint: str, *, timeout_s: float | None = None, **kw) -> StreamingQuery:
    """ST-2: drain what is already there (``availableNow``), then keep
    collecting on the same checkpoint every interval; returns the live query.

    A backfill that is not done after `timeout_s` is stopped first, but not
    before its first batch has ended (a checkpoint with state and without a
    committed batch cannot be taken up again); the live query goes on where it
    was. Intervals that the stopped backfill had closed but not written come
    with the next data.
    """
    first = start_collector(stream, table, to_rows, checkpoint, available_now=True, **kw)
    done = first.awaitTermination() if timeout_s is None else first.awaitTermination(timeout_s)
    if timeout_s is not None and not done:
        while first.isActive and first.lastProgress is None:
            first.awaitTermination(0.1)
        first.stop()
    return start_collector(stream, table, to_rows, checkpoint, available_now=False, **kw)


def supervised(start: Callable[[], StreamingQuery], max_retries: int = DEFAULT_RETRIES, delay_s: float = 0.0,
               on_error: Callable[[Exception, int], None] | None = None) -> StreamingQuery:
    """ST-4: run a collector to its end, and start it again on its checkpoint when it fails.

    `start` starts the query (always with the same checkpoint and table, so the
    failed batch is known and adds no second group). After `max_retries`
    failures without a finished batch between them the last error is raised.
    `on_error` sees every error and the failures so far. Returns the query that
    ended without one.
    """
    failures = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException as exc:
            failures = 1 if query.lastProgress is not None and query.lastProgress["numInputRows"] > 0 else failures + 1
            if on_error is not None:
                on_error(exc, failures)
            if failures > max_retries:
                raise
            time.sleep(delay_s)
