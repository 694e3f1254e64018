"""The four collectors: raw messages → folds → stored tables (ST-5).

A message is one reading of one metric: `sample_id`, `ts`, and the parts as
they were read, lists included. Per micro-batch the messages are flattened into
the raw tables that the batch folds of :mod:`hostshelf.operators.snapshots`
take, so a stream and a batch over the same messages give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshots
from ..schemas import DEFAULT_INTERVAL_SECONDS
from ..sinks.store import SnapshotTable
from .collect import backfill_then_live, latest_per_interval, start_collector

_COUNTERS = ", ".join(f"{c}: decimal(20,0)" for c in snapshots.NET_COUNTERS)
#: Message schemas. Byte and packet counters and sizes are unsigned 64-bit readings.
MESSAGES = {
    "cpu": "sample_id bigint, ts timestamp, cpu_ok boolean, utilization array<double>, uptime_s bigint, "
           "cores array<struct<core_no: int, phys_core: int, model_name: string, mhz: double>>, "
           "procs array<struct<num_threads: int, num_fds: int>>",
    "ram": "sample_id bigint, ts timestamp, mem_ok boolean, total_b decimal(20,0), used_b decimal(20,0), "
           "free_b decimal(20,0), committed_as decimal(20,0), cached_b decimal(20,0)",
    "net": "sample_id bigint, ts timestamp, net_ok boolean, conn_ok boolean, "
           f"ifaces array<struct<{_COUNTERS}>>, connections array<string>",
    "file": "sample_id bigint, ts timestamp, parts_ok boolean, partitions array<struct<mountpoint: string, "
            "usage_ok: boolean, total: decimal(20,0), used: decimal(20,0), free: decimal(20,0), used_percent: double>>",
}
#: Insert order of the rows of a run.
ORDER = {"cpu": [], "ram": [], "net": [], "file": ["part_no"]}


def _signed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: snapshots.unsigned_long(F.col(c)) for c in columns})


def cpu_rows(messages: DataFrame) -> DataFrame:
    cores = messages.select("sample_id", F.inline("cores"))
    procs = messages.select("sample_id", F.inline("procs"))
    host = messages.select("sample_id", "cpu_ok", "utilization", "uptime_s")
    cores = cores.withColumns({"tie1": F.lit(0), "tie2": F.lit(0)})
    return snapshots.cpu_snapshot(host, cores, procs)


def ram_rows(messages: DataFrame) -> DataFrame:
    return _signed(snapshots.ram_project(messages), ("total", "used", "free", "commited", "cached"))


def net_rows(messages: DataFrame) -> DataFrame:
    ifaces = _signed(messages.select("sample_id", F.inline("ifaces")), snapshots.NET_COUNTERS)
    conns = messages.select("sample_id", F.explode("connections").alias("kind"))
    return snapshots.net_snapshot(messages.select("sample_id", "net_ok", "conn_ok"), ifaces, conns)


def file_rows(messages: DataFrame) -> DataFrame:
    parts = messages.select("sample_id", "parts_ok", F.posexplode("partitions").alias("part_no", "p"))
    parts = parts.select("sample_id", "parts_ok", "part_no", "p.*")
    return _signed(snapshots.file_project(parts, order="part_no"), ("total", "used", "free"))


ROWS = {"cpu": cpu_rows, "ram": ram_rows, "net": net_rows, "file": file_rows}


def per_interval(messages: DataFrame, interval_seconds: int = DEFAULT_INTERVAL_SECONDS,
                 watermark: str | None = None) -> DataFrame:
    """The newest message of each interval."""
    return latest_per_interval(messages, "ts", f"{interval_seconds} seconds", watermark)


def start(kind: str, messages: DataFrame, table: SnapshotTable, checkpoint: str, *,
          interval_seconds: int = DEFAULT_INTERVAL_SECONDS, watermark: str = "1 minute", live: bool = True,
          insert_time=None) -> StreamingQuery:
    """One metric's collector on a stream of its messages: backfill, then (with `live`) every interval.

    The newest message of each interval becomes one group of the table.
    """
    points = per_interval(messages, interval_seconds, watermark)
    settings = {"sample_key": ["sample_id"], "order": ORDER[kind], "insert_time": insert_time}
    if live:
        return backfill_then_live(points, table, ROWS[kind], checkpoint, interval_seconds=interval_seconds, **settings)
    return start_collector(points, table, ROWS[kind], checkpoint, available_now=True, **settings)


def start_all(streams: dict[str, DataFrame], tables: dict[str, SnapshotTable], checkpoint_root: str,
              **settings) -> dict[str, StreamingQuery]:
    """Independent collectors, each with its own checkpoint."""
    return {kind: start(kind, stream, tables[kind], f"{checkpoint_root.rstrip('/')}/{kind}", **settings)
            for kind, stream in streams.items()}
