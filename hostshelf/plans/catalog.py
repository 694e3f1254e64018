"""Registered queries: a Spark builder and an independent SQL oracle per key.

Every builder reads the shared test tables through the fixture views (whole
tables, no sampling) and runs one library operator. Each oracle is written
in the plain relational form (dense rank + IN, ROW_NUMBER, LIMIT/OFFSET,
GROUP BY) over the same views, so the two sides share inputs but not logic.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import json_rows, render_timestamps
from ..operators import ids, keys, paging, retention, snapshots, validate
from ..operators.ranking import kth_largest
from ..schemas import kind_of
from ..session import checkpoint_dir
from ..sinks.store import open_table
from ..sources.fixtures import Fixtures, with_clause
from ..streaming.collect import latest_per_interval
from .info_query import info_query, stored_query

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Builder
    oracle: str | None


CATALOG: dict[str, Entry] = {}

# Fixed clock values used by the key-table queries (the data spans January 2024).
AS_OF = "2024-01-29 12:00:00"
AS_OF_MID = "2024-01-15 12:00:00"
NEW_RUN_TIME = "2024-02-01 00:00:00"


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def register(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        CATALOG[name] = Entry(fn, oracle)
        return fn
    return deco


TABLE_OF = {"cpu": "info_cpu", "ram": "info_ram", "net": "info_net", "file": "info_file"}


def _sql_rows(view: str, where: str = "", tail: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return f"{with_clause(view)}\nSELECT * FROM {view}{w} ORDER BY id DESC{(' ' + tail) if tail else ''}"


def _request(name: str, kind: str, form: dict, where_sql: str = "", tail: str = ""):
    """Register an `info_query` request and its SQL form."""
    view = TABLE_OF[kind]

    def build(spark, sf_dir):
        return info_query(_fx(spark, sf_dir).view(view), kind, form)

    register(name, _sql_rows(view, where_sql, tail))(build)


def _newest(view: str, n: int) -> str:
    """Rows of the n newest groups, by counting the distinct newer ones."""
    return (f"group_id IN (SELECT group_id FROM (SELECT group_id, ROW_NUMBER() OVER (ORDER BY group_id DESC) AS place "
            f"FROM (SELECT group_id FROM {view} GROUP BY group_id) AS ids) AS placed WHERE place <= {n})")


# ---------------------------------------------------------------- sources (SRC, PRJ, FS-4)
for _kind in TABLE_OF:
    _request(f"scan_{_kind}", _kind, {})


@register("scan_session_keys", f"{with_clause('session_keys')}\nSELECT * FROM session_keys")
def _scan_keys(spark, sf_dir):
    from ..schemas import SESSION_KEYS
    return _fx(spark, sf_dir).session_keys.select(*SESSION_KEYS.names)


# ---------------------------------------------------------------- filter predicates (F-1…54)
# One request per table and column family, both bounds in one request.
_RANGES = {
    "cpu": {"physical_cores": (2, 5), "logical_cores": (4, 12), "utilization": (50, 150.5),
            "current_speed_mhz": (2100, 2300.25), "base_speed_mhz": (3100, 3300),
            "processes_amount": (150, 250), "threads_amount": (1500, 3000),
            "handles_amount": (6000, 9000), "uptime": (30000000000000, 150000000000000)},
    "ram": {"total": (17000000000, 19000000000), "used": (100000000, 300000000),
            "free": (15800000000, 15950000000), "commited": (50000000, 120000000),
            "cached": (200000000, 900000000)},
    "net": {"bytes_sent": (100000, 250000), "bytes_recv": (50000, 120000),
            "packets_sent": (50, 120), "packets_recv": (100, 250), "err_in": (1, 2),
            "err_out": (0, 1), "connections": (2, 5)},
    "file": {"total": (150000, 200000), "used": (100, 300), "free": (99800, 99950),
             "used_percent": (0.05, 0.2)},
}
for _kind, _cols in _RANGES.items():
    for _col, (_lo, _hi) in _cols.items():
        _request(f"flt_{_kind}_{_col}_range", _kind,
                 {f"{_kind}_{_col}_min": str(_lo), f"{_kind}_{_col}_max": str(_hi)},
                 f"{_col} >= {_lo} AND {_col} <= {_hi}")

_request("flt_cpu_name_like", "cpu", {"cpu_name": "%i_w"}, "name LIKE '%i_w' ESCAPE '\\'")
_request("flt_file_path_like", "file", {"file_path": "/s%/1"}, "path LIKE '/s%/1' ESCAPE '\\'")
_request("flt_start_datetime", "cpu", {"start_datetime": "2024-01-20T00:00:00Z"},
         "insertion_datetime >= TIMESTAMP '2024-01-20 00:00:00'")
_request("flt_end_datetime", "ram", {"end_datetime": "1997-06-30T12:00:00+03:00"},
         "insertion_datetime <= TIMESTAMP '1997-06-30 12:00:00'")
_request("flt_time_window_net", "net",
         {"start_datetime": "1998-01-01T00:00:00Z", "end_datetime": "1998-03-31T23:59:59Z"},
         "insertion_datetime >= TIMESTAMP '1998-01-01 00:00:00' AND "
         "insertion_datetime <= TIMESTAMP '1998-03-31 23:59:59'")
# FS-6 AND of several; D-1 short names resolved within the table; FS-1 unknown ignored.
_request("filter_multi_cpu", "cpu",
         {"utilization_min": "100", "cpu_physical_cores_max": "4", "name": "%e%",
          "end_datetime": "2024-01-25T00:00:00Z"},
         "utilization >= 100 AND physical_cores <= 4 AND name LIKE '%e%' ESCAPE '\\' AND "
         "insertion_datetime <= TIMESTAMP '2024-01-25 00:00:00'")
_request("filter_multi_file", "file",
         {"total_min": "100000", "used_max": "250", "path": "/click/%", "used_percent_min": "0.1"},
         "total >= 100000 AND used <= 250 AND path LIKE '/click/%' ESCAPE '\\' AND used_percent >= 0.1")
_request("filter_unknown_ignored", "ram", {"unknown_field": "x", "total_max": "16000000000",
                                           "cached_min": ["1000000000", "5"]},
         "total <= 16000000000 AND cached >= 1000000000")

# ---------------------------------------------------------------- row paging (PG-1…4)
_request("latest_cpu", "cpu", {"limit": "50", "start_datetime": "2024-01-15T00:00:00Z"},
         "insertion_datetime >= TIMESTAMP '2024-01-15 00:00:00'", "LIMIT 50")
_request("limit_rows", "ram", {"limit": "25"}, "", "LIMIT 25")
_request("offset_rows", "net", {"offset": "500"}, "", "OFFSET 500")
_request("page_rows", "cpu", {"utilization_min": "50", "limit": "10", "offset": "5"},
         "utilization >= 50", "LIMIT 10 OFFSET 5")
# A wide page with rows left out at both ends.
_request("page_rows_wide", "ram", {"limit": "12000", "offset": "300"}, "", "LIMIT 12000 OFFSET 300")

# ---------------------------------------------------------------- group paging (GP-1…7)
_request("group_limit", "file", {"limit_group": "10"}, _newest("info_file", 10))
_request("group_offset", "file", {"offset_group": "20"}, "NOT " + _newest("info_file", 20))
_request("group_page", "file", {"limit_group": "30", "offset_group": "20"},
         _newest("info_file", 30) + " AND " +
         "NOT " + _newest("info_file", 20))
_request("group_page_empty", "file", {"limit_group": "10", "offset_group": "10"},
         _newest("info_file", 10) + " AND " +
         "NOT " + _newest("info_file", 10))
_request("group_limit_filtered", "file", {"used_percent_min": "0.05", "limit_group": "3"},
         "used_percent >= 0.05 AND " + _newest("info_file", 3))
_request("group_then_row_page", "file",
         {"limit_group": "50", "offset_group": "5", "limit": "100", "offset": "20", "used_min": "20"},
         "used >= 20 AND " + _newest("info_file", 50) + " AND " +
         "NOT " + _newest("info_file", 5), "LIMIT 100 OFFSET 20")
# High ranks.
_request("group_page_wide", "ram", {"limit_group": "12000", "offset_group": "10500"},
         _newest("info_ram", 12000) + " AND " +
         "NOT " + _newest("info_ram", 10500))


# Groups of 160 rows: the disk table with 20 snapshots to a group.
_WIDE_GROUPS = ("SELECT id, CAST(FLOOR(group_id / 20) AS INT) AS group_id, path, total, used, free, used_percent, "
                "insertion_datetime FROM {info_file}")


@register("group_page_many_rows", f"{with_clause('info_file')},\nwide AS ({_WIDE_GROUPS.format(info_file='info_file')})\n"
          "SELECT * FROM wide WHERE " + _newest("wide", 30) + " AND NOT " + _newest("wide", 20))
def _group_page_many_rows(spark, sf_dir):
    wide = spark.sql(_WIDE_GROUPS, info_file=_fx(spark, sf_dir).info_file)
    return info_query(wide, "file", {"limit_group": "30", "offset_group": "20"})


@register("distinct_groups", f"{with_clause('info_file')}\nSELECT DISTINCT group_id FROM info_file")
def _distinct_groups(spark, sf_dir):
    return paging.distinct_groups(_fx(spark, sf_dir).info_file)


@register("group_rank", f"{with_clause('info_file')}\nSELECT group_id, ROW_NUMBER() OVER (ORDER BY group_id DESC) "
          "AS newest_rank FROM (SELECT group_id FROM info_file GROUP BY group_id) AS ids")
def _group_rank(spark, sf_dir):
    return paging.group_rank(_fx(spark, sf_dir).info_file)


# ---------------------------------------------------------------- retention (RT-1…6)
for _kind, _view in TABLE_OF.items():
    def _mk(view=_view):
        def build(spark, sf_dir):
            return retention.prune_before_insert(_fx(spark, sf_dir).view(view), 100)
        return build
    register(f"retain_{_kind}", f"{with_clause(_view)}\nSELECT * FROM {_view} WHERE "
             + _newest(_view, 99))(_mk())

_NEW_FILE_ROWS_SQL = (
    "SELECT CAST((SELECT MAX(id) FROM info_file) + ROW_NUMBER() OVER (ORDER BY event_id) AS INT) AS id, "
    "CAST((SELECT MAX(group_id) FROM info_file) + 1 AS INT) AS group_id, mountpoint AS path, "
    f"total, used, free, used_percent, TIMESTAMP '{NEW_RUN_TIME}' AS insertion_datetime FROM raw_usage "
    "WHERE usage_ok AND sample_id = (SELECT MAX(sample_id) FROM raw_usage)")


@register("append_and_retain",
          f"{with_clause('info_file', 'raw_usage')}\nSELECT * FROM info_file WHERE "
          + _newest("info_file", 99) + f"\nUNION ALL\n{_NEW_FILE_ROWS_SQL}")
def _append_and_retain(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    old = fx.info_file
    raw = fx.raw_usage
    newest = kth_largest(raw, "sample_id", 1)
    run = snapshots.file_project(raw.where(F.col("sample_id") == F.lit(newest)))
    group = kth_largest(old, "group_id", 1)
    rows = ids.assign_row_ids(run, ["event_id"], kth_largest(old, "id", 1, distinct=False))
    new = rows.select("id", F.lit(group + 1).cast("int").alias("group_id"), "path", "total", "used",
                      "free", "used_percent",
                      F.lit(NEW_RUN_TIME).cast("timestamp_ntz").alias("insertion_datetime"))
    return retention.append_and_retain(old, new, 100)


def _kept_keys(newest: int) -> str:
    """Unexpired keys at or above the least of the newest ids."""
    return (f"SELECT * FROM session_keys WHERE valid_until >= TIMESTAMP '{AS_OF}' AND id >= "
            f"(SELECT MIN(id) FROM (SELECT id FROM session_keys ORDER BY id DESC LIMIT {newest}) AS newest)")


@register("retain_session_keys",
          f"{with_clause('session_keys')}\n" + _kept_keys(500))
def _retain_keys(spark, sf_dir):
    return retention.retain_session_keys(_fx(spark, sf_dir).session_keys, AS_OF, 501)


# ---------------------------------------------------------------- session keys (SK-1…4)
_CANDIDATES_SQL = "SELECT CONCAT(event_type, '-', CAST(event_id + 1 AS VARCHAR(20))) AS session_key FROM events"


def _candidates(fx: Fixtures) -> DataFrame:
    return fx.spark.sql(_CANDIDATES_SQL.replace("FROM events", "FROM {events}"), events=fx.base("events"))


@register("keys_unseen", f"{with_clause('session_keys')}\nSELECT * FROM ({_CANDIDATES_SQL}) c "
          "WHERE NOT EXISTS (SELECT 1 FROM session_keys k WHERE k.session_key = c.session_key)")
def _keys_unseen(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return keys.keys_unseen(_candidates(fx), fx.session_keys)


@register("keys_valid", f"{with_clause('session_keys')}\nSELECT * FROM ({_CANDIDATES_SQL}) c "
          "WHERE c.session_key IN (SELECT session_key FROM session_keys "
          f"WHERE valid_until > TIMESTAMP '{AS_OF_MID}')")
def _keys_valid(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return keys.keys_valid(_candidates(fx), fx.session_keys, AS_OF_MID)


@register("key_expiry", "SELECT event_id, ts AS creation_datetime, ts + INTERVAL '90' MINUTE AS valid_until FROM events")
def _key_expiry(spark, sf_dir):
    ev = _fx(spark, sf_dir).base("events")
    return ev.select("event_id", F.col("ts").alias("creation_datetime"),
                     keys.key_expiry(F.col("ts"), 90).alias("valid_until"))


@register("session_key_save",
          f"{with_clause('session_keys')}\n" + _kept_keys(59) + "\nUNION ALL\n"
          "SELECT CAST((SELECT MAX(id) FROM session_keys) + 1 AS INT) AS id, "
          "CONCAT('key-', CAST(MAX(event_id) AS VARCHAR(20))) AS session_key, "
          f"TIMESTAMP '{AS_OF}' AS creation_datetime, TIMESTAMP '{AS_OF}' + INTERVAL '60' MINUTE AS valid_until "
          "FROM events")
def _session_key_save(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    table = fx.session_keys
    mark = kth_largest(table, "id", 1, distinct=False)
    new = fx.base("events").agg(F.concat(F.lit("key-"), F.max("event_id").cast("string")).alias("session_key"))
    new = new.select(F.lit(mark + 1).alias("id"), "session_key")
    return keys.session_key_save(table, new, AS_OF, 60, 60)


# ---------------------------------------------------------------- snapshot folds (AG-1…17)
def _host(fx: Fixtures) -> DataFrame:
    """`raw_host` with its utilization as the list that a collector reads (empty when unreadable)."""
    return fx.raw_host.withColumn("utilization", F.array_compact(F.array("utilization")))


@register("cpu_mean_mhz", f"{with_clause('raw_core')}\nSELECT sample_id, ROUND(AVG(mhz), 6) AS current_speed_mhz "
          "FROM raw_core GROUP BY sample_id")
def _cpu_mean_mhz(spark, sf_dir):
    m = snapshots.mean_mhz(_fx(spark, sf_dir).raw_core)
    return m.select("sample_id", F.round("current_speed_mhz", 6).alias("current_speed_mhz"))


@register("cpu_first_core", f"{with_clause('raw_core')}\nSELECT sample_id, model_name AS name, mhz AS base_speed_mhz "
          "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY core_no, tie1, tie2, mhz) AS rn "
          "FROM raw_core) t WHERE rn = 1")
def _cpu_first_core(spark, sf_dir):
    return snapshots.first_core(_fx(spark, sf_dir).raw_core)


@register("cpu_core_counts", f"{with_clause('raw_core')}\nSELECT sample_id, CAST(COUNT(DISTINCT phys_core) AS INT) "
          "AS physical_cores, CAST(COUNT(*) AS INT) AS logical_cores FROM raw_core GROUP BY sample_id")
def _cpu_core_counts(spark, sf_dir):
    return snapshots.core_counts(_fx(spark, sf_dir).raw_core)


# Readings per sample: none, one or two, the first of which counts.
_READINGS_SQL = ("CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS n, "
                 "o_totalprice / 10000 AS reading FROM")


@register("cpu_utilization_first", f"SELECT o_orderkey AS sample_id, CASE WHEN n = 0 THEN 0.0 ELSE reading END AS utilization "
          f"FROM (SELECT o_orderkey, {_READINGS_SQL} orders) AS r")
def _cpu_utilization_first(spark, sf_dir):
    r = spark.sql(f"SELECT o_orderkey AS sample_id, {_READINGS_SQL} {{orders}}", orders=_fx(spark, sf_dir).base("orders"))
    readings = F.slice(F.array(F.col("reading"), F.lit(99.5)), F.lit(1), F.col("n"))
    return r.select("sample_id", snapshots.first_or_zero(readings).alias("utilization"))


@register("proc_totals", f"{with_clause('raw_process')}\nSELECT sample_id, CAST(COUNT(*) AS INT) AS processes_amount, "
          "CAST(COALESCE(SUM(num_threads), 0) AS INT) AS threads_amount, "
          "CAST(COALESCE(SUM(num_fds), 0) AS INT) AS handles_amount FROM raw_process GROUP BY sample_id")
def _proc_totals(spark, sf_dir):
    return snapshots.process_totals(_fx(spark, sf_dir).raw_process)


@register("cpu_uptime_ns", f"{with_clause('raw_host')}\nSELECT sample_id, "
          "CAST(COALESCE(uptime_s, 0) AS BIGINT) * 1000000000 AS uptime FROM raw_host")
def _cpu_uptime_ns(spark, sf_dir):
    h = _fx(spark, sf_dir).raw_host
    return h.select("sample_id", snapshots.uptime_ns(F.col("uptime_s")).alias("uptime"))


_NET_SUMS = ", ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS {c}" for c in snapshots.NET_COUNTERS)


@register("net_totals", f"{with_clause('raw_iface')}\nSELECT sample_id, {_NET_SUMS} FROM raw_iface GROUP BY sample_id")
def _net_totals(spark, sf_dir):
    return snapshots.net_totals(_fx(spark, sf_dir).raw_iface)


@register("net_connections", f"{with_clause('raw_connection')}\nSELECT sample_id, CAST(COUNT(*) AS INT) AS connections "
          "FROM raw_connection GROUP BY sample_id")
def _net_connections(spark, sf_dir):
    return snapshots.connection_counts(_fx(spark, sf_dir).raw_connection)


_RAM_BODY = ("SELECT sample_id, total_b AS total, used_b AS used, free_b AS free, committed_as AS commited, "
             "cached_b AS cached FROM raw_memory_read WHERE mem_ok")


@register("ram_project", f"{with_clause('raw_memory_read')}\n{_RAM_BODY}")
def _ram_project(spark, sf_dir):
    return snapshots.ram_project(_fx(spark, sf_dir).raw_memory_read)


_FILE_BODY = ("SELECT sample_id, event_id, mountpoint AS path, total, used, free, used_percent FROM raw_usage WHERE usage_ok")


@register("file_project", f"{with_clause('raw_usage')}\n{_FILE_BODY}")
def _file_project(spark, sf_dir):
    return snapshots.file_project(_fx(spark, sf_dir).raw_usage)


@register("cpu_snapshot", f"{with_clause('raw_host', 'raw_core', 'raw_process')},\n"
          "fc AS (SELECT sample_id, model_name, mhz FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id "
          "ORDER BY core_no, tie1, tie2, mhz) AS rn FROM raw_core) t WHERE rn = 1),\n"
          "cc AS (SELECT sample_id, COUNT(DISTINCT phys_core) AS pc, COUNT(*) AS lc, AVG(mhz) AS cur "
          "FROM raw_core GROUP BY sample_id),\n"
          "pt AS (SELECT sample_id, COUNT(*) AS np, SUM(num_threads) AS nt, SUM(num_fds) AS nf "
          "FROM raw_process GROUP BY sample_id)\n"
          "SELECT h.sample_id, COALESCE(fc.model_name, '') AS name, CAST(COALESCE(cc.pc, 0) AS INT) AS physical_cores, "
          "CAST(COALESCE(cc.lc, 0) AS INT) AS logical_cores, COALESCE(h.utilization, 0.0) AS utilization, "
          "ROUND(COALESCE(cc.cur, 0.0), 6) AS current_speed_mhz, COALESCE(fc.mhz, 0.0) AS base_speed_mhz, "
          "CAST(COALESCE(pt.np, 0) AS INT) AS processes_amount, CAST(COALESCE(pt.nt, 0) AS INT) AS threads_amount, "
          "CAST(COALESCE(pt.nf, 0) AS INT) AS handles_amount, "
          "CAST(COALESCE(h.uptime_s, 0) AS BIGINT) * 1000000000 AS uptime "
          "FROM raw_host h LEFT JOIN fc ON fc.sample_id = h.sample_id LEFT JOIN cc ON cc.sample_id = h.sample_id "
          "LEFT JOIN pt ON pt.sample_id = h.sample_id WHERE h.cpu_ok")
def _cpu_snapshot(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    s = snapshots.cpu_snapshot(_host(fx), fx.raw_core, fx.raw_process)
    return s.withColumn("current_speed_mhz", F.round("current_speed_mhz", 6))


# Written from the rule: every sample whose counters and connections were read, with zeros for what it lacks.
_NET_BODY = ("SELECT h.sample_id, " + ", ".join(
    f"(SELECT CAST(COALESCE(SUM(i.{c}), 0) AS BIGINT) FROM raw_iface AS i WHERE i.sample_id = h.sample_id) AS {c}"
    for c in snapshots.NET_COUNTERS) + ", (SELECT CAST(COUNT(*) AS INT) FROM raw_connection AS c "
    "WHERE c.sample_id = h.sample_id) AS connections FROM raw_net_host AS h WHERE h.net_ok AND h.conn_ok")
_NET_VIEWS = ("raw_net_host", "raw_iface", "raw_connection")


@register("net_snapshot", f"{with_clause(*_NET_VIEWS)}\n{_NET_BODY}")
def _net_snapshot(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return snapshots.net_snapshot(fx.raw_net_host, fx.raw_iface, fx.raw_connection)


# ---------------------------------------------------------------- appends (SNK-1…5)
# A bulk backfill: every raw sample becomes one new group after the marks.
_MARKS = {"group": 500, "id": 2000}


def _append_oracle(with_views: str, body: str, per_group_rows: bool = False, order: str = "") -> str:
    rn = (f"ROW_NUMBER() OVER (ORDER BY sample_id{', ' + order if order else ''})")
    return (f"{with_views},\nsnap AS ({body})\nSELECT CAST({_MARKS['id']} + {rn} AS INT) AS id, "
            f"CAST({_MARKS['group']} + DENSE_RANK() OVER (ORDER BY sample_id) AS INT) AS group_id, "
            "* EXCLUDE (sample_id{excl}), TIMESTAMP '{t}' AS insertion_datetime FROM snap")


def _append_entry(name, kind, with_views, body, build_rows, order=None, excl=""):
    oracle = _append_oracle(with_views, body, order=", ".join(order or [])).replace(
        "{excl}", excl).replace("{t}", NEW_RUN_TIME)

    def build(spark, sf_dir):
        from ..operators.append import table_rows
        rows = build_rows(_fx(spark, sf_dir))
        return table_rows(rows, kind, group_mark=_MARKS["group"], id_mark=_MARKS["id"],
                          sample_key=["sample_id"], order=order, inserted_at=NEW_RUN_TIME)

    register(name, oracle)(build)


_append_entry("append_ram", "ram", with_clause("raw_memory_read"), _RAM_BODY,
              lambda fx: snapshots.ram_project(fx.raw_memory_read))
_append_entry("append_net", "net", with_clause(*_NET_VIEWS), _NET_BODY,
              lambda fx: snapshots.net_snapshot(fx.raw_net_host, fx.raw_iface, fx.raw_connection))
_append_entry("append_file", "file", with_clause("raw_usage"), _FILE_BODY,
              lambda fx: snapshots.file_project(fx.raw_usage), order=["event_id"], excl=", event_id")
_append_entry("append_cpu", "cpu", with_clause("raw_host", "raw_core", "raw_process"),
              "SELECT h.sample_id, COALESCE(fc.model_name, '') AS name, "
              "CAST(COALESCE(cc.pc, 0) AS INT) AS physical_cores, CAST(COALESCE(cc.lc, 0) AS INT) AS logical_cores, "
              "COALESCE(h.utilization, 0.0) AS utilization, ROUND(COALESCE(cc.cur, 0.0), 6) AS current_speed_mhz, "
              "COALESCE(fc.mhz, 0.0) AS base_speed_mhz, CAST(COALESCE(pt.np, 0) AS INT) AS processes_amount, "
              "CAST(COALESCE(pt.nt, 0) AS INT) AS threads_amount, CAST(COALESCE(pt.nf, 0) AS INT) AS handles_amount, "
              "CAST(COALESCE(h.uptime_s, 0) AS BIGINT) * 1000000000 AS uptime FROM raw_host h "
              "LEFT JOIN (SELECT sample_id, model_name, mhz FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id "
              "ORDER BY core_no, tie1, tie2, mhz) AS rn FROM raw_core) t WHERE rn = 1) fc ON fc.sample_id = h.sample_id "
              "LEFT JOIN (SELECT sample_id, COUNT(DISTINCT phys_core) AS pc, COUNT(*) AS lc, AVG(mhz) AS cur "
              "FROM raw_core GROUP BY sample_id) cc ON cc.sample_id = h.sample_id "
              "LEFT JOIN (SELECT sample_id, COUNT(*) AS np, SUM(num_threads) AS nt, SUM(num_fds) AS nf "
              "FROM raw_process GROUP BY sample_id) pt ON pt.sample_id = h.sample_id WHERE h.cpu_ok",
              lambda fx: snapshots.cpu_snapshot(_host(fx), fx.raw_core, fx.raw_process).withColumn(
                  "current_speed_mhz", F.round("current_speed_mhz", 6)))


@register("append_session_key",
          f"{with_clause('session_keys')}\nSELECT * FROM session_keys\nUNION ALL\n"
          "SELECT CAST((SELECT MAX(id) FROM session_keys) + ROW_NUMBER() OVER (ORDER BY event_id) AS INT) AS id, "
          "CONCAT('new-', CAST(event_id AS VARCHAR(20))) AS session_key, "
          f"TIMESTAMP '{AS_OF}' AS creation_datetime, TIMESTAMP '{AS_OF}' + INTERVAL '60' MINUTE AS valid_until "
          "FROM events")
def _append_session_key(spark, sf_dir):
    """SNK-5: new keys (one per event) with expiry, after the id mark."""
    fx = _fx(spark, sf_dir)
    table = fx.session_keys
    new = fx.base("events").select(
        "event_id", F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("session_key"))
    numbered = ids.assign_row_ids(new, ["event_id"], kth_largest(table, "id", 1, distinct=False))
    return table.unionByName(keys.new_key_rows(numbered, AS_OF))


# ---------------------------------------------------------------- stored tables (SRC-1…5, SNK-1…5, PG, GP, RT, SK)
# Every view's rows go through a stored table: two bulk runs (even groups, then odd ones) with the default retention.
def _stored(spark, sf_dir, kind):
    root = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}/{kind}"
    table = open_table(spark, root, kind)
    view = _fx(spark, sf_dir).view(TABLE_OF[kind]).withColumnsRenamed({"id": "_id", "group_id": "_group"})
    for run in (0, 1):
        table.append_run(view.where(F.col("_group") % 2 == run).drop("insertion_datetime"), run,
                         sample_key=["_group"], order=["_id"], insert_time=NEW_RUN_TIME)
    return table


def _stored_sql(kind: str, where: str = "TRUE", tail: str = "") -> str:
    view, own = TABLE_OF[kind], [c for c in kind_of(kind).columns if c not in ("id", "group_id", "insertion_datetime")]
    return (f"{with_clause(view)},\nnumbered AS (SELECT {', '.join(own)}, CAST(ROW_NUMBER() OVER (ORDER BY group_id % 2, group_id, id) AS INT) AS id, "
            f"CAST(DENSE_RANK() OVER (ORDER BY group_id % 2, group_id) AS INT) AS group_id FROM {view}),\n"
            "stored AS (SELECT * FROM numbered WHERE group_id > (SELECT MAX(group_id) FROM numbered) - 100),\n"
            "ranked AS (SELECT *, DENSE_RANK() OVER (ORDER BY group_id DESC) AS place FROM stored)\n"
            f"SELECT * EXCLUDE (place), TIMESTAMP '{NEW_RUN_TIME}' AS insertion_datetime FROM ranked WHERE {where} ORDER BY id DESC {tail}")


def _stored_entry(name: str, kind: str, form: dict, where: str = "TRUE", tail: str = "") -> None:
    register(name, _stored_sql(kind, where, tail))(lambda spark, sf_dir: stored_query(_stored(spark, sf_dir, kind), form))


for _kind in TABLE_OF:
    _stored_entry(f"stored_scan_{_kind}", _kind, {})
_stored_entry("stored_limit_rows", "cpu", {"limit": "25"}, tail="LIMIT 25")
_stored_entry("stored_page_rows", "file", {"limit": "40", "offset": "123"}, tail="LIMIT 40 OFFSET 123")
_stored_entry("stored_group_page", "file", {"limit_group": "30", "offset_group": "20"}, "place > 20 AND place <= 30")
_stored_entry("stored_group_then_row_page", "file", {"limit_group": "30", "limit": "20", "offset": "11"}, "place <= 30", "LIMIT 20 OFFSET 11")
_stored_entry("stored_filtered_page", "file", {"limit_group": "60", "file_used_max": "200", "limit": "50"},
              "place <= 60 AND used <= 200", "LIMIT 50")

_SAVED_AT, _SAVED_LATER, _ASKED_AT = "2024-01-15 12:00:00", "2024-01-15 12:30:00", "2024-01-15 13:15:00"
_STORED_KEYS_SQL = f"""{with_clause('session_keys')},
numbered AS (SELECT session_key, id % 2 AS run, CAST(ROW_NUMBER() OVER (ORDER BY id % 2, session_key) AS INT) AS place FROM session_keys),
stored AS (SELECT place AS id, session_key, CASE run WHEN 0 THEN TIMESTAMP '{_SAVED_AT}' ELSE TIMESTAMP '{_SAVED_LATER}' END AS creation_datetime
           FROM numbered WHERE run = 1 OR place > (SELECT MAX(place) FROM numbered WHERE run = 0) - 59),
kept AS (SELECT *, creation_datetime + INTERVAL '60' MINUTE AS valid_until FROM stored)
"""


def _stored_keys(spark, sf_dir):
    table = open_table(spark, f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}/keys", "session_keys")
    rows = _fx(spark, sf_dir).session_keys
    for run, at in ((0, _SAVED_AT), (1, _SAVED_LATER)):
        table.save(rows.where(F.col("id") % 2 == run).select("session_key"), at)
    return table


@register("stored_scan_session_keys", _STORED_KEYS_SQL + "SELECT * FROM kept")
def _stored_scan_keys(spark, sf_dir):
    return _stored_keys(spark, sf_dir).read()


@register("stored_keys_valid", _STORED_KEYS_SQL + f"SELECT * FROM ({_CANDIDATES_SQL}) c WHERE c.session_key IN "
          f"(SELECT session_key FROM kept WHERE valid_until > TIMESTAMP '{_ASKED_AT}')")
def _stored_keys_valid(spark, sf_dir):
    return _stored_keys(spark, sf_dir).valid(_candidates(_fx(spark, sf_dir)), _ASKED_AT)


@register("stored_keys_unseen", _STORED_KEYS_SQL + f"SELECT * FROM ({_CANDIDATES_SQL}) c WHERE c.session_key NOT IN (SELECT session_key FROM kept)")
def _stored_keys_unseen(spark, sf_dir):
    return _stored_keys(spark, sf_dir).unseen(_candidates(_fx(spark, sf_dir)))


# ---------------------------------------------------------------- ids, constraints, rendering
@register("assign_group_ids", f"{with_clause('raw_partition')}\nSELECT event_id, sample_id, "
          "CAST(1000 + DENSE_RANK() OVER (ORDER BY sample_id) AS INT) AS group_id FROM raw_partition")
def _assign_group_ids(spark, sf_dir):
    raw = _fx(spark, sf_dir).raw_partition.select("event_id", "sample_id")
    return ids.assign_group_ids(raw, ["sample_id"], 1000).select("event_id", "sample_id", "group_id")


@register("assign_row_ids", f"{with_clause('raw_partition')}\nSELECT CAST(5000 + ROW_NUMBER() OVER "
          "(ORDER BY event_id) AS INT) AS id, event_id, mountpoint FROM raw_partition")
def _assign_row_ids(spark, sf_dir):
    raw = _fx(spark, sf_dir).raw_partition.select("event_id", "mountpoint")
    return ids.assign_row_ids(raw, ["event_id"], 5000).select("id", "event_id", "mountpoint")


# CPU rows as read: some figures null, some names over 512 characters.
_VALIDATE_VIEWS = with_clause("raw_host", "info_cpu") + """,
cpu_rows AS (SELECT c.id, CASE WHEN c.id % 7 = 0 THEN REPEAT(c.name, 200) ELSE c.name END AS name,
  c.physical_cores, CASE WHEN c.id % 11 = 0 THEN NULL ELSE c.logical_cores END AS logical_cores, h.utilization,
  c.current_speed_mhz, c.base_speed_mhz, c.processes_amount, c.threads_amount, c.handles_amount, h.uptime_s AS uptime
  FROM info_cpu AS c JOIN raw_host AS h ON h.sample_id = c.id WHERE h.cpu_ok)"""


@register("validate_cpu", f"{_VALIDATE_VIEWS}\nSELECT id, NOT (LENGTH(name) <= 512 AND logical_cores IS NOT NULL "
          "AND utilization IS NOT NULL AND uptime IS NOT NULL) AS rejected FROM cpu_rows")
def _validate_cpu(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    text = _VALIDATE_VIEWS.replace("FROM events", "FROM {events}").replace("FROM orders", "FROM {orders}")
    rows = spark.sql(f"{text} SELECT * FROM cpu_rows", events=fx.base("events"), orders=fx.base("orders"))
    ok, bad = validate.split_valid(rows, "cpu")
    return (ok.select("id", F.lit(False).alias("rejected"))
            .unionByName(bad.select("id", F.lit(True).alias("rejected"))))


_RFC = ("REGEXP_REPLACE(STRFTIME({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'")


@register("rfc3339_ts", f"SELECT event_id, {_RFC.format(c='ts')} AS ts FROM events")
def _rfc3339(spark, sf_dir):
    ev = _fx(spark, sf_dir).base("events").select("event_id", "ts")
    return render_timestamps(ev)


def _json_oracle(kind: str) -> str:
    from ..schemas import KINDS
    view = TABLE_OF[kind]
    fields = []
    for f in KINDS[kind].schema.fields:
        expr = _RFC.format(c=f.name) if f.name == "insertion_datetime" else f.name
        fields.append(f"'{f.name}': {expr}")
    return f"{with_clause(view)}\nSELECT id, CAST(TO_JSON({{{', '.join(fields)}}}) AS VARCHAR) AS json FROM {view}"


for _kind, _view in TABLE_OF.items():
    def _mkj(kind=_kind, view=_view):
        def build(spark, sf_dir):
            return json_rows(_fx(spark, sf_dir).view(view), kind)
        return build
    register(f"json_{_kind}", _json_oracle(_kind))(_mkj())


# ---------------------------------------------------------------- collection interval (ST-1, batch)
@register("snapshot_every_30s",
          "SELECT MAKE_TIMESTAMP(CAST(FLOOR(EPOCH_US(ts) / 30000000) AS BIGINT) * 30000000) AS window_start, "
          "ARG_MAX(event_id, ts) AS sample_id, ARG_MAX(value, ts) AS utilization, MAX(ts) AS sample_ts "
          "FROM events GROUP BY 1")
def _snapshot_every_30s(spark, sf_dir):
    ev = _fx(spark, sf_dir).base("events")
    return latest_per_interval(ev.select(F.col("event_id").alias("sample_id"),
                                         F.col("value").alias("utilization"), "ts"),
                               "ts", "30 seconds").select("window_start", "sample_id", "utilization", "sample_ts")


@register("disk_every_2h", f"{with_clause('raw_usage')},\n"
          "read AS (SELECT *, MAKE_TIMESTAMP(CAST(FLOOR(EPOCH_US(ts) / 7200000000) AS BIGINT) * 7200000000) AS window_start "
          "FROM raw_usage),\nnewest AS (SELECT window_start, ARG_MAX(sample_id, ts) AS sample_id, MAX(ts) AS sample_ts "
          "FROM read GROUP BY window_start)\n"
          "SELECT r.window_start, r.event_id, r.sample_id, r.mountpoint, r.usage_ok, r.total, r.used, r.free, r.used_percent, "
          "n.sample_ts FROM read AS r JOIN newest AS n ON n.window_start = r.window_start AND n.sample_id = r.sample_id")
def _disk_every_2h(spark, sf_dir):
    """Whole runs: all partitions of the newest sample of each interval."""
    return latest_per_interval(_fx(spark, sf_dir).raw_usage, "ts", "2 hours", sample_col="sample_id")


def queries() -> dict[str, Builder]:
    return {k: e.build for k, e in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.oracle for k, e in CATALOG.items() if e.oracle is not None}
