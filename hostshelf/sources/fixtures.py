"""Snapshot tables and raw-sample tables derived from the shared test data.

The store's own tables do not exist in the test data, so each one is a view
over `events`, `orders` or `lineitem`. One SQL text per view runs unchanged in
Spark SQL (DataFrames bound through ``spark.sql(text, name=df)``) and in
DuckDB (plain view names), so the DuckDB oracle and the Spark query read
identical inputs. Work grows with the base tables: every view is a scan,
a projection or one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Base tables each view reads (before view-on-view dependencies).
BASE_TABLES = ("events", "orders", "lineitem")
# Their columns; nothing is inferred.
BASE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}

_VIEWS: dict[str, str] = {
    "info_cpu": """
SELECT CAST(event_id + 1 AS INT) AS id, CAST(event_id + 1 AS INT) AS group_id, event_type AS name,
  CAST(user_id % 8 + 1 AS INT) AS physical_cores, CAST((user_id % 8 + 1) * 2 AS INT) AS logical_cores,
  value AS utilization, CAST(2000 AS DOUBLE) + value AS current_speed_mhz,
  CAST(3000 + user_id % 5 * 100 AS DOUBLE) AS base_speed_mhz,
  CAST(100 + event_id % 200 AS INT) AS processes_amount, CAST(1000 + event_id % 3000 AS INT) AS threads_amount,
  CAST(5000 + event_id % 7000 AS INT) AS handles_amount, (event_id + 1) * 30000000000 AS uptime,
  ts AS insertion_datetime FROM {events}""",
    "info_ram": """
SELECT CAST(o_orderkey + 1 AS INT) AS id, CAST(o_orderkey + 1 AS INT) AS group_id,
  16000000000 + o_custkey % 5 * 1000000000 AS total, CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS used,
  16000000000 - CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS free,
  CAST(FLOOR(o_totalprice * 500) AS BIGINT) AS commited, o_custkey * 1000000 AS cached,
  o_orderdate AS insertion_datetime FROM {orders}""",
    "raw_iface": """
SELECT l_orderkey AS sample_id, l_linenumber AS iface_no, CAST(FLOOR(l_extendedprice) AS BIGINT) AS bytes_sent,
  CAST(FLOOR(l_extendedprice / 2) AS BIGINT) AS bytes_recv, CAST(FLOOR(l_quantity) AS BIGINT) AS packets_sent,
  CAST(FLOOR(l_quantity * 2) AS BIGINT) AS packets_recv,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS err_in,
  CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS err_out, l_shipdate AS sample_ts FROM {lineitem}""",
    "info_net": """
SELECT CAST(sample_id + 1 AS INT) AS id, CAST(sample_id + 1 AS INT) AS group_id,
  CAST(SUM(bytes_sent) AS BIGINT) AS bytes_sent, CAST(SUM(bytes_recv) AS BIGINT) AS bytes_recv,
  CAST(SUM(packets_sent) AS BIGINT) AS packets_sent, CAST(SUM(packets_recv) AS BIGINT) AS packets_recv,
  CAST(SUM(err_in) AS BIGINT) AS err_in, CAST(SUM(err_out) AS BIGINT) AS err_out,
  CAST(COUNT(*) AS INT) AS connections, MAX(sample_ts) AS insertion_datetime FROM {raw_iface} GROUP BY sample_id""",
    "info_file": """
SELECT CAST(event_id + 1 AS INT) AS id, CAST(FLOOR(event_id / 8) AS INT) + 1 AS group_id,
  CONCAT('/', event_type, '/', CAST(user_id % 10 AS VARCHAR(10))) AS path, CAST(100000 + user_id % 3 * 50000 AS BIGINT) AS total,
  CAST(FLOOR(value) AS BIGINT) AS used, 100000 - CAST(FLOOR(value) AS BIGINT) AS free,
  value / 1000 AS used_percent, ts AS insertion_datetime FROM {events}""",
    "session_keys": """
SELECT CAST(event_id + 1 AS INT) AS id, CONCAT(event_type, '-', CAST(event_id AS VARCHAR(20))) AS session_key,
  ts AS creation_datetime, ts + INTERVAL '60' MINUTE AS valid_until FROM {events}""",
    "raw_process": """
SELECT l_orderkey AS sample_id, l_partkey AS pid, l_linenumber AS num_threads,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(FLOOR(l_quantity) AS INT) END AS num_fds FROM {lineitem}""",
    "raw_core": """
SELECT l_orderkey AS sample_id, l_linenumber AS core_no, l_linenumber % 4 AS phys_core, l_partkey AS tie1,
  l_suppkey AS tie2, l_returnflag AS model_name, l_extendedprice AS mhz FROM {lineitem}""",
    "raw_host": """
SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS uptime_s,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice / 10000 END AS utilization,
  o_orderpriority <> '1-URGENT' AS cpu_ok FROM {orders}""",
    "raw_memory": """
SELECT o_orderkey AS sample_id, CAST(16000000000 AS BIGINT) AS total_b, CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS used_b,
  16000000000 - CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS free_b,
  CAST(FLOOR(o_totalprice * 500) AS BIGINT) AS committed_as, o_custkey * 1000000 AS cached_b FROM {orders}""",
    "raw_net_host": """
SELECT o_orderkey AS sample_id, o_orderpriority <> '2-HIGH' AS net_ok, o_orderpriority <> '3-MEDIUM' AS conn_ok
  FROM {orders}""",
    "raw_memory_read": """
SELECT o_orderkey AS sample_id, o_orderstatus <> 'P' AS mem_ok, 16000000000 + o_custkey % 5 * 1000000000 AS total_b,
  CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS used_b, 16000000000 - CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS free_b,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(FLOOR(o_totalprice * 500) AS BIGINT) END AS committed_as,
  o_custkey * 1000000 AS cached_b FROM {orders}""",
    "raw_usage": """
SELECT event_id, CAST(FLOOR(event_id / 8) AS BIGINT) AS sample_id, CONCAT('/', event_type) AS mountpoint,
  event_type <> 'error' AS usage_ok, CAST(100000 + user_id % 3 * 50000 AS BIGINT) AS total,
  CAST(FLOOR(value) AS BIGINT) AS used, 100000 + user_id % 3 * 50000 - CAST(FLOOR(value) AS BIGINT) AS free,
  value / 1000 AS used_percent, ts FROM {events}""",
    "raw_connection": """
SELECT CAST(FLOOR(event_id / 8) AS BIGINT) AS sample_id, event_type AS kind, user_id AS peer FROM {events}""",
    "raw_partition": """
SELECT event_id, CAST(FLOOR(event_id / 8) AS BIGINT) AS sample_id, CONCAT('/', event_type) AS mountpoint,
  event_type <> 'error' AS usage_ok, value FROM {events}""",
}

# Which view each view reads (order matters only for view-on-view use).
_DEPENDS = {name: ("raw_iface" if name == "info_net" else
                   "events" if "{events}" in text else
                   "orders" if "{orders}" in text else "lineitem")
            for name, text in _VIEWS.items()}

VIEW_NAMES = tuple(_VIEWS)


def view_sql(name: str) -> str:
    """The view text with plain table names (DuckDB / SQL-engine form)."""
    return _VIEWS[name].format(events="events", orders="orders", lineitem="lineitem",
                               raw_iface="raw_iface").strip()


def with_clause(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the given views, dependencies first."""
    order: list[str] = []
    for n in names:
        dep = _DEPENDS[n]
        if dep in _VIEWS and dep not in order:
            order.append(dep)
        if n not in order:
            order.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({view_sql(n)})" for n in order)


class Fixtures:
    """Lazily built fixture DataFrames for one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        key = "base:" + table
        if key not in self._cache:
            self._cache[key] = self.spark.read.schema(BASE_SCHEMAS[table]).parquet(f"{self.sf_dir}/{table}.parquet")
        return self._cache[key]

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            dep = _DEPENDS[name]
            src = self.view(dep) if dep in _VIEWS else self.base(dep)
            self._cache[name] = self.spark.sql(_VIEWS[name], **{dep: src})
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in _VIEWS:
            return self.view(name)
        raise AttributeError(name)
