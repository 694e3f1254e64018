import datetime as dt

import pytest
from pyspark.sql import functions as F

from hostshelf.operators import ids, keys, retention, snapshots, validate
from hostshelf.schemas import CPU
from hostshelf.sources.fixtures import Fixtures

from conftest import SF001


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF001)


def test_retention_keeps_newest_groups(fx):
    kept = retention.prune_before_insert(fx.info_file, 10)
    groups = sorted({r.group_id for r in kept.select("group_id").distinct().collect()})
    allg = sorted({r.group_id for r in fx.info_file.select("group_id").distinct().collect()})
    assert groups == allg[-9:]
    assert retention.prune_before_insert(fx.info_file, 1).count() == 0


def test_append_and_retain_prunes_even_for_empty_run(fx):
    empty = fx.info_file.where(F.lit(False))
    out = retention.append_and_retain(fx.info_file, empty, 3)
    assert out.select("group_id").distinct().count() == 2


def test_session_key_rules(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    table = spark.createDataFrame(
        [(1, "a", t("2024-01-01 00:00:00"), t("2024-01-01 01:00:00")),
         (2, "b", t("2024-01-01 00:30:00"), t("2024-01-01 01:30:00")),
         (3, "c", t("2024-01-01 00:59:00"), t("2024-01-01 02:00:00"))],
        "id int, session_key string, creation_datetime timestamp_ntz, valid_until timestamp_ntz")
    presented = spark.createDataFrame([("a",), ("b",), ("z",)], "session_key string")
    # valid: strictly later than now; a key expiring exactly now is invalid ...
    now = "2024-01-01 01:30:00"
    assert sorted(r[0] for r in keys.keys_valid(presented, table, now).collect()) == []
    assert sorted(r[0] for r in keys.keys_valid(presented, table, "2024-01-01 01:29:59").collect()) == ["b"]
    # ... but not yet deleted by retention (deleted only when valid_until < now)
    kept = retention.retain_session_keys(table, now, 10)
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    # rank counts expired keys too: newest max-1 = 1 key by id
    assert [r.id for r in retention.retain_session_keys(table, "2024-01-01 00:00:00", 2).collect()] == [3]
    assert sorted(r[0] for r in keys.keys_unseen(presented, table).collect()) == ["z"]


def test_session_key_save_sets_expiry(spark):
    table = spark.createDataFrame([], "id int, session_key string, creation_datetime timestamp_ntz, valid_until timestamp_ntz")
    new = spark.createDataFrame([(1, "k")], "id int, session_key string")
    r = keys.session_key_save(table, new, "2024-05-01 10:00:00").collect()[0]
    assert r.valid_until - r.creation_datetime == dt.timedelta(minutes=60)


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k")).repartition(7)
    out = ids.assign_row_ids(df, ["k"], 100).collect()
    got = sorted((r.k, r.id) for r in out)
    assert [i for _, i in got] == list(range(101, 5101))


def test_group_ids_one_per_sample(spark):
    df = spark.createDataFrame([(s, i) for s in (5, 9, 2) for i in range(3)], "sample_id long, i int")
    out = ids.assign_group_ids(df, ["sample_id"], 40).collect()
    assert {(r.sample_id, r.group_id) for r in out} == {(2, 41), (5, 42), (9, 43)}


def test_validate_splits_and_strict_mode_raises(spark):
    figures = ", ".join(f"{c} double" for c in CPU.names[3:-1])
    rest = (1.0,) * len(CPU.names[3:-1])
    df = spark.createDataFrame([(1, "x" * 513, *rest), (2, "x" * 512, *rest), (3, None, *rest)], f"id int, name string, {figures}")
    ok, bad = validate.split_valid(df, "cpu")
    assert [r.id for r in ok.collect()] == [2] and bad.count() == 2
    with pytest.raises(ValueError, match="uptime"):  # a NOT NULL column that is not there
        validate.split_valid(df.drop("uptime"), "cpu")
    whole = df.selectExpr("*", "1 AS group_id", "current_timestamp() AS insertion_datetime")
    assert validate.require_valid(whole.where("id = 2"), "cpu").count() == 1
    with pytest.raises(Exception, match="constraint violated"):
        validate.require_valid(whole, "cpu").collect()
    with pytest.raises(ValueError):
        validate.require_valid(df, "cpu")


def test_cpu_snapshot_drops_unreadable_and_defaults(spark):
    host = spark.createDataFrame([(1, 10, [5.0, 9.0], True), (2, None, [], True), (3, 1, [1.0], False), (4, 1, None, True)],
                                 "sample_id long, uptime_s long, utilization array<double>, cpu_ok boolean")
    cores = spark.createDataFrame([(1, 2, 0, 1, 1, "B", 3000.0), (1, 1, 1, 9, 9, "A", 1000.0)],
                                  "sample_id long, core_no int, phys_core int, tie1 long, tie2 long, model_name string, mhz double")
    procs = spark.createDataFrame([(1, 10, 4, None), (1, 11, 6, 3)], "sample_id long, pid long, num_threads int, num_fds int")
    out = {r.sample_id: r for r in snapshots.cpu_snapshot(host, cores, procs).collect()}
    assert set(out) == {1, 2, 4} and out[1].utilization == 5.0 and out[4].utilization == 0.0
    a, b = out[1], out[2]
    assert (a.name, a.base_speed_mhz, a.current_speed_mhz, a.physical_cores, a.logical_cores) == ("A", 1000.0, 2000.0, 2, 2)
    assert (a.processes_amount, a.threads_amount, a.handles_amount, a.uptime) == (2, 10, 3, 10 * 10**9)
    assert (b.name, b.physical_cores, b.utilization, b.uptime, b.processes_amount) == ("", 0, 0.0, 0, 0)


def test_network_samples_without_interfaces_or_unreadable_parts(spark):
    host = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, True), (4, True, False)],
                                 "sample_id long, net_ok boolean, conn_ok boolean")
    ifaces = spark.createDataFrame([(s, *[n] * 6) for s, n in ((1, 5), (1, 7), (3, 1), (4, 1))],
                                   "sample_id long, " + ", ".join(f"{c} long" for c in snapshots.NET_COUNTERS))
    conns = spark.createDataFrame([(1, "tcp"), (1, "udp"), (4, "tcp")], "sample_id long, kind string")
    out = {r.sample_id: r for r in snapshots.net_snapshot(host, ifaces, conns).collect()}
    assert set(out) == {1, 2}
    assert (out[1].bytes_sent, out[1].err_out, out[1].connections) == (12, 12, 2)
    assert (out[2].bytes_sent, out[2].err_out, out[2].connections) == (0, 0, 0)


def test_unreadable_memory_and_partition_lists_drop_the_sample(spark):
    memory = spark.createDataFrame([(1, True, 9), (2, False, None)], "sample_id long, mem_ok boolean, total_b long").selectExpr(
        "*", "total_b AS used_b", "total_b AS free_b", "total_b AS committed_as", "total_b AS cached_b")
    assert [r.sample_id for r in snapshots.ram_project(memory).collect()] == [1]
    parts = spark.createDataFrame([(1, True, True, "/a"), (1, True, False, "/b"), (2, False, True, "/c")],
                                  "sample_id long, parts_ok boolean, usage_ok boolean, mountpoint string").selectExpr(
        "*", "1 AS event_id", "10 AS total", "4 AS used", "6 AS free", "40.0 AS used_percent")
    assert [tuple(r) for r in snapshots.file_project(parts).collect()] == [(1, 1, "/a", 10, 4, 6, 40.0)]
