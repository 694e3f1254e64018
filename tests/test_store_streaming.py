import re
import time

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostshelf.operators import append, ids
from hostshelf.schemas import SESSION_KEYS
from hostshelf.session import checkpoint_dir
from hostshelf.sinks.store import KeyTable, SnapshotTable, TableState, open_table
from hostshelf.sources.tables import read_session_keys, read_table
from hostshelf.streaming import pipelines
from hostshelf.streaming.collect import backfill_then_live, latest_per_interval, snapshot_writer, start_collector, supervised

from conftest import SF001

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                       T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _ram_rows(spark, n0, n1):
    return spark.range(n0, n1).select(
        F.lit(16000).cast("long").alias("total"), (F.col("id") * 10).alias("used"),
        (16000 - F.col("id") * 10).alias("free"), F.lit(5).cast("long").alias("commited"),
        F.lit(7).cast("long").alias("cached"))


def _event_stream(spark):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(SF001)


# ------------------------------------------------------------------ store
def test_store_append_retain_and_replay(spark, scratch):
    t = SnapshotTable(spark, f"{scratch}/ram", "ram", max_groups=3, bucket_size=2)
    assert t.create_if_absent() and not t.create_if_absent()
    assert t.read().count() == 0
    for b in range(5):
        assert t.append_run(_ram_rows(spark, b, b + 1), batch_id=b, insert_time="2024-01-01 00:00:00")
    df = t.read()
    assert sorted(r.group_id for r in df.collect()) == [3, 4, 5]
    assert sorted(r.id for r in df.collect()) == [3, 4, 5]
    # replay of a committed batch adds nothing
    assert not t.append_run(_ram_rows(spark, 0, 1), batch_id=4)
    assert t.read().count() == 3
    st = t.state()
    assert (st.version, st.group_mark, st.id_mark, st.cutoff) == (5, 5, 5, 3)


def test_writers_are_told_apart_and_an_older_batch_is_an_error(spark, scratch):
    t = open_table(spark, f"{scratch}/ram", "ram")
    assert t.append_run(_ram_rows(spark, 0, 1), batch_id=3, writer="a")
    assert t.append_run(_ram_rows(spark, 1, 2), batch_id=0, writer="b")  # not a replay: another writer
    assert not t.append_run(_ram_rows(spark, 1, 2), batch_id=0, writer="b")
    with pytest.raises(ValueError):
        t.append_run(_ram_rows(spark, 2, 3), batch_id=2, writer="a")
    assert t.read().count() == 2


def test_readers_see_neither_pruned_nor_uncommitted_rows(spark, scratch):
    t = open_table(spark, f"{scratch}/ram", "ram", max_groups=2)
    for b in range(4):
        t.append_run(_ram_rows(spark, b, b + 1), batch_id=b)
    _ram_rows(spark, 0, 9).write.parquet(f"{scratch}/ram/data/left-by-a-failed-job")
    assert sorted(r.group_id for r in read_table(spark, "ram", f"{scratch}/ram").collect()) == [3, 4]


def test_two_writers_meet(spark, scratch):
    a = open_table(spark, f"{scratch}/ram", "ram")
    st = a.state()
    assert a._commit(TableState(version=st.version + 1, group_mark=7, id_mark=70))
    assert not a._commit(TableState(version=st.version + 1, group_mark=1, id_mark=1))  # taken, not overwritten
    assert a.append_run(_ram_rows(spark, 0, 2), batch_id=0)
    assert sorted((r.group_id, r.id) for r in a.read().collect()) == [(8, 71), (8, 72)]


def test_vacuum_bounds_the_folders(spark, scratch):
    t = open_table(spark, f"{scratch}/ram", "ram", max_groups=2)
    for b in range(7):
        t.append_run(_ram_rows(spark, b, b + 1), batch_id=b)
    assert len(t.state().folders) == 2
    assert t.vacuum(min_age_seconds=3600) == 0  # all are young
    assert t.vacuum(keep_versions=1, min_age_seconds=0) == 5
    assert len(t._list("data")) == 2 and len(t._list("_log")) == 1
    assert sorted(r.group_id for r in t.read().collect()) == [6, 7]
    assert t.append_run(_ram_rows(spark, 8, 9), batch_id=7) and not t.append_run(_ram_rows(spark, 8, 9), batch_id=7)


def test_store_multi_row_groups_and_empty_staging(spark, scratch):
    t = SnapshotTable(spark, f"{scratch}/file", "file", max_groups=2)
    rows = spark.createDataFrame([(s, f"/m{i}", 100, 10 * i, 100 - 10 * i, 0.1 * i)
                                  for s in (1, 2, 3) for i in range(3)],
                                 "sample_id long, path string, total long, used long, free long, used_percent double")
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = lambda: {s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("staged-")}
    before = staged()
    assert t.append_run(rows, batch_id=0, sample_key=["sample_id"], order=["path"], insert_time="2024-01-01")
    df = t.read()
    # three groups drawn in one run; only the newest max_groups stay
    assert sorted({r.group_id for r in df.collect()}) == [2, 3]
    assert sorted(r.id for r in df.collect()) == list(range(4, 10))
    assert t.append_run(rows.where("sample_id = 1"), batch_id=1, sample_key=["sample_id"], order=["path"],
                        insert_time="2024-01-02")
    assert sorted({r.group_id for r in t.read().collect()}) == [3, 4]
    assert staged() == before  # nothing is left behind


def test_a_bad_row_fails_the_append(spark, scratch):
    t = open_table(spark, f"{scratch}/ram", "ram")
    bad = _ram_rows(spark, 0, 2).withColumn("used", F.lit(None).cast("long"))
    with pytest.raises(Exception, match="constraint violated"):
        t.append_run(bad, batch_id=0)
    with pytest.raises((ValueError, AnalysisException)):
        t.append_run(_ram_rows(spark, 0, 2).drop("used"), batch_id=0)
    assert t.read().count() == 0


# ------------------------------------------------------------------ ids
@pytest.mark.parametrize("n", [1, 500])
def test_ids_over_partitions_with_null_keys_and_a_hot_key(spark, n):
    rows = [(None if i % 10 == 0 else i % 4 if i < n // 2 else 2, i) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ids.numbered(df, ["k"], ["v"])
        out = got.rows.collect()
        spread = got.rows.where("k = 2").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = sorted({r[0] for r in rows}, key=lambda k: (k is not None, k or 0))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted((r.row_no, r.key_no, r.k, r.v) for r in out if r.k is not None) == [
        (i, keys.index(k), k, v) for i, (k, v) in enumerate(order) if k is not None]
    assert len(out) == n == got.n_rows and got.n_keys == len(keys)
    assert n == 1 or spread > 1
    got.discard()


def test_null_sample_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    assert {r.v: r.group_id for r in ids.assign_group_ids(df, ["k"], 10).collect()} == {"b": 11, "a": 12, "c": 13}


def test_ids_beyond_the_column_raise(spark):
    df = spark.range(3).select(F.col("id").alias("v"))
    with pytest.raises(Exception, match="does not fit"):
        ids.assign_row_ids(df, ["v"], 2 ** 31 - 2).collect()
    assert ids.sequence(df, ["v"], "n", 2 ** 31).agg(F.max("n")).first()[0] == 2 ** 31 + 2


def test_insert_time_is_the_store_clock_without_a_value(spark):
    r = spark.range(1).select(append.insert_time().alias("t"), F.current_timestamp().cast("timestamp_ntz").alias("now")).first()
    assert r.t == r.now


# ------------------------------------------------------------------ session keys
def test_key_table_prunes_and_inserts_in_one_commit(spark, scratch):
    t = open_table(spark, f"{scratch}/keys", "session_keys", max_keys=3, lifetime_minutes=60)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "session_key string")
    for i in range(5):
        t.save(keys(f"k{i}"), f"2024-01-01 00:0{i}:00")
    assert [(r.id, r.session_key) for r in t.read().orderBy("id").collect()] == [(3, "k2"), (4, "k3"), (5, "k4")]
    t.save(keys("late"), "2024-01-01 01:03:30")  # k2 and k3 are over
    assert [(r.id, r.session_key) for r in read_session_keys(spark, f"{scratch}/keys").orderBy("id").collect()] == [(5, "k4"), (6, "late")]
    assert t.read().columns == SESSION_KEYS.names
    t.save(keys("x", "y"), "2024-01-02 00:00:00")  # all others are over; ids are never drawn again
    assert sorted((r.id, r.session_key) for r in t.read().collect()) == [(7, "x"), (8, "y")]
    assert t.vacuum(keep_versions=1, min_age_seconds=0) > 0 and t.read().count() == 2
    with pytest.raises(Exception, match="constraint violated"):
        t.save(keys("z" * 513), "2024-01-02 00:00:00")


def test_open_creates_all_five_tables(spark, scratch):
    for kind in ("cpu", "ram", "net", "file", "session_keys"):
        t = open_table(spark, f"{scratch}/{kind}", kind)
        assert t.read().columns == t.schema.names and t.read().count() == 0
        assert not open_table(spark, f"{scratch}/{kind}", kind).create_if_absent()


# ------------------------------------------------------------------ streams
def test_whole_runs_per_interval(spark):
    rows = [("10:00:01", 1, "/a"), ("10:00:01", 1, "/b"), ("10:00:20", 2, "/a"), ("10:00:20", 2, "/b"), ("10:00:20", 2, "/c"),
            ("10:00:31", 3, "/a"), ("10:00:31", 4, "/z"), ("10:00:31", 4, "/y")]
    df = spark.createDataFrame([(f"2024-01-01 {t}", s, p) for t, s, p in rows], "t string, sample_id int, path string")
    df = df.select(F.col("t").cast("timestamp").alias("ts"), "sample_id", "path")
    got = latest_per_interval(df, "ts", "30 seconds", sample_col="sample_id").collect()
    assert sorted((r.window_start.second, r.sample_id, r.path) for r in got) == [
        (0, 2, "/a"), (0, 2, "/b"), (0, 2, "/c"), (30, 4, "/y"), (30, 4, "/z")]
    assert "SortAggregate" not in latest_per_interval(df, "ts")._jdf.queryExecution().executedPlan().toString()


def test_a_crowded_interval_is_never_one_array(spark):
    """A third of the rows in one interval: same rows as by hand, and no row is collected."""
    ids = F.col("id").cast("int")
    df = spark.range(3000).select(
        F.timestamp_seconds(F.lit(1704103200) + F.when(ids % 3 == 0, ids % 30).otherwise(30 * (ids % 50) + ids % 7)).alias("ts"),
        F.when(ids % 11 > 0, ids % 4).alias("sample_id"), F.when(ids % 5 > 0, ids % 2).alias("host"), ids.alias("row"))
    rows = df.collect()
    for keys in ((), ("host",)):
        group = lambda r: (int(r.ts.timestamp()) // 30, *(r[k] for k in keys))  # noqa: B023, E731
        rank = lambda r: (r.ts, r.sample_id is not None, r.sample_id or 0)
        best = {}
        for r in rows:
            best[group(r)] = max(best.get(group(r), rank(r)), rank(r))
        whole = latest_per_interval(df, "ts", "30 seconds", sample_col="sample_id", keys=keys)
        want = sorted(r.row for r in rows if rank(r)[1:] == best[group(r)][1:])
        assert whole.columns == ["window_start", *keys, *[c for c in ("sample_id", "host", "row") if c not in keys], "sample_ts"]
        assert sorted(r.row for r in whole.collect()) == want
        last = latest_per_interval(df, "ts", "30 seconds", keys=keys)
        top = {}
        for r in rows:
            key = (*rank(r), r.host is not None, r.host or 0, r.row)
            top[group(r)] = max(top.get(group(r), key), key)
        assert sorted(r.row for r in last.collect()) == sorted(k[-1] for k in top.values())
        for got in (whole, last):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan and set(re.findall(r"collect_list\((.)", plan)) == {"n"}  # of null only


def _samples(spark, per_interval):
    """Rows of six intervals: the second holds `per_interval` of them, most in its newest sample; hosts and samples may be null."""
    i = F.col("id")
    crowd = spark.range(per_interval).select(
        F.timestamp_seconds(F.lit(1704103230) + F.when(i % 5 > 0, 29).otherwise(i % 29)).alias("ts"),
        F.when(i % 5 > 0, 7).otherwise(i % 4).cast("int").alias("sample_id"), F.lit(1).alias("host"), i.alias("row"))
    rest = spark.range(600).select(
        F.timestamp_seconds(F.lit(1704103200) + i % 180).alias("ts"), F.when(i % 11 > 0, i % 4).cast("int").alias("sample_id"),
        F.when(i % 5 > 0, i % 2).cast("int").alias("host"), (i + 10_000_000).alias("row"))
    return crowd.unionByName(rest)


def _closed(spark, df, folder, batches=1):
    """`df` as a stream of files, the last of them two rows that move the watermark past every interval but their own."""
    for n in range(batches):
        df.where(F.floor(F.unix_timestamp("ts") / 60) % batches == n).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    spark.createDataFrame([(1704110000, 1, 1, -1)], "s long, sample_id int, host int, row long").select(
        F.timestamp_seconds("s").alias("ts"), "sample_id", "host", "row").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("keys,rows,batches", [((), 1_000_000, 1), (("host",), 3000, 3)])
def test_whole_runs_in_a_stream_equal_the_batch(spark, scratch, keys, rows, batches):
    """A million rows in one interval: the same rows as the batch, one state row per row, no interval in one row."""
    df = _samples(spark, rows)
    stream = _closed(spark, df, f"{scratch}/in{rows}", batches)
    got = latest_per_interval(stream, "ts", "30 seconds", "10 minutes", "sample_id", keys)
    assert "collect_list(value" not in got._jdf.queryExecution().toString()
    kept = []
    q = (got.writeStream.outputMode("append").option("checkpointLocation", f"{scratch}/ck{rows}").trigger(availableNow=True)
         .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{scratch}/out{rows}/n={n}")).start())
    q.awaitTermination(300)
    for p in q.recentProgress:
        kept.append([o["numRowsTotal"] for o in p["stateOperators"]])
    whole = latest_per_interval(df, "ts", "30 seconds", sample_col="sample_id", keys=keys)
    out = spark.read.parquet(f"{scratch}/out{rows}").select(whole.columns)
    assert out.count() == whole.count() > rows // 2
    assert out.exceptAll(whole).count() == 0 and whole.exceptAll(out).count() == 0
    assert all(len(k) == 2 for k in kept) and rows <= max(max(k) for k in kept) <= rows + 601
    assert max(kept[-1]) <= 1 + 1  # closed intervals leave the state


def test_stream_equals_batch(spark, scratch):
    stream = latest_per_interval(_event_stream(spark).select("event_id", "value", "ts"), "ts", "30 seconds")
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("every30")
         .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM every30")
    batch = latest_per_interval(spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "value", "ts"),
                                "ts", "30 seconds")
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


def _messages(events, kind):
    """Messages of a metric made of the events: some samples are unreadable, some lists are empty."""
    e, v = F.col("event_id"), F.floor("value").cast("decimal(20,0)")
    base = [e.alias("sample_id"), F.col("ts").cast("timestamp").alias("ts")]
    n = F.sequence(F.lit(1), (e % 3 + 1).cast("int"))
    parts = {
        "cpu": [(e % 7 != 0).alias("cpu_ok"), F.slice(F.array("value", F.lit(1.0)), F.lit(1), (e % 3).cast("int")).alias("utilization"),
                F.when(e % 5 != 0, e).alias("uptime_s"),
                F.transform(n, lambda i: F.struct(i.alias("core_no"), (i % 2).alias("phys_core"), F.col("event_type").alias("model_name"),
                                                  (F.col("value") + i).alias("mhz"))).alias("cores"),
                F.transform(n, lambda i: F.struct(i.alias("num_threads"), F.when(i > 1, i).alias("num_fds"))).alias("procs")],
        "ram": [(e % 7 != 0).alias("mem_ok"), *[F.when(e % 7 != 0, v).alias(c) for c in ("total_b", "used_b", "free_b", "committed_as", "cached_b")]],
        "net": [(e % 7 != 0).alias("net_ok"), (e % 5 != 0).alias("conn_ok"),
                F.when(e % 4 == 0, F.array().cast("array<struct<" + pipelines._COUNTERS + ">>")).otherwise(F.transform(
                    n, lambda i: F.struct(*[(v + i).cast("decimal(20,0)").alias(c) for c in pipelines.snapshots.NET_COUNTERS]))).alias("ifaces"),
                F.when(e % 2 == 0, F.array(F.lit("tcp"), F.lit("udp"))).otherwise(F.array().cast("array<string>")).alias("connections")],
        "file": [(e % 7 != 0).alias("parts_ok"), F.transform(n, lambda i: F.struct(
            F.concat(F.lit("/m"), i).alias("mountpoint"), (i != 2).alias("usage_ok"), (v + 10).cast("decimal(20,0)").alias("total"),
            v.alias("used"), F.lit(10).cast("decimal(20,0)").alias("free"), F.lit(0.5).alias("used_percent"))).alias("partitions")],
    }
    return events.select(*base, *parts[kind])


@pytest.mark.parametrize("kind", ["cpu", "ram", "net", "file"])
def test_collector_from_messages_to_store_equals_the_batch(spark, scratch, kind):
    table = open_table(spark, f"{scratch}/{kind}", kind, max_groups=100_000)
    stream = _messages(_event_stream(spark), kind)
    run = lambda: pipelines.start(kind, stream, table, f"{scratch}/ck", interval_seconds=600, live=False,
                                  insert_time="2024-02-01 00:00:00").awaitTermination(300)
    run()
    batch = pipelines.per_interval(_messages(spark.read.parquet(f"{SF001}/events.parquet"), kind), 600)
    last = batch.agg(F.max("window_start")).first()[0]
    closed = batch.where(F.col("window_start") < F.lit(last))  # the newest interval is still open behind the watermark
    want = pipelines.ROWS[kind](closed)
    figures = [c for c in table.schema.names if c not in ("id", "group_id", "insertion_datetime")]
    got = table.read()
    assert got.count() == want.count() > 100
    assert got.select(*figures).exceptAll(want.select(*figures)).count() == 0
    assert got.select("group_id").distinct().count() == want.select("sample_id").distinct().count()
    version = table.state().version
    run()  # restart on the same checkpoint: no new batch, nothing appended
    assert table.state().version == version


def test_backfill_then_live_stops_a_slow_backfill(spark, scratch):
    """Whatever the backfill had done when it was stopped, all closed intervals are there once the live query has gone on."""
    events = spark.read.parquet(f"{SF001}/events.parquet")
    events.where("ts < TIMESTAMP_NTZ'2024-01-16 00:00:00'").write.parquet(f"{scratch}/in/part=0")
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{scratch}/in")
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=100_000)
    points = pipelines.per_interval(_messages(stream, "ram"), 600, "1 minute")
    live = backfill_then_live(points, table, pipelines.ram_rows, f"{scratch}/ck", timeout_s=0.2, interval_seconds=1,
                              sample_key=["sample_id"], insert_time="2024-02-01 00:00:00")
    try:
        events.where("ts >= TIMESTAMP_NTZ'2024-01-16 00:00:00'").write.parquet(f"{scratch}/in/part=1")
        batch = pipelines.per_interval(_messages(events, "ram"), 600)
        last = batch.agg(F.max("window_start")).first()[0]  # still open behind the watermark
        want = pipelines.ram_rows(batch.where(F.col("window_start") < F.lit(last))).count()
        deadline = time.time() + 120
        while table.read().count() < want and time.time() < deadline:
            live.processAllAvailable()
        assert len([q for q in spark.streams.active if q.id == live.id]) == 1
    finally:
        live.stop()
    assert table.read().count() == want > 100


@pytest.mark.parametrize("failing", [2, 3, 99])
def test_a_failing_collector_is_started_again(spark, scratch, failing):
    """Two or three failures in a row are made good, without a second group; after the fourth the error is raised."""
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=100_000)
    calls, seen = [], []

    def rows(batch):
        calls.append(1)
        if len(calls) <= failing:
            raise OSError(f"probe failed {len(calls)}")
        return pipelines.ram_rows(batch)

    points = pipelines.per_interval(_messages(_event_stream(spark), "ram"), 3600, "1 minute")
    run = lambda: supervised(lambda: start_collector(points, table, rows, f"{scratch}/ck", sample_key=["sample_id"], available_now=True,
                                                     insert_time="2024-02-01 00:00:00"), on_error=lambda e, n: seen.append(n))
    if failing == 99:
        with pytest.raises(StreamingQueryException, match="probe failed 4"):
            run()
        assert seen == [1, 2, 3, 4] and table.read().count() == 0
    else:
        run()
        got = table.read()
        assert seen == list(range(1, failing + 1)) and got.count() == got.select("group_id").distinct().count() > 100


def test_independent_pipelines_own_checkpoints(spark, scratch):
    kinds = ("ram", "file")
    tables = {k: open_table(spark, f"{scratch}/{k}", k, max_groups=10) for k in kinds}
    qs = pipelines.start_all({k: _messages(_event_stream(spark), k) for k in kinds}, tables, f"{scratch}/ck",
                             interval_seconds=3600, live=False, insert_time="2024-02-01 00:00:00")
    for q in qs.values():
        q.awaitTermination(300)
    assert all(tables[k].read().select("group_id").distinct().count() == 10 for k in kinds)
    assert len({q.id for q in qs.values()}) == 2


def test_a_new_checkpoint_is_another_writer(spark, scratch):
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=100_000)
    points = pipelines.per_interval(_messages(_event_stream(spark), "ram"), 3600, "1 minute")
    counts = []
    for name in ("ck1", "ck2"):
        start_collector(points, table, pipelines.ram_rows, f"{scratch}/{name}", sample_key=["sample_id"], available_now=True,
                        insert_time="2024-02-01 00:00:00").awaitTermination(300)
        counts.append(table.read().count())
    assert counts[1] == 2 * counts[0] > 0


def test_empty_batch_draws_no_group(spark, scratch):
    table = SnapshotTable(spark, f"{scratch}/t", "ram", max_groups=5)
    write = snapshot_writer(table, lambda b: b)
    write(_ram_rows(spark, 0, 0), 0)
    assert table.state().version == 0


def test_unsigned_readings(spark):
    df = spark.createDataFrame([("9223372036854775807",), ("0",), (None,)], "s string").select(F.col("s").cast("decimal(20,0)").alias("d"))
    got = df.select(pipelines.snapshots.unsigned_long(F.col("d")).alias("x")).collect()
    assert [r.x for r in got] == [2 ** 63 - 1, 0, None]
    with pytest.raises(Exception, match="does not fit"):
        spark.sql("SELECT CAST('18446744073709551615' AS DECIMAL(20,0)) AS d").select(pipelines.snapshots.unsigned_long(F.col("d"))).collect()


def test_key_table_is_a_logged_table():
    assert issubclass(KeyTable, SnapshotTable.__mro__[1])
