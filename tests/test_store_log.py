"""The commit log of stored tables: writers that meet or die, borders from the log entry alone."""
import os
import random
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from hostshelf.plans.info_query import info_query, stored_query
from hostshelf.sinks.log import EntryLog
from hostshelf.sinks.store import Block, Folder, KeyTable, SnapshotTable, TableState, open_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WRITER = """
import os, sys, time
sys.path.insert(0, sys.argv[1])
from hostshelf.session import build_session
from hostshelf.sinks.store import open_table
from pyspark.sql import functions as F
spark = build_session("local[2]", 2, extra={"spark.checkpoint.dir": sys.argv[2] + "/shared-" + sys.argv[3]})
rows = lambda i: spark.range(2).select(F.lit(16000).cast("long").alias("total"), F.lit(i).cast("long").alias("used"),
    F.lit(int(sys.argv[3])).cast("long").alias("free"), F.lit(5).cast("long").alias("commited"), F.lit(7).cast("long").alias("cached"))
table = open_table(spark, sys.argv[2] + "/ram", "ram", max_groups=1000)
rows(0).count()
open(sys.argv[2] + "/ready-" + sys.argv[3], "w").close()
while sum(x.startswith("ready-") for x in os.listdir(sys.argv[2])) < 2:
    time.sleep(0.02)
for i in range(int(sys.argv[4])):
    assert table.append_run(rows(i), i, writer=sys.argv[3])
"""


def _rows(spark, n, used=1):
    return spark.range(n).select(F.lit(16000).cast("long").alias("total"), F.lit(used).cast("long").alias("used"),
                                 F.lit(1).cast("long").alias("free"), F.lit(5).cast("long").alias("commited"), F.lit(7).cast("long").alias("cached"))


def test_two_processes_append_at_once(spark, scratch):
    runs = 25
    both = [subprocess.Popen([sys.executable, "-c", WRITER, ROOT, scratch, str(w), str(runs)], stderr=subprocess.DEVNULL) for w in (1, 2)]
    assert [p.wait(240) for p in both] == [0, 0]
    table = SnapshotTable(spark, f"{scratch}/ram", "ram", max_groups=1000)
    got = table.read().collect()
    assert len(got) == 2 * 2 * runs == len({r.id for r in got})
    runs_of = {(r.free, r.used): set() for r in got}
    for r in got:
        runs_of[r.free, r.used].add(r.group_id)
    assert len(runs_of) == 2 * runs and all(len(g) == 1 for g in runs_of.values())  # one group per run
    assert len({r.group_id for r in got}) == 2 * runs
    for w in (1, 2):  # groups and ids rise with a writer's runs
        assert [g for i in range(runs) for g in runs_of[w, i]] == sorted(g for i in range(runs) for g in runs_of[w, i])
    assert [r.id for r in table.page(7, 3).collect()] == sorted((r.id for r in got), reverse=True)[3:10]


@pytest.mark.parametrize("link", [True, False])
def test_an_entry_is_created_once(spark, scratch, monkeypatch, link):
    """Many threads at one number: one wins. Also with the rename that other file systems use."""
    log = EntryLog(spark, f"{scratch}/log", "e")
    if not link:
        monkeypatch.setattr(log, "_name_once", lambda fs, a, b: _renamed(log, fs, a, b))
    assert log.newest() is None
    won = [[] for _ in range(20)]

    def writer(k):
        for n in range(20):
            if log.put(n, {"by": k}):
                won[n].append(k)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4 if link else 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert all(len(x) == 1 for x in won) and [log.read(n)["by"] for n in range(20)] == [x[0] for x in won]
    assert not log.put(7, {"by": "late"}) and log.read(7) == {"by": won[7][0]}
    assert not [s for s in log._files() if s.getPath().getName().endswith(".tmp")]


def _renamed(log, fs, hidden, target):
    jvm = log.spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), log.spark._jsc.hadoopConfiguration())
    plain = log.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(hidden, target, plain)
    except Exception:
        return not fs.exists(target)
    return True


def test_what_a_dead_writer_leaves_stops_nobody(spark, scratch):
    table = open_table(spark, f"{scratch}/ram", "ram")
    assert table.append_run(_rows(spark, 1), 0)
    with open(f"{scratch}/ram/_log/.half-written.tmp", "w") as f:
        f.write('{"version": 2, "gro')
    _rows(spark, 3).write.parquet(f"{scratch}/ram/data/run=dead")
    lost = table._draw(1, 5, "gone:0", None)  # it drew ids and died
    assert table.append_run(_rows(spark, 2), 1)
    assert sorted((r.group_id, r.id) for r in table.read().collect()) == [(1, 1), (lost.group_mark + 2, lost.id_mark + 6), (lost.group_mark + 2, lost.id_mark + 7)]
    assert table.vacuum(keep_versions=1, min_age_seconds=0) == 1
    assert [x for x in os.listdir(f"{scratch}/ram/_log") if not x.endswith(".crc")] == ["commit=2.json"]
    assert table.read().count() == 3


def test_a_run_tried_again_has_its_ids_and_time(spark, scratch, monkeypatch):
    table = open_table(spark, f"{scratch}/ram", "ram")
    real = SnapshotTable._commit
    monkeypatch.setattr(SnapshotTable, "_commit", lambda self, st: (_ for _ in ()).throw(OSError("store away")))
    with pytest.raises(OSError):
        table.append_run(_rows(spark, 2), 5, writer="w")
    assert not table._list("data")  # its folder is gone
    first = table.draws.newest()[1]["open"]["w:5"]
    monkeypatch.setattr(SnapshotTable, "_commit", real)
    time.sleep(0.01)
    assert table.append_run(_rows(spark, 2), 5, writer="w")
    rows = table.read().collect()
    assert {r.id for r in rows} == {1, 2} and {str(r.insertion_datetime) for r in rows} == {first["inserted_at"]}
    assert table.state().folders[0].inserted_at == first["inserted_at"]


def test_an_append_reads_no_data_file(spark, scratch, monkeypatch):
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=3)
    monkeypatch.setattr(SnapshotTable, "_scan", lambda *a, **k: pytest.fail("the append scanned the table"))
    for b in range(6):
        assert table.append_run(_rows(spark, b), b, insert_time="2024-01-01")
    st = table.state()
    assert st.groups() == [6, 5, 4] and st.cutoff == 4 and st.rows == 5
    keys = open_table(spark, f"{scratch}/keys", "session_keys", max_keys=3)
    monkeypatch.setattr(KeyTable, "_scan", lambda *a, **k: pytest.fail("the save scanned the table"))
    for i in range(5):
        assert keys.save(spark.createDataFrame([(f"k{i}",)], "session_key string"), "2024-01-01 00:00:00")
    assert [b.first_id for b, _ in keys.state().visible()] == [5, 4, 3]


def test_borders_equal_those_of_the_rows(spark, scratch):
    """Pages and group pages from the log entry against the same requests over the rows."""
    rnd = random.Random(4)
    table = open_table(spark, f"{scratch}/file", "file", max_groups=12, bucket_size=3)
    batch = 0
    for keyed in (True, False, True, False, False):
        rows = spark.createDataFrame([(s, f"/m{i}", 100, 10 * i, 100 - 10 * i, 0.1 * i) for s in range(5) for i in range(rnd.randint(1, 4))],
                                     "sample_id long, path string, total long, used long, free long, used_percent double")
        if keyed:
            table.append_run(rows, batch, sample_key=["sample_id"], order=["path"], insert_time="2024-01-01")
        else:
            table.append_run(rows.drop("sample_id"), batch, order=["path"], insert_time="2024-01-01")
        table._draw(2, 7, "", None)  # a gap in groups and ids
        batch += 1
    rows = table.read()
    assert rows.select("group_id").distinct().count() == 12 == len(table.state().groups())
    forms = [{}, {"limit": "5"}, {"offset": "4"}, {"limit": "6", "offset": "9"}, {"limit": "0"}, {"offset": "999"}, {"limit_group": "3"},
             {"offset_group": "10"}, {"limit_group": "5", "offset_group": "2"}, {"limit_group": "4", "offset_group": "4"},
             {"limit_group": "6", "limit": "7", "offset": "3"}, {"limit_group": "0"}, {"limit_group": "-1"}, {"offset_group": "-2"},
             {"file_used_min": "10", "limit_group": "7", "limit": "5"}, {"file_used_min": "10", "offset": "2"}]
    for form in forms:
        assert [tuple(r) for r in stored_query(table, form).collect()] == [tuple(r) for r in info_query(rows, "file", form).collect()], form
    for form in ({"limit": "-1"}, {"offset": "-1"}):
        with pytest.raises(ValueError):
            stored_query(table, form)
    page = stored_query(table, {"limit": "1"})
    assert len(page.inputFiles()) < len(rows.inputFiles())  # only the border's folder is opened


def test_key_cutoffs_inside_a_folder():
    st = TableState(cutoff=7, expired_before="2024-01-02", folders=(
        Folder("a", (Block(1, 4),), valid_until="2024-01-05"), Folder("b", (Block(5, 6),), valid_until="2024-01-05"),
        Folder("c", (Block(11, 2),), valid_until="2024-01-01")))
    assert [(b.first_id, b.rows) for b, _ in st.visible()] == [(7, 4)]
    assert [f.name for f in st.live().folders] == ["b"] and TableState.from_json(st.to_json()) == st


def test_stored_keys_are_asked_in_the_table(spark, scratch):
    table = open_table(spark, f"{scratch}/keys", "session_keys")
    frame = lambda *k: spark.createDataFrame([(x,) for x in k], "session_key string")
    table.save(frame("a", "b"), "2024-01-01 00:00:00")
    table.save(frame("c"), "2024-01-01 00:30:00")
    asked = frame("a", "b", "c", "d", "a")
    assert sorted(r[0] for r in table.valid(asked, "2024-01-01 00:59:59").collect()) == ["a", "a", "b", "c"]
    assert sorted(r[0] for r in table.valid(asked, "2024-01-01 01:00:00").collect()) == ["c"]
    assert [r[0] for r in table.unseen(asked).collect()] == ["d"]


# ------------------------------------------------------------------ compaction
def test_compaction_changes_no_row_and_bounds_the_files(spark, scratch):
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=9, bucket_size=4)
    for b in range(12):
        assert table.append_run(_rows(spark, b % 4 + 1, used=b), b, insert_time="2024-01-01")
    before, old = sorted(map(tuple, table.read().collect())), table.state()
    page = [tuple(r) for r in table.page(5, 2).collect()]
    reader = table.read(old)  # planned before, run after
    assert table.compact() == 9 and table.compact() == 0
    st = table.state()
    assert len(st.folders) == 1 and st.groups() == old.groups() and st.cutoff == old.cutoff and st.writers == old.writers
    assert sorted(map(tuple, table.read().collect())) == before and len(table.read().inputFiles()) == 3  # one file a bucket
    assert [tuple(r) for r in table.page(5, 2).collect()] == page
    assert table.vacuum(keep_versions=1) == 0  # entries and folders are young
    assert sorted(map(tuple, reader.collect())) == before
    assert table.append_run(_rows(spark, 3), 12) and table.state().groups() == list(range(13, 4, -1))
    assert table.read().where("group_id < 13").count() == sum(b % 4 + 1 for b in range(4, 12))
    assert table.vacuum(keep_versions=1, min_age_seconds=0) == 12 and table.read().count() == sum(b % 4 + 1 for b in range(4, 12)) + 3
    ids = [r.id for f in sorted(table.read().inputFiles()) for r in spark.read.parquet(f).collect()]
    assert len(ids) == len(set(ids))


def test_folders_of_many_rows_stay_and_files_are_cut(spark, scratch):
    table = open_table(spark, f"{scratch}/ram", "ram")
    for b, n in enumerate((50, 3, 4, 5)):
        assert table.append_run(_rows(spark, n), b)
    assert table.compact(target_rows=5) == 2 and len(table.state().folders) == 3  # of 3 and of 4 rows
    assert table.compact(target_rows=30) == 2 and table.read().count() == 62
    assert len(table.read().inputFiles()) == len(table.read(table.state()).inputFiles()) and table.state().groups() == [4, 3, 2, 1]
    assert open_table(spark, f"{scratch}/none", "ram").compact() == 0


def test_compaction_beside_appends_and_another_compaction(spark, scratch, monkeypatch):
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=4)
    for b in range(4):
        assert table.append_run(_rows(spark, 2, used=b), b)
    real, once = SnapshotTable._committed, []

    def late(self, change):
        if not once:
            once.append(1)
            monkeypatch.setattr(SnapshotTable, "_committed", real)
            for b in (4, 5):  # two groups more, so two of the folders under way are pruned
                assert SnapshotTable(spark, f"{scratch}/ram", "ram", max_groups=4).append_run(_rows(spark, 2, used=b), b)
        return real(self, change)

    monkeypatch.setattr(SnapshotTable, "_committed", late)
    assert table.compact() == 4
    assert sorted((r.group_id, r.used) for r in table.read().collect()) == [(g, g - 1) for g in range(3, 7) for _ in range(2)]
    assert [r.group_id for r in table.page(3).collect()] == [6, 6, 5]
    once.clear()

    def second(self, change):
        if not once:
            once.append(1)
            monkeypatch.setattr(SnapshotTable, "_committed", real)
            assert SnapshotTable(spark, f"{scratch}/ram", "ram", max_groups=4).compact() == 3
        return real(self, change)

    monkeypatch.setattr(SnapshotTable, "_committed", second)
    assert table.compact() == 0 and table.read().count() == 8 and len(table.state().folders) == 1
    assert table.vacuum(keep_versions=1, min_age_seconds=0) > 0 and len(table._list("data")) == 1 and table.read().count() == 8


def test_appends_compact_beyond_a_number_of_folders(spark, scratch):
    table = open_table(spark, f"{scratch}/ram", "ram", max_folders=3)
    for b in range(8):
        assert table.append_run(_rows(spark, 1, used=b), b)
        assert len(table.state().folders) <= 3
    assert [r.used for r in table.page().collect()] == list(range(7, -1, -1))


# ------------------------------------------------------------------ quarantine
def test_bad_rows_go_aside_in_the_same_commit(spark, scratch, monkeypatch):
    table = open_table(spark, f"{scratch}/ram", "ram", max_groups=3)
    mixed = spark.createDataFrame([(16000, s if s != 2 else None, 1, 5, 7, s) for s in (1, 2, 3) for _ in range(2)],
                                  "total long, used long, free long, commited long, cached long, s int")
    assert table.rejected().count() == 0
    with pytest.raises(Exception, match="constraint violated"):  # its draw of three groups is a gap
        table.append_run(mixed, 0, sample_key=["s"])
    assert table.append_run(mixed, 0, sample_key=["s"], quarantine=True)
    st = table.state()
    good = sorted((r.group_id, r.used, r.id) for r in table.read().collect())
    assert [g[:2] for g in good] == [(4, 1), (4, 1), (5, 3), (5, 3)] and [g[2] for g in good] == list(range(st.id_mark - 3, st.id_mark + 1))
    aside = table.rejected().collect()
    assert [(r.used, r.s) for r in aside] == [(None, 2)] * 2 and st.rejected_rows == sum(st.rejected.values()) == 2
    assert {r.insertion_datetime for r in aside} == {r.insertion_datetime for r in table.read().collect()}
    assert not table.append_run(mixed, 0, sample_key=["s"], quarantine=True) and table.state().rejected_rows == 2  # a replay
    bad = _rows(spark, 2).withColumn("free", F.lit(None).cast("long"))
    assert table.append_run(bad, 1, quarantine=True, skip_empty=True)  # bad rows only: no group, but kept
    assert table.state().groups() == st.groups() and table.state().rejected_rows == 4
    assert table.append_run(_rows(spark, 2), 2, quarantine=True) and len(table.state().rejected) == 2
    assert not table.append_run(_rows(spark, 0), 3, quarantine=True, skip_empty=True)
    for b in (4, 5):
        assert table.append_run(bad, b, quarantine=True)
    assert len(table.state().rejected) == 3 and table.rejected().count() == 6 and table.state().rejected_rows == 8
    table.vacuum(keep_versions=1, min_age_seconds=0)
    assert len(table._list("rejected")) == 3 and table.rejected().count() == 6
    monkeypatch.setattr(SnapshotTable, "_commit", lambda self, st: (_ for _ in ()).throw(OSError("store away")))
    with pytest.raises(OSError):
        table.append_run(bad, 6, quarantine=True)
    assert len(table._list("rejected")) == 3  # what a failed run set aside is gone
