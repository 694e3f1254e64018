"""Stored tables on Parquet with a small commit log (sinks SNK-1…13, RT-1…6, SK-4, ST-3/4).

Layout under `root`::

    data/run=<name>/[group_bucket=<b>/]part-*.parquet   rows of one commit, or of several after a compaction
    rejected/run=<name>/part-*.parquet                  rows that broke a constraint, as they came
    _log/commit=<n>.json                                the table's state after commit n
    _ids/draw=<n>.json                                  the id marks after draw n

* An append numbers its rows once, draws a range of ids and groups, writes its
  rows into a folder of its own, and commits. Writers that meet at a draw or a
  commit repeat that small step only, never the rows. Ranges of runs that died
  are gaps, as with any sequence. A run that is tried again (same writer and
  batch, same counts) gets its range and its insert time again.
* The newest log entry is the whole state: the id marks (an id freed by
  retention is never drawn again), the cutoffs below which rows are pruned, the
  last batch of every writer, and the folders that still hold visible rows, with
  the ids and the rows of each visible group. Ids of a group have no gaps, so
  cutoffs and page borders are arithmetic over the entry: no data file is read
  for them, and a page opens its own folders only. The entry is bounded by the
  groups (or keys) that a table keeps.
* Entries are created whole and never overwritten (see :mod:`.log`).
* Retention moves a cutoff; folders whose rows all lie below it leave the
  state at once, and `vacuum` deletes them.
* `compact` rewrites small folders as one, sorted by id, and swaps them in one
  commit. An append at the same time is kept; readers of an earlier entry go on,
  since its folders stay until `vacuum` finds the entry old.
* With `quarantine` the rows that break a constraint go to a side folder in the
  same commit; the entry lists the folders of the newest `max_groups` such runs
  with their rows, and the rows rejected in all.
* A replayed batch is known by writer and batch id together. A batch id lower
  than the writer's last one is an error, never a silent skip.
"""

from __future__ import annotations

import datetime as dt
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import append, ids, keys, validate
from ..operators.retention import as_timestamp
from ..schemas import (DEFAULT_KEY_LIFETIME_MINUTES, DEFAULT_MAX_GROUPS, DEFAULT_MAX_SESSION_KEYS, SESSION_KEYS, Kind,
                       kind_of)
from .log import EntryLog

BUCKET_COL = "group_bucket"
DEFAULT_BUCKET_SIZE = 64
DEFAULT_TARGET_ROWS = 1_000_000
_BAD = "_breaks_constraint"
_RETRIES = 100


@dataclass(frozen=True)
class Block:
    """Rows of one group in one folder: ids `first_id`, `first_id` + 1, … Keys are blocks without a group."""
    first_id: int
    rows: int
    group: int | None = None

    @property
    def last_id(self) -> int:
        return self.first_id + self.rows - 1


@dataclass(frozen=True)
class Folder:
    name: str
    blocks: tuple[Block, ...]
    inserted_at: str | None = None
    valid_until: str | None = None


@dataclass(frozen=True)
class TableState:
    """`cutoff` is the least visible group id (or key id)."""
    version: int = 0
    group_mark: int = 0
    id_mark: int = 0
    cutoff: int | None = None
    expired_before: str | None = None
    rows: int = 0
    writers: dict[str, int] = field(default_factory=dict)
    folders: tuple[Folder, ...] = ()
    rejected: dict[str, int] = field(default_factory=dict)
    rejected_rows: int = 0

    def seen(self, writer: str, batch_id: int) -> bool:
        last = self.writers.get(writer)
        if last is not None and batch_id < last:
            raise ValueError(f"batch {batch_id} of writer {writer!r} comes after its batch {last}")
        return batch_id == last

    def visible(self) -> list[tuple[Block, Folder]]:
        """Blocks that readers see, newest ids first; a cutoff inside a folder of keys shortens its block."""
        out = []
        for f in self.folders:
            if f.valid_until is not None and self.expired_before is not None and f.valid_until < self.expired_before:
                continue
            for b in f.blocks:
                if b.group is None and self.cutoff is not None and b.first_id < self.cutoff <= b.last_id:
                    b = Block(self.cutoff, b.last_id - self.cutoff + 1)
                if self.cutoff is None or (b.first_id if b.group is None else b.group) >= self.cutoff:
                    out.append((b, f))
        return sorted(out, key=lambda x: -x[0].first_id)

    def groups(self) -> list[int]:
        """Visible groups, newest first."""
        return sorted({b.group for b, _ in self.visible()}, reverse=True)

    def live(self) -> TableState:
        """The state without folders and blocks that nothing shows any more."""
        kept = {}
        for b, f in self.visible():
            kept.setdefault(f.name, []).append(b)
        return replace(self, folders=tuple(replace(f, blocks=tuple(sorted(kept[f.name], key=lambda b: b.first_id)))
                                           for f in self.folders if f.name in kept))

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(entry: dict) -> TableState:
        folders = tuple(Folder(**{**f, "blocks": tuple(Block(**b) for b in f["blocks"])}) for f in entry["folders"])
        return TableState(**{**entry, "folders": folders})


@dataclass(frozen=True)
class Draw:
    """A range of groups and ids after the marks, and the time at which the rows count as inserted."""
    group_mark: int
    id_mark: int
    inserted_at: str


def _new_folder() -> str:
    return f"run={uuid.uuid4().hex}"


def _clock_text(as_of: dt.datetime | str | None) -> str:
    """A clock value in one form, so that times compare as text."""
    if as_of is None:
        as_of = dt.datetime.now(dt.timezone.utc)
    elif isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return as_of.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")


class LoggedTable:
    """State, reading and clean-up shared by the tables."""

    schema: T.StructType

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = EntryLog(spark, f"{self.root}/_log", "commit")
        self.draws = EntryLog(spark, f"{self.root}/_ids", "draw")

    # ------------------------------------------------------------------ files
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _list(self, *parts: str) -> list:
        path = self._path(*parts)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, *parts: str) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # ------------------------------------------------------------------ state
    def state(self) -> TableState:
        found = self.log.newest()
        return TableState() if found is None else TableState.from_json(found[1])

    def create_if_absent(self) -> bool:
        """SNK-6…10: an empty table is a log with commit 0 and no data; True when it was created."""
        return not self.log.numbers() and self._commit(TableState())

    def _commit(self, st: TableState) -> bool:
        """Create the log entry; False if another writer has taken the version."""
        return self.log.put(st.version, st.to_json())

    def _committed(self, change: Callable[[TableState], TableState | None]) -> bool:
        """Commit `change` of the newest state, again while other writers come first; False if it returns None."""
        for _ in range(_RETRIES):
            st = self.state()
            after = change(st)
            if after is None:
                return False
            if self._commit(replace(after, version=st.version + 1).live()):
                return True
            time.sleep(random.uniform(0, 0.05))
        raise RuntimeError(f"{self.root}: no free version after {_RETRIES} attempts")

    def _draw(self, n_groups: int, n_rows: int, run: str, inserted_at: str | None) -> Draw:
        """SNK-11, SNK-12: a range that no other run has. An open draw of the same `run` and size is used again."""
        for _ in range(_RETRIES):
            st, last = self.state(), self.draws.newest()
            number, entry = last or (-1, {"group_mark": 0, "id_mark": 0, "open": {}})
            mine = entry["open"].get(run)
            if mine and mine["size"] == [n_groups, n_rows] and inserted_at in (None, mine["inserted_at"]):
                return Draw(mine["group_mark"], mine["id_mark"], mine["inserted_at"])
            draw = Draw(max(st.group_mark, entry["group_mark"]), max(st.id_mark, entry["id_mark"]), inserted_at or _clock_text(None))
            writer = run.rpartition(":")[0]
            still = {k: v for k, v in entry["open"].items() if k.rpartition(":")[0] != writer}  # one open run per writer
            after = {"group_mark": draw.group_mark + n_groups, "id_mark": draw.id_mark + n_rows,
                     "open": {**still, **({run: {**asdict(draw), "size": [n_groups, n_rows]}} if run else {})}}
            if self.draws.put(number + 1, after):
                return draw
            time.sleep(random.uniform(0, 0.05))
        raise RuntimeError(f"{self.root}: no free draw after {_RETRIES} attempts")

    def _scan(self, names: list[str], extra: list[T.StructField] = ()) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, *extra]))
        paths = [f"{self.root}/data/{name}" for name in names]
        schema = T.StructType([*self.schema.fields, *extra, T.StructField("run", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)

    def vacuum(self, keep_versions: int = 2, min_age_seconds: float = 3600) -> int:
        """Delete old log entries but the newest `keep_versions`, and folders that no kept entry names.

        Entries that were the newest within `min_age_seconds` stay for their
        readers, folders younger than that stay because they may belong to a
        commit under way. Returns the number of data folders deleted.
        """
        self.log.tidy(keep_versions, min_age_seconds)
        self.draws.tidy(1, min_age_seconds)
        kept = [TableState.from_json(e) for e in map(self.log.read, self.log.numbers()) if e is not None]
        limit = (time.time() - min_age_seconds) * 1000
        deleted = {}
        for place, live in (("data", {f.name for st in kept for f in st.folders}), ("rejected", {r for st in kept for r in st.rejected})):
            dead = [s.getPath().getName() for s in self._list(place)
                    if s.getPath().getName() not in live and s.getModificationTime() <= limit]
            for name in dead:
                self._delete(place, name)
            deleted[place] = len(dead)
        return deleted["data"]


class SnapshotTable(LoggedTable):
    """One metric table (cpu, ram, net or file) with keep-newest-N retention.

    With `max_folders` an append that leaves more folders than that is followed by a compaction.
    """

    def __init__(self, spark: SparkSession, root: str, kind: str | Kind, max_groups: int = DEFAULT_MAX_GROUPS,
                 bucket_size: int = DEFAULT_BUCKET_SIZE, max_folders: int | None = None):
        super().__init__(spark, root)
        self.kind = kind_of(kind)
        self.schema = self.kind.schema
        self.max_groups = max_groups
        self.bucket_size = bucket_size
        self.max_folders = max_folders

    def _rows(self, blocks: list[tuple[Block, Folder]]) -> DataFrame:
        """Rows of the folders that hold `blocks`, from the least of their groups on."""
        names = sorted({f.name for _, f in blocks})
        df = self._scan(names, [T.StructField(BUCKET_COL, T.IntegerType(), True)])
        if blocks:
            least = min(b.group for b, _ in blocks)
            df = df.where((F.col(BUCKET_COL) >= F.lit(least // self.bucket_size)) &
                          (F.col("group_id") >= F.lit(least).cast("int")))
        return df.select(*self.kind.columns)

    def read(self, state: TableState | None = None) -> DataFrame:
        return self._rows((state or self.state()).visible())

    def page(self, limit: int | None = None, offset: int | None = None, *, limit_group: int | None = None,
             offset_group: int | None = None, state: TableState | None = None, ordered: bool = True) -> DataFrame:
        """PG-1…4, GP-1…5: newest rows first, of the groups ranked ``offset_group < rank <= limit_group``.

        All borders come from the log entry; the result is one scan of the folders that the page touches.
        """
        if (limit or 0) < 0 or (offset or 0) < 0:
            raise ValueError("LIMIT and OFFSET must not be negative")
        st = state or self.state()
        ranked = st.groups()
        ranked = ranked[max(0, offset_group or 0):None if limit_group is None else max(0, limit_group)]
        inside = set(ranked)
        skip, left, taken = offset or 0, limit, []
        for b, f in st.visible():
            if b.group not in inside:
                continue
            part = min(skip, b.rows)
            skip -= part
            n = b.rows - part if left is None else min(left, b.rows - part)
            if n:
                taken.append((Block(b.last_id - part - n + 1, n, b.group), f))
                left = None if left is None else left - n
        df = self._rows(taken)
        if taken:
            group, row = F.col("group_id"), F.col("id")
            df = df.where((group <= F.lit(max(b.group for b, _ in taken)).cast("int")) &
                          row.between(F.lit(taken[-1][0].first_id).cast("int"), F.lit(taken[0][0].last_id).cast("int")))
        return df.orderBy(F.desc("id")) if ordered else df

    def append_run(self, rows: DataFrame, batch_id: int, *, writer: str = "", sample_key: list[str] | None = None,
                   order: list[str] | None = None, insert_time=None, skip_empty: bool = False,
                   quarantine: bool = False) -> bool:
        """Append one collection run (or many runs keyed by `sample_key`).

        `rows` holds the insert columns (no `id`, `group_id`). With no
        `sample_key` the whole input is one group. Steps: number the rows (one
        staging), draw their ids, check constraints, write the rows' folder, and
        commit it with the cutoff that keeps `max_groups` groups. A replayed batch
        of the same writer, or an empty one with `skip_empty`, returns False and
        writes nothing.

        A row that breaks a constraint fails the run. With `quarantine` it goes
        to a side folder instead (see `rejected`), draws no id, and a sample all
        of whose rows are bad draws no group; without an `order` the rows of the
        run are then numbered in the order of their figures. A run of bad rows
        only counts as an empty run that has something to keep.
        """
        if self.state().seen(writer, batch_id):
            return False
        if quarantine:
            n, bad, n_bad = self._divided(rows, list(sample_key or []), list(order or []))
        else:
            n, bad, n_bad = ids.numbered(rows, list(sample_key or []), list(order or [])), None, 0
        try:
            if skip_empty and not n.n_rows and not n_bad:
                return False
            new = n.n_keys if sample_key else int(n.n_rows > 0 or not n_bad)
            draw = self._draw(new, n.n_rows, f"{writer}:{batch_id}", None if insert_time is None else str(insert_time))
            folder = self._write(n, draw, bool(sample_key)) if n.n_rows else None
            aside = _new_folder() if n_bad else None
            if aside:
                bad.withColumn("insertion_datetime", append.insert_time(draw.inserted_at)).write.parquet(f"{self.root}/rejected/{aside}")
        finally:
            n.discard()

        def change(st: TableState) -> TableState | None:
            if st.seen(writer, batch_id):
                return None
            own = range(draw.group_mark + 1, draw.group_mark + new + 1)
            newest = sorted({*st.groups(), *own[-self.max_groups:]}, reverse=True)[:self.max_groups]
            cutoff = st.cutoff if len(newest) < self.max_groups else max(newest[-1], st.cutoff or newest[-1])
            return replace(st, group_mark=max(st.group_mark, own.stop - 1), id_mark=max(st.id_mark, draw.id_mark + n.n_rows),
                           rows=n.n_rows, cutoff=cutoff, writers={**st.writers, writer: batch_id},
                           folders=(*st.folders, *([folder] if folder else [])), rejected_rows=st.rejected_rows + n_bad,
                           rejected=dict([*st.rejected.items(), *([(aside, n_bad)] if aside else [])][-self.max_groups:]))

        done = False
        try:
            done = self._committed(change)
        finally:
            if folder and not done:
                self._delete("data", folder.name)
            if aside and not done:
                self._delete("rejected", aside)
        if done and self.max_folders is not None and len(self.state().folders) > self.max_folders:
            self.compact()
        return done

    def _divided(self, rows: DataFrame, sample_key: list[str], order: list[str]) -> tuple[ids.Numbered, DataFrame, int]:
        """(the valid rows numbered, the rejected rows, their number) from one staging.

        The verdict is the first key, so the valid rows come first and their
        numbers have no gaps. Rejected rows are counted over the staged verdict:
        an observed metric would also count the rows that range partitioning samples.
        """
        flagged = rows.withColumn(_BAD, validate.rejects(rows, self.kind))
        n = ids.numbered(flagged, [_BAD, *sample_key], order or [c for c in self.kind.columns if c in rows.columns])
        bad = n.rows.where(F.col(_BAD))
        n_bad, bad_keys = bad.agg(F.count("*"), F.count_distinct("key_no")).first()
        valid = ids.Numbered(n.rows.where(~F.col(_BAD)).drop(_BAD), n.n_rows - n_bad, n.n_keys - bad_keys, n.path)
        return valid, bad.drop(_BAD, "row_no", "key_no"), n_bad

    def rejected(self, state: TableState | None = None) -> DataFrame:
        """The quarantined rows that the log lists, with the columns they came with, `insertion_datetime` and `run`."""
        st = state or self.state()
        if not st.rejected:
            kept = [f for f in self.kind.schema.fields if f.name not in validate.DRAWN]
            return self.spark.createDataFrame([], T.StructType([*kept, T.StructField("insertion_datetime", T.TimestampNTZType()),
                                                               T.StructField("run", T.StringType())]))
        paths = [f"{self.root}/rejected/{name}" for name in sorted(st.rejected)]
        return self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/rejected").parquet(*paths)

    def compact(self, target_rows: int = DEFAULT_TARGET_ROWS) -> int:
        """Rewrite the folders with fewer than `target_rows` visible rows as one, sorted by id; returns how many they were.

        Files hold about `target_rows` rows of consecutive ids. The commit takes
        the newest state and swaps the folders there: what an append has added
        meanwhile stays, what retention has hidden meanwhile stays hidden. If
        another compaction was first, this one leaves nothing behind and returns 0.
        """
        blocks: dict[str, list[Block]] = {}
        for b, f in (visible := self.state().visible()):
            blocks.setdefault(f.name, []).append(b)
        small = {name for name, bs in blocks.items() if sum(b.rows for b in bs) < target_rows}
        if len(small) < 2:
            return 0
        chosen = [(b, f) for b, f in visible if f.name in small]
        files = -(-sum(b.rows for b, _ in chosen) // target_rows)
        rows = self._rows(chosen).repartitionByRange(files, "id").sortWithinPartitions("id")
        name = _new_folder()
        (rows.withColumn(BUCKET_COL, F.floor(F.col("group_id") / F.lit(self.bucket_size)).cast("int"))
         .write.partitionBy(BUCKET_COL).parquet(f"{self.root}/data/{name}"))
        merged = Folder(name, tuple(sorted((b for b, _ in chosen), key=lambda b: b.first_id)),
                        inserted_at=max((f.inserted_at for _, f in chosen if f.inserted_at), default=None))

        def change(st: TableState) -> TableState | None:
            there = {f.name for f in st.folders}
            gone = {f.name for f in self._hidden(st, chosen)}
            if (small - there) - gone:
                return None
            return replace(st, folders=(*(f for f in st.folders if f.name not in small), merged))

        done = False
        try:
            done = self._committed(change)
        finally:
            if not done:
                self._delete("data", name)
        return len(small) if done else 0

    @staticmethod
    def _hidden(st: TableState, chosen: list[tuple[Block, Folder]]) -> list[Folder]:
        """The folders of which `st` shows nothing any more."""
        shown = {f.name for b, f in chosen if st.cutoff is None or b.group >= st.cutoff}
        return [f for _, f in chosen if f.name not in shown]

    def _write(self, n: ids.Numbered, draw: Draw, keyed: bool) -> Folder:
        """The run's folder: its rows, but for groups of a bulk run beyond the `max_groups` newest."""
        least = max(0, n.n_keys - self.max_groups) if keyed else 0
        sizes = [(0, 0, n.n_rows)]
        if keyed:
            sizes = (n.rows.where(F.col("key_no") >= least).groupBy("key_no")
                     .agg(F.min("row_no").alias("first"), F.count("*").alias("rows")).collect())  # at most max_groups rows
        out = append.from_numbered(n, self.kind, group_mark=draw.group_mark, id_mark=draw.id_mark, keyed=keyed,
                                   inserted_at=draw.inserted_at)
        out = out.where(F.col("group_id") > F.lit(draw.group_mark + least).cast("int"))
        out = validate.require_valid(out, self.kind)
        out = out.withColumn(BUCKET_COL, F.floor(F.col("group_id") / F.lit(self.bucket_size)).cast("int"))
        name = _new_folder()
        out.write.partitionBy(BUCKET_COL).parquet(f"{self.root}/data/{name}")
        blocks = [Block(draw.id_mark + 1 + first, rows, draw.group_mark + 1 + key) for key, first, rows in sorted(map(tuple, sizes))]
        return Folder(name, tuple(blocks), inserted_at=draw.inserted_at)


class KeyTable(LoggedTable):
    """The session keys: prune and insert in one commit (SK-4, RT-6, SNK-5, SNK-6)."""

    schema = SESSION_KEYS

    def __init__(self, spark: SparkSession, root: str, max_keys: int = DEFAULT_MAX_SESSION_KEYS,
                 lifetime_minutes: int = DEFAULT_KEY_LIFETIME_MINUTES):
        super().__init__(spark, root)
        self.max_keys, self.lifetime_minutes = max_keys, lifetime_minutes

    def read(self, state: TableState | None = None) -> DataFrame:
        st = state or self.state()
        df = self._scan(sorted({f.name for _, f in st.visible()}))
        if st.cutoff is not None:
            df = df.where(F.col("id") >= F.lit(st.cutoff).cast("int"))
        if st.expired_before is not None:
            df = df.where(F.col("valid_until") >= as_timestamp(st.expired_before))
        return df.select(*SESSION_KEYS.names)

    def unseen(self, candidates: DataFrame, key_col: str = "session_key") -> DataFrame:
        """SK-1 against the table as it stands."""
        return keys.keys_unseen(candidates, self.read(), key_col)

    def valid(self, presented: DataFrame, as_of: dt.datetime | str | None = None, key_col: str = "session_key") -> DataFrame:
        """SK-2 against the table as it stands; folders whose keys have all expired by then are not opened."""
        now = _clock_text(as_of)
        st = self.state()
        st = replace(st, folders=tuple(f for f in st.folders if f.valid_until is None or f.valid_until > now))
        return keys.keys_valid(presented, self.read(st), now, key_col)

    def save(self, new_keys: DataFrame, as_of: dt.datetime | str, *, order: list[str] | None = None) -> bool:
        """Drop expired keys and all but the newest ``max_keys - 1``, then insert `new_keys` (column `session_key`).

        Ids are drawn like those of rows, so an id is not drawn again after its key was deleted.
        """
        now = _clock_text(as_of)
        n = ids.numbered(new_keys, [], list(order or ["session_key"]))
        folder = None
        try:
            draw = self._draw(0, n.n_rows, "", now)
            if n.n_rows:
                fresh = n.rows.withColumn("id", ids.checked_int(F.col("row_no") + F.lit(draw.id_mark + 1).cast("long")))
                rows = keys.new_key_rows(fresh, now, self.lifetime_minutes)
                until = dt.datetime.fromisoformat(now) + dt.timedelta(minutes=self.lifetime_minutes)
                folder = Folder(_new_folder(), (Block(draw.id_mark + 1, n.n_rows),), inserted_at=now, valid_until=_clock_text(until))
                validate.require_valid(rows, "session_keys").write.parquet(f"{self.root}/data/{folder.name}")
        finally:
            n.discard()

        def change(st: TableState) -> TableState:
            keep, cutoff = self.max_keys - 1, st.cutoff
            if keep <= 0:
                cutoff = draw.id_mark + 1
            else:
                for b, _ in st.visible():
                    if b.rows >= keep:
                        cutoff = max(b.last_id - keep + 1, st.cutoff or 0)
                        break
                    keep -= b.rows
            return replace(st, id_mark=max(st.id_mark, draw.id_mark + n.n_rows), rows=n.n_rows, cutoff=cutoff,
                           expired_before=max(now, st.expired_before or now), folders=(*st.folders, *([folder] if folder else [])))

        done = False
        try:
            done = self._committed(change)
        finally:
            if folder and not done:
                self._delete("data", folder.name)
        return done


def open_table(spark: SparkSession, root: str, kind: str | Kind, **settings) -> LoggedTable:
    """The stored table of a metric kind, or of `session_keys`, created when absent."""
    table = KeyTable(spark, root, **settings) if kind == "session_keys" else SnapshotTable(spark, root, kind, **settings)
    table.create_if_absent()
    return table
