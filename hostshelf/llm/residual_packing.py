"""Best-fit packing in rounds: residual bins are the items of the next round.

A document is its token ids plus a closing id. Whole windows of `capacity` ids
are cut off first and are sequences of their own; what is left (and every
shorter document) is one item.

* Round 0 packs the items of each input partition by best fit, largest first:
  an item goes into the open bin whose room it fills best, or opens one. Pools
  hold a bounded number of items (a length and a few numbers each; the ids are
  gone once their checksum is taken). Pieces are written with their bin.
* Nearly full bins (room of at most `slack` ids) are done. The others become
  items, of the size that they hold. They are dealt into groups of about
  `GROUP` bins, each group merges its bins by the same best fit, and what is
  still underfull goes on to the next, smaller number of groups, until one
  group holds all that is left or a round merges fewer than one bin in a
  hundred. A bin keeps its pieces' order; merging only gives it a place in
  another bin, so only rows of bins travel, never pieces or texts.
* Pieces of merged bins are joined to their new place (bin, base offset).

Ids are those of the `tokenizers` library. None of the vocabulary's parts
(white-space rule, lower case, composed characters, words, special tokens)
looks across ASCII white space, so a text is encoded stretch by stretch, and a
worker remembers the ids of the stretches it has met (bounded, two
generations). A word of Latin letters with signs behind it is put together
from the ids of its lower-case letters and of the signs.

Defined results: null text is empty (one token, the closing id); repeated rows
are packed one by one; a null id is kept; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostshelf.llm import vocab
from hostshelf.llm.common import id_and_text, staged

CAPACITY, CLOSING_ID = 4096, 1
#: A bin with at most this much room is not looked at again.
SLACK = 16
#: Items of one best-fit pool, and bins of one merging group (bounds of a task's memory, not of the input).
POOL, GROUP = 1 << 16, 1 << 16
#: Stretches that a worker remembers per generation, and the longest one it remembers.
_KNOWN, _LONG = 300_000, 64
#: A word of ASCII and Latin-1 letters (all of them composed), perhaps with ASCII signs behind it; an apostrophe may join letters.
_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@[-`{-~]*)")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, room int"
_BINS = "bin long, size int, members array<struct<bin:long,base:long>>"


class Encoder(dict):
    """ids (little-endian bytes) of stretches without ASCII white space; the older half of the memory is dropped."""

    _of: dict[str, Encoder] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_str(spec), {}
        self.model = self.tokenizer.model
        self.char_of = {b: c for c, b in vocab._byte_of_char().items()}

    @classmethod
    def shared(cls, name: str, spec: str) -> Encoder:
        """One encoder per vocabulary and Python worker."""
        if name not in cls._of:
            cls._of[name] = cls(spec)
        return cls._of[name]

    def __missing__(self, stretch: bytes) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = self._encode(stretch)
        if len(stretch) <= _LONG:
            if len(self) >= _KNOWN:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def _encode(self, stretch: bytes) -> bytes:
        if word := _WORD.fullmatch(stretch):
            lower = word[1].decode().lower().encode()
            if lower != stretch:
                return self[lower] + (self[word[2]] if word[2] else b"")
            found = [t.id for t in self.model.tokenize(stretch.decode("latin-1").translate(self.char_of))]
        else:
            found = self.tokenizer.encode(stretch.decode(), add_special_tokens=False).ids
        return array("I", found).tobytes()

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def best_fit(sizes: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(item numbers, room left) per bin: best fit, largest item first, ties by number."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}  # room -> bins that have it
    rooms: list[int] = []  # the rooms there are, rising
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                del with_room[room], rooms[at]
        bins[b].append(i)
        room -= sizes[i]
        if room not in with_room:
            with_room[room] = []
            insort(rooms, room)
        with_room[room].append(b)
    left = {b: room for room, own in with_room.items() for b in own}
    return [(own, left[b]) for b, own in enumerate(bins)]


class _Local:
    """Round 0 of one partition: items are (doc_id, piece, start, length, crc)."""

    def __init__(self, partition: int, capacity: int):
        self.capacity, self.bin = capacity, partition << 40
        self.items: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        for piece, start in enumerate(range(0, n, self.capacity)):
            length = min(self.capacity, n - start)
            item = (doc_id, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
            if length == self.capacity:
                self._write([item], 0)
            else:
                self.items.append(item)

    def pack(self) -> None:
        items, self.items = self.items, []
        for own, room in best_fit([x[3] for x in items], self.capacity):
            self._write([items[i] for i in own], room)

    def _write(self, items: list[tuple], room: int) -> None:
        offset = 0
        for x in items:
            self.rows.append((*x, self.bin, offset, room))
            offset += x[3]
        self.bin += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=[x.split()[0] for x in _PIECES.split(", ")])


def _local_bins(docs: DataFrame, tokenizer_json: str, capacity: int, pool: int) -> DataFrame:
    with open(tokenizer_json, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    closing = array("I", [CLOSING_ID]).tobytes()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, local = Encoder.shared(tokenizer_json, shared.value), _Local(TaskContext.get().partitionId(), capacity)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                local.add(doc_id, encoder.ids(text.as_buffer().to_pybytes()) + closing)
                if len(local.items) >= pool or len(local.rows) >= pool:
                    local.pack()
                    yield local.batch()
        local.pack()
        yield local.batch()

    return id_and_text(docs).mapInArrow(apply, _PIECES)


def _merged(bins: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """One round over underfull bins: every group packs its bins as items. A merged bin lists where its members begin."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bin", "size", "members")))),
                      key=lambda r: r[0])
        out = []
        for own, room in best_fit([size for _, size, _ in rows], capacity):
            members, base = [], 0
            for i in own:
                members += [{"bin": m["bin"], "base": base + m["base"]} for m in rows[i][2]]
                base += rows[i][1]
            out.append((rows[own[0]][0], capacity - room, members))
        kind = pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), kind))],
                                         names=["bin", "size", "members"])

    return bins.repartition(groups, F.xxhash64("bin", F.lit(turn))).mapInArrow(apply, _BINS)


def _rounds(bins: DataFrame, capacity: int, slack: int, group: int) -> list[DataFrame]:
    """The bins (with members) that no further round changes."""
    done, turn, n = [], 0, bins.count()
    while n:
        groups = -(-n // group)
        after = staged(_merged(bins, groups, turn, capacity), f"round-{turn}")
        bins = after.where(F.col("size") < capacity - slack)
        made, left = after.count(), bins.count()
        if groups == 1 or n - made < n / 100:
            return [*done, after]
        done.append(after.where(F.col("size") >= capacity - slack))
        turn, n = turn + 1, left
    return done


def packed(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, slack: int = SLACK,
           pool: int = POOL, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(_local_bins(docs, tokenizer_json, capacity, pool), "pieces")
    open_bins = pieces.where((F.col("offset") == 0) & (F.col("room") > slack)).select(
        "bin", (F.lit(capacity) - F.col("room")).cast("int").alias("size"),
        F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = pieces.where(F.col("room") <= slack).withColumnRenamed("bin", "sequence_id").select(*columns)
    for final in _rounds(open_bins, capacity, slack, group):
        places = final.select(F.col("bin").alias("sequence_id"), F.inline("members")).select("sequence_id", "bin", "base")
        moved = pieces.where(F.col("room") > slack).join(places, "bin").withColumn("offset", F.col("offset") + F.col("base"))
        out = out.union(moved.select(*columns))
    return out
