"""Content-chosen blocks: the common first half of both substring dedups.

Every window of W units (bytes or words) names the smallest k-gram inside it
(a minimizer, ties to the left). Equal windows name the same gram at the same
place, wherever they stand. The windows of a text that name one gram occurrence
are neighbours; the stretch they cover is a block of at most 2W - k units.
So two equal windows always lie in two blocks of the same gram, and

* a block whose gram occurs once in the corpus holds no repeat (most of the
  corpus stops here, after a shuffle of gram hashes);
* blocks equal as a whole form a class: one row per class goes on, with its
  number of members and the place of the first;
* only grams with several classes need their text compared (`contested`).

`crowded` is the way for a gram with very many classes (blocks at the edges of
a very common passage): its windows are grouped one by one, with a map-side
combined minimum and a join that adaptive execution can split, instead of
meeting in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostshelf.llm.common import split_join, staged

#: Units handled at once in a task; longer texts are cut into pieces that overlap by one window.
CHUNK = 1 << 20
#: Classes of one gram that may meet in one task.
CROWD = 20_000
_PLACE_BITS = 28
_SPANS = "ord long, text_key long, s int, n int"
_TEXTS = "ord long, text_key long, h long, s int, n int, members long, rivals long, left int, body binary"
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


class Kind(NamedTuple):
    """What a window is made of."""
    words: bool
    window: int
    gram: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i < n."""
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for j, b in enumerate((_BASE, inverse)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[j] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Hasher:
    """Hashes of any stretches of an array of unit values."""

    def __init__(self, units: np.ndarray):
        power, self.inverse = _powers(len(units) + 1)
        self.prefix = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * power[:-1], out=self.prefix[1:])

    def __call__(self, start, stop) -> np.ndarray:
        return _mix((self.prefix[stop] - self.prefix[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        """All stretches of k units."""
        n = max(0, len(self.prefix) - k)
        return _mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, span = len(x) - w + 1, 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span:w - span + n])


def blocks(units: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """(gram hash, block hash, text index, start, length) of the blocks of the texts units[lo:hi]."""
    w, k = kind.window, kind.gram
    long = hi - lo >= w
    if not long.any():
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    hashed = Hasher(units)
    grams = hashed.every(k)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    named = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), w - k + 1) & low
    edge = np.zeros(len(units) + 2, np.int8)
    edge[lo[long]] += 1
    edge[hi[long] - w + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge, dtype=np.int8)[:len(named)])
    named = named[at]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(named) != 0) | (np.diff(at) != 1))))
    first, last = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
    length = last - first + w
    text = np.searchsorted(lo, first, "right") - 1
    # texts without units share a start with the next one; the last of them is the one that has units
    return grams[named[new].astype(np.int64)], hashed(first, first + length), text, first - lo[text], length


def word_units(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts data[lo:hi] (bytes), and the texts' bounds among them."""
    units = []
    at, stop = 0, len(data)
    starts_all = []
    border = np.zeros(len(data) + 1, bool)
    border[lo] = True
    border[hi] = True
    while at < stop:
        to = min(stop, at + 4 * CHUNK)
        while to < stop and not _SEP[data[to]] and not border[to]:  # a piece ends between words
            to += 1
        part = data[at:to]
        word = ~_SEP[part]
        before = np.concatenate(([False], word[:-1])) & ~border[at:to]
        after = np.concatenate((word[1:], [False])) & ~border[at + 1:to + 1]
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        units.append(Hasher(_BYTE[part])(start, end))
        starts_all.append(start + at)
        at = to
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    units = np.concatenate(units) if units else np.zeros(0, np.uint64)
    return units, np.searchsorted(starts, lo), np.searchsorted(starts, hi)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes; a longer text comes alone."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def batch_blocks(column: pa.Array, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """`blocks` of an Arrow text column, chunk by chunk; text indexes are places in the column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    for i, j in _chunks(offsets):
        part = data[offsets[i]:offsets[j]]
        lo, hi = offsets[i:j] - offsets[i], offsets[i + 1:j + 1] - offsets[i]
        if kind.words:
            units, lo, hi = word_units(part, lo, hi)
        else:
            units = _BYTE[part] if j > i + 1 or len(part) <= 2 * CHUNK else part
        if j > i + 1 or len(units) <= 2 * CHUNK:
            h, g, text, s, n = blocks(units, lo, hi, kind)
            yield h, g, text + i, s, n
            continue
        for at in range(0, len(units), CHUNK):  # one very long text
            piece = units[at:at + CHUNK + kind.window - 1]
            piece = piece if kind.words else _BYTE[piece]
            h, g, text, s, n = blocks(piece, np.zeros(1, np.int64), np.array([len(piece)]), kind)
            yield h, g, text + i, s + at, n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _gram_counts(kind: Kind) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x[0] for x in batch_blocks(b.column("text"), kind)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], names=["h", "n"])
    return apply


def _block_rows(kind: Kind) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, g, text, s, n in batch_blocks(b.column("text"), kind):
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(g), b.column("ord").take(pa.array(text)), b.column("text_key").take(pa.array(text)),
                     pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "g", "ord", "text_key", "s", "n"])
    return apply


def repeated_blocks(rows: DataFrame, kind: Kind) -> DataFrame:
    """Blocks (h, g, ord, text_key, s, n, place) of the grams that occur more than once. `place` orders all blocks of the corpus."""
    counts = (rows.select("text").mapInArrow(_gram_counts(kind), "h long, n long")
              .groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    found = rows.select("ord", "text_key", "text").mapInArrow(
        _block_rows(kind), "h long, g long, ord long, text_key long, s int, n int")
    return staged(split_join(found, counts, ["h"]), "blocks").withColumn(
        "place", F.col("ord").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("s"))


def with_classes(found: DataFrame) -> DataFrame:
    """`found` plus its class's `members` and `first` place."""
    classes = found.groupBy("h", "g", "n").agg(F.count("*").alias("members"), F.min("place").alias("first"))
    return split_join(found, classes, ["h", "g", "n"])


def representatives(classed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first block of every class of a contested gram with `rivals`, the number of its gram's classes; those numbers)."""
    reps = classed.where("place = first").dropDuplicates(["h", "g", "n"])
    rivals = reps.groupBy("h").agg(F.count("*").alias("rivals")).where("rivals > 1")
    return split_join(reps, rivals, ["h"]), rivals


def block_texts(reps: DataFrame, rows: DataFrame, kind: Kind, then: Callable | None = None, schema: str = _TEXTS) -> DataFrame:
    """`reps` with `body`: the block's bytes, or its words joined by one space; `left` is the byte before it, or -1.

    `then` makes other rows of `schema` from them in the same Python worker.
    """
    fields = ["h", "s", "n", "members", "rivals"]
    by_doc = reps.groupBy("ord", "text_key").agg(F.collect_list(F.struct(*fields)).alias("blocks"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in ("ord", "text_key", *fields, "left", "body")}
            for ord_, key, text, found in zip(b.column("ord").to_pylist(), b.column("text_key").to_pylist(),
                                              b.column("text"), b.column("blocks").to_pylist()):
                data = text.as_buffer().to_pybytes()
                units = data.split() if kind.words else data
                for x in found:
                    s, e = x["s"], x["s"] + x["n"]
                    for c in fields:
                        out[c].append(x[c])
                    out["ord"].append(ord_)
                    out["text_key"].append(key)
                    out["left"].append(-1 if kind.words or not s else data[s - 1])
                    out["body"].append(b" ".join(units[s:e]) if kind.words else data[s:e])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("ord", pa.int64()), ("text_key", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32()),
                ("members", pa.int64()), ("rivals", pa.int64()), ("left", pa.int32()), ("body", pa.binary())]))

    # All columns of `rows`, so that `with_spans` can use the same exchange of the documents again.
    return (by_doc.join(rows, ["ord", "text_key"])
            .mapInArrow(lambda batches: then(apply(batches)) if then else apply(batches), schema))


def grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, list]]:
    """Rows sorted by h, in portions of about `limit` bytes of body that never cut a gram; repeated rows appear once."""
    held, seen, size, last = {}, set(), 0, None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        for i, h in enumerate(cols["h"]):
            if h != last:
                seen = set()
                if size >= limit:
                    yield held
                    held, size = {}, 0
            own = cols["ord"][i], cols["text_key"][i], cols["s"][i]
            if own not in seen:
                seen.add(own)
                size += len(cols["body"][i])
                for c, values in cols.items():
                    held.setdefault(c, []).append(values[i])
            last = h
    if held:
        yield held


def span_batch(found: list[tuple]) -> pa.RecordBatch:
    """(ord, text_key, s, n) tuples as a batch."""
    kinds = {"ord": pa.int64(), "text_key": pa.int64(), "s": pa.int32(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def crowded(reps: DataFrame, rows: DataFrame, kind: Kind, first_only: bool) -> DataFrame:
    """Spans (ord, text_key, s, n) of repeated windows in the blocks `reps`, grouped window by window (see the module's head)."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, body in enumerate(b.column("body").to_pylist()):
                if kind.words:
                    units, *_ = word_units(np.frombuffer(body, np.uint8), np.zeros(1, np.int64), np.array([len(body)]))
                else:
                    units = _BYTE[np.frombuffer(body, np.uint8)]
                w = Hasher(units).every(kind.window)
                k = np.full(len(w), i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("h").take(pa.array(k)), _signed(w), b.column("ord").take(pa.array(k)),
                     b.column("text_key").take(pa.array(k)), b.column("members").take(pa.array(k)),
                     pa.array(np.arange(len(w), dtype=np.int32) + b.column("s")[i].as_py(), pa.int32())],
                    names=["h", "w", "ord", "text_key", "members", "s"])

    each = block_texts(reps, rows, kind, windows, "h long, w long, ord long, text_key long, members long, s int").withColumn(
        "place", F.col("ord").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("s"))
    again = each.groupBy("h", "w").agg(F.sum("members").alias("all"), F.min("place").alias("first")).where("all > 1")
    found = each.join(again, ["h", "w"])
    found = found.where("place > first") if first_only else found
    return found.select("ord", "text_key", "s", F.lit(kind.window).alias("n"))


def spans(rows: DataFrame, kind: Kind, first_only: bool, in_task: Callable, crowd: int = CROWD) -> DataFrame:
    """Spans (ord, text_key, s, n) to remove: all places of repeated windows, or all but the first of each.

    `in_task` gets an iterator of batches of `block_texts`, sorted by gram, and yields such spans.
    Spans that touch are `merged` where they are found, in the same Python worker: a second
    one behind it would hold its memory beside the first in every running task.
    """
    classed = staged(with_classes(repeated_blocks(rows, kind)), "classed")
    reps, rivals = representatives(classed)
    whole = classed.where("place > first" if first_only else "members > 1").select("ord", "text_key", "s", "n").mapInArrow(merged, _SPANS)
    few = (block_texts(reps.where(F.col("rivals") <= crowd), rows, kind).repartition("h").sortWithinPartitions("h")
           .mapInArrow(lambda batches: merged(in_task(batches)), _SPANS))
    many = F.col("rivals") > crowd
    if rivals.where(many).isEmpty():
        return whole.union(few)
    return whole.union(few).union(crowded(reps.where(many), rows, kind, first_only).mapInArrow(merged, _SPANS))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (ord, text_key, s, n) of a batch that touch or overlap, as one."""
    for b in batches:
        ord_, key, s, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "text_key", "s", "n"))
        order = np.lexsort((s, key, ord_))
        ord_, key, s, e = ord_[order], key[order], s[order].astype(np.int64), (s + n)[order].astype(np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (ord_[1:] != ord_[:-1]) | (key[1:] != key[:-1])
        doc = np.cumsum(new)
        far = np.maximum.accumulate(e + (doc << 32)) - (doc << 32)  # the largest end so far within the document
        new[1:] |= s[1:] > far[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        if len(first):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ord_[first]), pa.array(key[first]), pa.array(s[first].astype(np.int32)),
                 pa.array((far[last] - s[first]).astype(np.int32))], names=["ord", "text_key", "s", "n"])


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` plus `spans`, an array of (s, n), null where there is none.

    `found` comes merged batch by batch from `spans`: a long run of one letter has
    a span per byte, and these lie together since their grams are equal.
    """
    by_doc = found.groupBy("ord", "text_key").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    return rows.join(by_doc, ["ord", "text_key"], "left")


def covered(n: int, found: list[dict] | None) -> np.ndarray | None:
    """Mask of the units that the spans cover; None if there are none."""
    if not found:
        return None
    edge = np.zeros(n + 1, np.int64)
    s = np.fromiter((x["s"] for x in found), np.int64, len(found))
    e = s + np.fromiter((x["n"] for x in found), np.int64, len(found))
    np.add.at(edge, s, 1)
    np.subtract.at(edge, e, 1)
    return np.cumsum(edge[:-1]) > 0
