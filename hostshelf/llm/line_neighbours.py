"""Line dedup by a deletion-neighbourhood join.

A line is removed if an earlier line (smaller doc_id, or higher up in the same
document) is equal or at edit distance 1 (one character replaced, added or
left out). Lines under `min_chars` characters must be equal, and lines without
a visible character are left alone.

Distinct lines emit the hashed keys of their one-character deletions: deletion
and place for a replacement, the deletion alone against the whole of a shorter
line. Equal keys are joined through a grouped minimum of the earliest place, so
a key shared by any number of lines costs one row per line and never a row per
pair; the partner found is verified by its edit distance. A long line has as
many deletions as characters, so two lossless rounds narrow them down first:
lines at distance 1 agree outside the part that holds the edit, for halves of
the line and then for sixteenths of these; only parts in which another line
agrees emit their deletions.

Defined results: null text has no lines; of equal lines in repeated rows (same
id, same text) none is earlier; null ids come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostshelf.llm.anchors import Hasher, _mix
from hostshelf.llm.common import rows_of, split_join, staged

MIN_CHARS = 20
HALVES, SIXTEENTHS = 2, 16
_TAGS = 1 << 29
_CHUNK = 1 << 20
_SEPARATOR = np.uint32(10)
_BLANK = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
_KEY = "key long, a long, b long, role int, lo int, hi int"


def _units(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return points, _mix(points.astype(np.uint64) + np.uint64(0x51ED270B))


def _joined(*parts) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for i, p in enumerate(parts):
        out = _mix((out ^ np.asarray(p).astype(np.uint64)) + np.uint64(i + 1))
    return out


def part_keys(hashed: Hasher, start, size, role, lo, hi, parts: int) -> tuple[np.ndarray, ...]:
    """(row, key, lo, hi): keys of the parts of the regions [lo, hi) of edit places, for lines at start with `size` units.

    Role 0 is a line as long as its partner or the shorter one, role 1 the
    longer one; both speak of the shorter length m, so places run from 0 to m.
    """
    m = size - role
    cut = lo[:, None] + (hi - lo)[:, None] * np.arange(parts + 1) // parts
    x, y = cut[:, :-1], cut[:, 1:]
    row, part = np.nonzero(y > x)
    x, y = x[row, part], y[row, part]
    begin, end, m = start[row], start[row] + size[row], m[row]
    tail = np.maximum(0, m - y)
    return row, _joined(hashed(begin, begin + x), hashed(end - tail, end), m, x, y), x, y


def _lines(min_chars: int) -> Callable:
    """(a, b, ord, text_key, line, size, keys): visible lines, their 128-bit identity and the keys of their halves."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= _CHUNK):
                    held += len(texts[to])
                    to += 1
                whole = "\n".join(texts[at:to])
                lines = whole.encode().split(b"\n")
                points, units = _units(whole)
                stop = np.concatenate((np.flatnonzero(points == _SEPARATOR), [len(points)]))
                start = np.concatenate(([0], stop[:-1] + 1))
                seen = np.concatenate(([0], np.cumsum(~np.isin(points, _BLANK))))
                per_doc = np.array([t.count("\n") + 1 for t in texts[at:to]])
                doc = np.repeat(np.arange(at, to), per_doc)
                number = np.arange(len(lines)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                shown = np.flatnonzero(seen[stop] > seen[start])
                name = np.frombuffer(b"".join([xxhash.xxh3_128_digest(lines[i]) for i in shown.tolist()]), "<i8").reshape(-1, 2)
                start, size = start[shown], (stop - start)[shown]
                hashed, keys = Hasher(units), np.zeros((len(shown), 2 * HALVES), np.uint64)
                long = np.flatnonzero(size >= min_chars)
                for role in (0, 1):
                    if len(long):
                        zero = np.zeros(len(long), np.int64)
                        row, key, *_ = part_keys(hashed, start[long], size[long], zero + role, zero, size[long] - role + 1, HALVES)
                        keys[long, role * HALVES:(role + 1) * HALVES] = key.reshape(-1, HALVES)
                where = pa.array(doc[shown])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[:, 0]), pa.array(name[:, 1]), batch.column("ord").take(where), batch.column("text_key").take(where),
                     pa.array(number[shown].astype(np.int32)), pa.array(size.astype(np.int32)),
                     *[pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in range(2 * HALVES)]],
                    names=["a", "b", "ord", "text_key", "line", "size", *(f"k{i}" for i in range(2 * HALVES))])
                at = to
    return apply


def _agreeing(keys: DataFrame) -> DataFrame:
    """The regions of `keys` in which another line has the same key, per line."""
    ends = [f(c).alias(f"{c}{i}") for c in ("a", "b") for i, f in enumerate((F.min, F.max))]
    shared = keys.groupBy("key").agg(*ends).where("a0 < a1 OR b0 < b1").select("key")
    return (split_join(keys, shared, ["key"]).groupBy("a", "b")
            .agg(F.collect_list(F.struct("role", "lo", "hi")).alias("regions")))


def _each_region(batches: Iterator[pa.RecordBatch]):
    """Per batch of lines with regions: the batch, a hasher, and per region its line, start, size, role, lo, hi."""
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        regions = batch.column("regions").to_pylist()
        size = np.array([len(x) for x in bodies], np.int64)
        _, units = _units("".join(bodies))
        start = np.cumsum(size) - size
        line = np.repeat(np.arange(len(bodies)), [len(r) for r in regions])
        role, lo, hi = (np.array([r[c] for x in regions for r in x], np.int64) for c in ("role", "lo", "hi"))
        if len(line):
            yield batch, Hasher(units), line, start[line], size[line], role, lo, hi


def _narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, hashed, line, start, size, role, lo, hi in _each_region(batches):
        row, key, x, y = part_keys(hashed, start, size, role, lo, hi, SIXTEENTHS)
        where = pa.array(line[row])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), batch.column("a").take(where), batch.column("b").take(where),
             *(pa.array(v.astype(np.int32)) for v in (role[row], x, y))], names=[x.split()[0] for x in _KEY.split(", ")])


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, a, b, first): kind 0 is a deletion with its place, 1 the whole shorter line, 2 a longer line's deletion."""
    for batch, hashed, line, start, size, role, lo, hi in _each_region(batches):
        count = hi - lo
        row = np.repeat(np.arange(len(lo)), count)
        x = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
        begin, end, role, m = start[row], start[row] + size[row], role[row], (size - role)[row]
        head = hashed(begin, begin + x)
        some = (role == 0) & (x < m)
        replaced = _joined(head[some], hashed(begin[some] + x[some] + 1, end[some]), m[some], x[some], 0)
        shifted = _joined(head, hashed(end - (m - x), end), m, x, 1)
        key = np.concatenate((replaced, shifted))
        kind = np.concatenate((np.zeros(some.sum(), np.int8), 1 + role.astype(np.int8)))
        where = pa.array(np.concatenate((line[row][some], line[row])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(kind), *(batch.column(c).take(where) for c in ("a", "b", "first"))],
            names=["key", "kind", "a", "b", "first"])


def _bodies(firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """`firsts` (a, b, first, regions and where the line stands) with `body`, the line's text."""
    by_doc = firsts.groupBy("ord", "text_key").agg(F.collect_list(F.struct("line", "a", "b", "first", "regions")).alias("x"))
    found = by_doc.join(rows.select("ord", "text_key", "text"), ["ord", "text_key"])
    return (found.select(F.split("text", "\n").alias("lines"), "x")
            .select(F.transform("x", lambda x: x.withField("body", F.get("lines", x["line"]))).alias("x"))
            .select(F.inline("x")).drop("line").dropDuplicates(["a", "b"]))  # repeated rows


def earlier_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(lines, links): all visible lines with the `first` place of their text, and for each text with an earlier
    neighbour at distance 1 the place of the earliest such neighbour."""
    place = F.col("ord").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line")
    # The same with some bits of the text's key, so that lines at one place of different texts are told apart.
    spot = lambda: (F.col("place") * F.lit(_TAGS).cast("decimal(9,0)") + F.col("text_key").bitwiseAND(_TAGS - 1)).cast("decimal(38,0)")
    lines = staged(rows.select("ord", "text_key", "text").mapInArrow(
        _lines(min_chars), "a long, b long, ord long, text_key long, line int, size int, "
        + ", ".join(f"k{i} long" for i in range(2 * HALVES))).withColumn("place", place), "lines")
    texts = staged(lines.groupBy("a", "b").agg(
        F.min("place").alias("first"), F.min(spot()).alias("spot"), F.min("size").alias("size"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(2 * HALVES)]), "texts")

    def halves(role: int) -> list[Column]:
        last = F.col("size") - role + 1
        half = (last / HALVES).cast("int")
        ends = (F.lit(0), half, last)
        return [F.struct(F.col(f"k{role * HALVES + i}").alias("key"), F.lit(role).alias("role"),
                         ends[i].alias("lo"), ends[i + 1].alias("hi")) for i in range(HALVES)]

    keys = (texts.where(F.col("size") >= min_chars).select("a", "b", F.explode(F.array(*halves(0), *halves(1))).alias("k"))
            .select("k.key", "a", "b", "k.role", "k.lo", "k.hi"))
    regions = staged(_agreeing(keys), "halves")
    standing = lines.select("a", "b", spot().alias("at"), "ord", "text_key", "line")
    firsts = (regions.join(texts.select("a", "b", F.col("spot").alias("first")), ["a", "b"])
              .join(standing, ["a", "b"]).where("at = first").dropDuplicates(["a", "b"]))
    near = staged(_bodies(firsts, rows), "near")
    regions = _agreeing(near.select("a", "b", "body", "regions").mapInArrow(_narrower, _KEY))
    near = staged(near.drop("regions").join(regions, ["a", "b"]), "nearer")

    each = near.mapInArrow(_deletions, "key long, kind byte, a long, b long, first decimal(38,0)")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("first")))
    least = each.groupBy("key").agg(*[of(i).alias(f"p{i}") for i in range(3)])
    partner = F.when(F.col("kind") == 0, F.col("p0")).when(F.col("kind") == 1, F.col("p2")).otherwise(F.col("p1"))
    coarse = lambda c: F.col(c) - F.col(c) % F.lit(_TAGS).cast("decimal(9,0)")
    found = (split_join(each, least, ["key"]).withColumn("partner", partner).where(coarse("partner") < coarse("first"))
             .groupBy("a", "b").agg(F.min("partner").alias("partner")))
    bodies = near.select("a", "b", "body")
    other = near.select(F.col("first").alias("partner"), F.col("body").alias("other"))  # all bodies that share a spot
    links = (found.join(bodies, ["a", "b"]).join(other, "partner")
             .where(F.levenshtein("body", "other", 1) == 1).select("a", "b", "partner").dropDuplicates(["a", "b"]))
    return lines.join(texts.select("a", "b", "first"), ["a", "b"]), staged(links, "links")


def without_near_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_lines (with a visible character), n_removed, n_near, kept (remaining lines joined by \\n)."""
    rows = rows_of(docs)
    lines, links = earlier_lines(rows, min_chars)
    gone = (lines.join(links, ["a", "b"], "left").where("place > first OR partner IS NOT NULL")
            .select("ord", "text_key", "line", (F.col("place") == F.col("first")).alias("near")).distinct()
            .groupBy("ord", "text_key").agg(F.collect_list("line").alias("gone"), F.sum(F.col("near").cast("long")).alias("n_near")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_removed, kept = [], [], []
            for text, out in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                own, out = text.split("\n"), set(out or ())
                n_lines.append(sum(1 for x in own if x.strip(" \t\n\r\x0b\x0c")))
                n_removed.append(len(out))
                kept.append("\n".join([x for i, x in enumerate(own) if i not in out]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()),
                 b.column("n_near"), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_near", "kept"])

    return (rows.join(gone, ["ord", "text_key"], "left").select("doc_id", "text", "gone", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
            .mapInArrow(apply, "doc_id long, n_lines long, n_removed long, n_near long, kept string"))


def report(docs: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_near (those without an earlier equal line), kept_sha256."""
    return without_near_lines(docs, **method).select(
        "doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept", 256).alias("kept_sha256"))
