"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

Bit i of a fingerprint gets a vector m(i) of F_2^(r+1). Table v (each non-zero
v) keeps the bits with <m(i), v> = 1. Up to r differing positions span at most
r dimensions, so some v is orthogonal to all of them: that table drops every
differing bit and the pair meets there. No pair within the radius is missed.

Only distinct fingerprints go into the tables, so a group of equal texts costs
one row per table. A bucket gives a spanning forest of its links, at most one
edge per member and never all pairs; the components of these edges are those
of the whole link graph. A crowded bucket is cut again by bands of the bits
that its table dropped (r + 1 bands, one of which must agree).

Defined results: null or wordless text has fingerprint zero and is linked like
any other; repeated rows share a fingerprint; null ids never become a
component id unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostshelf.llm.common import components, keyed, only, staged

BITS = 64
_BLOCK = 512
_CROWDED = 4096


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in more than half of the shingles' XXH64 values."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space are touched
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        ends, starts = ends[shingle - 1:], starts[:len(words) - shingle + 1]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key and fp (the 64 bits as a signed long) of every row."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "fp"])
    return keyed(docs).mapInArrow(apply, "doc_id long, text_key long, fp long")


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 bit masks; m(i) runs through the non-zero vectors in turn."""
    size = 2 ** (radius + 1) - 1
    vector = [i % size + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class _Forest:
    """Union-find over the positions of one bucket."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _link(fps: np.ndarray, at: np.ndarray, forest: _Forest, radius: int) -> None:
    """Unite all positions in `at` whose fingerprints differ in at most `radius` bits, block by block."""
    own = fps[at]
    for i in range(0, len(at), _BLOCK):
        for j in range(i, len(at), 8 * _BLOCK):
            near = np.bitwise_count(own[i:i + _BLOCK, None] ^ own[None, j:j + 8 * _BLOCK]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                root = forest.roots()
                pairs = np.unique(np.stack([root[at[i + x]], root[at[j + y]]], axis=1), axis=0)
                for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
                    forest.union(a, b)


def bucket_edges(fps: np.ndarray, dropped: int, radius: int) -> np.ndarray:
    """(n, 2) edges of a spanning forest of the links among the distinct `fps` of one bucket."""
    forest, everyone = _Forest(len(fps)), np.arange(len(fps))
    if len(fps) <= _CROWDED:
        _link(fps, everyone, forest, radius)
    else:
        bits = [i for i in range(BITS) if dropped >> i & 1]
        for band in range(radius + 1):
            mask = np.uint64(sum(1 << i for i in bits[band::radius + 1]))
            key = fps & mask
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(part) > 1:
                    _link(fps, np.sort(part), forest, radius)
    root = forest.roots()
    at = np.flatnonzero(root != everyone)
    return np.stack([fps[at], fps[root[at]]], axis=1)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links within `radius`."""
    tables = masks(radius)
    rows = fps.select("fp", F.explode(F.array([
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
        for i, m in enumerate(tables)])).alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _ended(batches):
            if b is not None:
                now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k", "fp")]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if rest is None or not len(rest[0]):
                continue
            t, k, fp = rest
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            stop = len(t) if b is None else (cuts[-1] if len(cuts) else 0)
            bounds = np.concatenate(([0], cuts[cuts < stop], [stop])) if stop else np.zeros(1, int)
            size, found = np.diff(bounds), []
            two = bounds[:-1][size == 2]
            x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= radius
            found.append(np.stack([x[near], y[near]], axis=1))
            for i in np.flatnonzero(size > 2):
                lo, hi = bounds[i], bounds[i + 1]
                dropped = ~tables[t[lo]] & (1 << BITS) - 1
                found.append(bucket_edges(np.ascontiguousarray(fp[lo:hi]).view(np.uint64), dropped, radius))
            rest = [c[stop:] for c in rest]
            out = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return (rows.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
            .mapInArrow(edges, "a long, b long"))


def _ended(batches):
    yield from batches
    yield None


def near_components(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, text_key, fingerprint (16 hex digits), component_id (smallest doc_id reachable), root."""
    rows = staged(fingerprints(docs, shingle, seed), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(fps, radius))
    labelled = (fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                .withColumn("root", F.coalesce("root", "fp")))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(by_fp, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def report(docs: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    return near_components(docs, **method).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, **method) -> DataFrame:
    """Of each component the row with the smallest doc_id (then text key), with its own columns."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ord"), "text_key"))
    return only(docs, near_components(docs, **method).groupBy("root").agg(first.alias("x")).select("x.*"))
