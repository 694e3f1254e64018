"""Suffix-array dedup with a common-prefix interval tree.

Removes each byte covered by a `window`-byte string that also starts earlier.
Blocks that can hold a repeat are found by `anchors`; the blocks of one gram
meet in one task, which builds an enhanced suffix array of them: the suffixes
that start a repeated window, in order, with the lengths of the prefixes that
neighbours share. A stack scan over these lengths walks the tree of common-
prefix intervals. An interval whose members have different bytes to the left
(or start a block) is a maximal repeat and is reported with all its
occurrences; in every interval all subtrees but the one with the earliest
occurrence lose theirs, so each suffix is marked once, with the longest prefix
that it shares with an earlier one.

Suffixes end where their block ends (at most 2 x window - gram bytes), so a
repeat longer than that is reported as a chain of overlapping groups; the bytes
removed are the same. Windows whose left neighbours are all equal need no
suffix: the window one byte further left covers them.

Defined results: null text is empty; matches do not cross documents; repeated
rows (same id, same text) have equal places, none of them earlier; null ids
come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostshelf.llm import anchors
from hostshelf.llm.anchors import Kind
from hostshelf.llm.common import rows_of

WINDOW, GRAM = 100, 24
#: Bytes of block text behind one suffix array.
PORTION = 1 << 20


def repeated_starts(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(starts, block, left byte) of the windows that stand in several places with different left sides."""
    length = hi - lo - window + 1
    block = np.repeat(np.arange(len(lo)), length)
    start = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + lo[block]
    code = text[start - 1].astype(np.int64)
    code[start == lo[block]] = -1
    if not len(start):
        return start, block, code
    hashed = anchors.Hasher(anchors._BYTE[text]).every(window)[start]
    order = np.argsort(hashed, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], np.diff(hashed[order]) != 0)))
    size = np.diff(np.concatenate((head, [len(order)])))
    low, high = np.minimum.reduceat(code[order], head), np.maximum.reduceat(code[order], head)
    keep = order[np.repeat((size > 1) & ((low < 0) | (low != high)), size)]
    code[start == lo[block]] = left[block[start == lo[block]]]
    return start[keep], block[keep], code[keep]


def suffix_array(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes text[start:stop], length of the prefix each shares with the next in order)."""
    size = stop - start
    width = int(size.max())
    at = start[:, None] + np.arange(width)
    rows = np.where(np.arange(width) < size[:, None], text[np.minimum(at, len(text) - 1)], 0).astype(np.uint8)
    order = np.argsort(size, kind="stable")  # numpy's strings end before their zeros: of such ties the shorter comes first
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{width}").ravel(), kind="stable")]
    rows, size = rows[order], size[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.minimum(shared, np.minimum(size[1:], size[:-1]))


def interval_tree(shared: list[int], place: list, floor: int) -> Iterator[tuple[int, int, int, int | None]]:
    """Stack scan: (first, last, depth, loser) for every merge of two neighbouring subtrees at `depth` >= floor.

    first..last are the suffixes of the interval so far; `loser` is the suffix
    whose place is the later one of the two subtrees' earliest (None on a tie).
    An interval is complete with the last of its merges.
    """
    stack: list[list[int]] = []  # depth, first, earliest
    for i in range(len(place)):
        depth_next = shared[i] if i < len(shared) else -1
        first, best = i, i
        while stack and stack[-1][0] > depth_next:
            depth, lo, other = stack.pop()
            loser = None if place[other] == place[best] else max(other, best, key=place.__getitem__)
            best = other if loser is None or loser == best else best
            first = lo
            yield first, i, depth, loser
        if depth_next >= floor:
            if stack and stack[-1][0] == depth_next:
                depth, lo, other = stack[-1]
                loser = None if place[other] == place[best] else max(other, best, key=place.__getitem__)
                stack[-1][2] = other if loser is None or loser == best else best
                yield lo, i, depth, loser
            else:
                stack.append([depth_next, first, best])


def _arrays(rows: dict[str, list], window: int):
    """Suffix array of one portion: order-sorted (block, offset in block, left byte), shared lengths, places."""
    text = np.frombuffer(b"".join(rows["body"]), np.uint8)
    size = np.fromiter(map(len, rows["body"]), np.int64, len(rows["body"]))
    hi = np.cumsum(size)
    lo = hi - size
    start, block, left = repeated_starts(text, lo, hi, np.array(rows["left"], np.int64), window)
    if not len(start):
        return None
    order, shared = suffix_array(text, start, hi[block])
    block, offset = block[order].tolist(), (start - lo[block])[order].tolist()
    place = [(rows["ord"][b], rows["s"][b] + o, rows["text_key"][b]) for b, o in zip(block, offset)]
    return block, offset, left[order], shared.tolist(), place


def _marks(window: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in anchors.grouped(batches, PORTION):
            if (found := _arrays(rows, window)) is None:
                continue
            block, offset, _, shared, place = found
            yield anchors.span_batch([(rows["ord"][block[x]], rows["text_key"][block[x]], place[x][1], depth)
                                      for _, _, depth, x in interval_tree(shared, place, window) if x is not None])
    return apply


def maximal_repeats(rows: dict[str, list], window: int) -> list[tuple[int, list[tuple]]]:
    """(length, occurrences as (ord, start, text_key)) of the left-diverse intervals of one portion."""
    if (found := _arrays(rows, window)) is None:
        return []
    block, offset, left, shared, place = found
    change = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    edge = np.cumsum([0, *(o == 0 for o in offset)])
    whole: dict[tuple[int, int], int] = {}
    for lo, hi, depth, _ in interval_tree(shared, place, window):
        whole[lo, depth] = hi
    return [(depth, sorted(place[lo:hi + 1])) for (lo, depth), hi in whole.items()
            if change[hi] > change[lo] or edge[hi + 1] > edge[lo]]


def repeat_groups(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Maximal repeats among the blocks' classes, one row per occurrence: group, length, doc_id, text_key, start, copies.

    `copies` says how many equal blocks stand behind an occurrence; a class of
    which no part stands in another class is a group of its own occurrences.
    """
    kind = Kind(False, window, gram)
    rows = rows_of(docs)
    classed = anchors.staged(anchors.with_classes(anchors.repeated_blocks(rows, kind)), "classed")
    texts = anchors.block_texts(anchors.representatives(classed)[0], rows, kind)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in anchors.grouped(batches, PORTION):
            copies = {(o, t, s + i): m for o, t, s, n, m in zip(*(part[c] for c in ("ord", "text_key", "s", "n", "members")))
                      for i in range(n - window + 1)}
            out = [(f"{length}:{occ[0][0]}:{occ[0][1]}:{occ[0][2]}", length, o, t, s, copies[o, t, s])
                   for length, occ in maximal_repeats(part, window) for o, s, t in occ]
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["group", "length", "ord", "text_key", "start", "copies"])

    inner = texts.repartition("h").sortWithinPartitions("h").mapInArrow(
        apply, "group string, length int, ord long, text_key long, start int, copies long")
    whole = classed.where("members > 1").selectExpr(
        "concat_ws(':', n, h, g) AS group", "n AS length", "ord", "text_key", "s AS start", "members AS copies")
    ids = rows.select("ord", "text_key", "doc_id").distinct()
    return inner.union(whole).join(ids, ["ord", "text_key"]).select("group", "length", "doc_id", "text_key", "start", "copies")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = anchors.CROWD) -> DataFrame:
    """One row per input row: doc_id, text_key, n_bytes, n_removed, n_spans, kept (binary)."""
    kind = Kind(False, window, gram)
    rows = rows_of(docs)
    found = anchors.spans(rows, kind, True, _marks(window), crowd)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                gone = anchors.covered(len(data), spans)
                n_bytes.append(len(data))
                n_removed.append(0 if gone is None else int(gone.sum()))
                n_spans.append(0 if gone is None else int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum()))
                kept.append((data if gone is None else data[~gone]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)),
                 pa.array(kept, pa.binary())], names=["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept"])

    return (anchors.with_spans(rows, found).select("doc_id", "text_key", "text", "spans")
            .mapInArrow(apply, "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept binary"))


def report(docs: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, **method).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
