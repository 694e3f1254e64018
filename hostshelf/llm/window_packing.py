"""Hierarchical multi-length packing of token ids into training windows.

A document is its ids plus a closing id 0. Whole long windows are cut off
first; what is left is routed to the smallest tier (128, 256, 512, 1024) that
holds it. Tiers are packed from the longest down: every window starts with an
item of its own tier, its gap takes the best-fitting whole items of the
shorter tiers, and a last gap is closed by cutting one item. Windows of every
tier are full and a power of two long, so they need no padding; only the last
window of each input partition may be short. Full sequences are dealt to step
groups of equal token counts, tier by tier.

One pass without a shuffle: a partition is packed in pools of a bounded number
of tokens and hands its open items on to the next pool, so memory does not
depend on the input. Ids carry the partition number; with a file scan or a
staged table as input, a task that is run again gives the same rows.

Defined results: null text is empty (one token, the closing id); repeated rows
are packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hostshelf.llm import vocab
from hostshelf.llm.common import id_and_text

TIERS = (128, 256, 512, 1024)
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
CLOSING_ID = 0
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


class _Packer:
    """Packs the items of one partition. An item is (length, number, doc_id, start, doc_tokens, ids)."""

    def __init__(self, partition: int, tiers: tuple[int, ...]):
        self.tiers, self.base = tiers, partition << 40
        self.sequence, self.number = 0, 0
        self.dealt = dict.fromkeys(tiers, 0)
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        longest, n = self.tiers[-1], len(ids)
        for at in range(0, n - n % longest, longest):
            self._write(longest, [self._item(doc_id, at, n, ids[at:at + longest])])
        if n % longest:
            insort(self.open, self._item(doc_id, n - n % longest, n, ids[n - n % longest:]))

    def _item(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> tuple:
        self.number += 1
        return len(ids), self.number, doc_id, start, doc_tokens, ids

    def _write(self, tier: int, items: list[tuple]) -> None:
        sequence, offset = self.base + self.sequence, 0
        step = self.base + (self.tiers.index(tier) << 36) + self.dealt[tier] * tier // STEP_TOKENS
        for length, _, doc_id, start, doc_tokens, ids in items:
            self.rows.append((doc_id, start, length, zlib.crc32(ids.tobytes()), doc_tokens, sequence, offset, tier, step))
            offset += length
        self.sequence += 1
        self.dealt[tier] += 1

    def _fill(self, room: int) -> list[tuple]:
        """Items that fill `room` exactly if there are enough tokens: best whole fits first, then one cut."""
        taken = []
        while room and self.open:
            at = bisect_right(self.open, (room, float("inf")))
            if at:
                taken.append(self.open.pop(at - 1))
                room -= taken[-1][0]
            else:
                _, _, doc_id, start, doc_tokens, ids = self.open.pop(0)
                taken.append(self._item(doc_id, start, doc_tokens, ids[:room]))
                insort(self.open, self._item(doc_id, start + room, doc_tokens, ids[room:]))
                room = 0
        return taken

    def pack(self, last: bool = False) -> None:
        """Write full windows, longest tier first; the rest stays open unless this is the `last` call."""
        left = sum(x[0] for x in self.open)
        for below, tier in reversed(list(zip((0, *self.tiers), self.tiers))):
            while self.open and left >= tier and self.open[-1][0] > below:
                self._write(tier, self._fill(tier))
                left -= tier
        if last and self.open:
            self._write(self.tiers[-1], self._fill(self.tiers[-1]))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def packed(docs: DataFrame, tokenizer_json: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece; `offset` is its place in sequence `sequence_id`, `tier` the window's length."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab.json_file(tokenizer_json))  # one vocabulary file
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the same file

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.encoding(tokenizer_json, *shared.value)
        packer, held = _Packer(TaskContext.get().partitionId(), tiers), 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                try:
                    ids = enc.encode_to_numpy(text.as_py(), allowed_special="all")
                except ValueError:  # a run of white space too long for the pattern's stack
                    ids = vocab.tokenizer(tokenizer_json, spec.value).encode(text.as_py(), add_special_tokens=False).ids
                ids = np.append(np.asarray(ids, "<u4"), np.uint32(CLOSING_ID)).astype("<u4")
                packer.add(doc_id, ids)
                held += len(ids)
                if held >= POOL_TOKENS:
                    packer.pack()
                    yield packer.batch()
                    held = 0
        packer.pack(last=True)
        yield packer.batch()

    return id_and_text(docs).mapInArrow(apply, SCHEMA)
