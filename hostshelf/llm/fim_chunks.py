"""Fill-in-middle transformation with content-defined chunk memoization.

A document is cut at two places drawn from its id, and its parts are written
in another order with marks between them (psm: prefix, suffix, middle; spm:
suffix, prefix, middle), or left as it is (plain). The places are counted in
code points, while the text is handled as UTF-8 bytes:

* A rolling hash over the last `RADIX` bytes names the chunk ends, so equal
  passages are cut into equal chunks wherever they stand. A chunk is at most
  `LONGEST` bytes, so a text without any named end (one letter repeated) is cut
  at fixed steps.
* A worker keeps the chunks that it has met, by their whole content, with the
  summary of each: the code points that start in it and the bytes at its front
  that belong to the code point before it. A chunk may cut a code point; it
  counts where its first byte stands, so summaries of neighbours add up. The
  cache compares contents, so two chunks with one hash never share a summary.
  It is bounded in bytes and is emptied when full; that costs time, never rows.
* The running sums over a document's chunks give its length and the chunk that
  holds a cut; only that chunk is looked into.

One pass without a shuffle: every document is transformed where it is read.

Defined results: null text is empty (plain); a null id draws as an empty
string; rows are independent, so repeated rows give equal results; an empty
table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostshelf.llm.common import id_and_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, "1:"
#: Bytes that the rolling hash sees, one end per 2^BITS places on average, and the longest chunk.
RADIX, BITS, LONGEST = 32, 10, 8192
#: Bytes of chunks that a worker remembers.
CACHE_BYTES = 32 << 20
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _gear() -> np.ndarray:
    """A fixed pseudo-random number per byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text's bytes, the last one at its end.

    The hash at a place is the sum of its last `RADIX` bytes' numbers, each
    doubled once per step back; it is built by doubling the width seen.
    """
    h, seen = _GEAR[data], 1
    while seen < RADIX:
        h[seen:] = h[seen:] + (h[:-seen] << np.uint32(seen))
        seen *= 2
    named = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    ends = np.concatenate((named[named < len(data)], [len(data)]))
    gap = np.diff(ends, prepend=0)
    long = np.flatnonzero(gap > LONGEST)
    steps = [np.arange(ends[i] - gap[i] + LONGEST, ends[i], LONGEST) for i in long]
    return np.sort(np.concatenate((ends, *steps))) if steps else ends


def summary(chunk: bytes) -> tuple[int, int]:
    """(code points that start in the chunk, bytes at its front that continue the one before it)."""
    starts = np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)
    return len(starts), int(starts[0]) if len(starts) else len(chunk)


class ChunkCache:
    """Summaries by chunk content, bounded in bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.known = limit, 0, {}

    def summary(self, chunk: bytes) -> tuple[int, int]:
        found = self.known.get(chunk)
        if found is None:
            found = summary(chunk)
            if self.held + len(chunk) > self.limit:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        return found


class Units:
    """A document's chunks with the running sums of their code points."""

    def __init__(self, data: bytes, cache: ChunkCache):
        ends = chunk_ends(np.frombuffer(data, np.uint8)).tolist() if data else []
        self.data, self.starts = data, [0, *ends]
        found = [cache.summary(data[a:b]) for a, b in zip(self.starts, ends)]
        self.leads = [lead for _, lead in found]
        self.before = np.cumsum([0, *(units for units, _ in found)])
        self.n = int(self.before[-1])

    def byte_of(self, unit: int) -> int:
        """Where code point number `unit` starts; the end of the text for the one after the last."""
        if unit >= self.n:
            return len(self.data)
        at = int(np.searchsorted(self.before, unit, "right")) - 1
        begin, inside = self.starts[at], unit - int(self.before[at])
        if inside == 0:
            return begin + self.leads[at]
        chunk = np.frombuffer(self.data[begin:self.starts[at + 1]], np.uint8)
        return begin + int(np.flatnonzero((chunk & 0xC0) != 0x80)[inside])


def _draw(i: int) -> Column:
    digits = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long")


def _form(plain_percent: int, spm_percent: int) -> Column:
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    return (F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent), "plain")
            .when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))


def transformed(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per input row: doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output."""
    rows = id_and_text(docs).select("doc_id", "text", *[_draw(i).alias(f"h{i + 1}") for i in range(4)])
    rows = rows.select("doc_id", "text", "h1", "h2", _form(plain_percent, spm_percent).alias("form"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for b in batches:
            n, first, middle, output = [], [], [], []
            draws = zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("form").to_pylist())
            for text, (h1, h2, form) in zip(b.column("text"), draws):
                data = text.as_buffer().to_pybytes()
                units = Units(data, cache)
                n.append(units.n)
                if form == "plain":
                    first.append(None)
                    middle.append(None)
                    output.append(data)
                    continue
                lo, hi = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
                x, y = units.byte_of(lo), units.byte_of(hi)
                first.append(lo)
                middle.append(hi - lo)
                output.append(b"".join((p, data[:x], s, data[y:], m, data[x:y]) if form == "psm"
                                       else (s, data[y:], p, data[:x], m, data[x:y])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), b.column("form"), pa.array(first, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return rows.mapInArrow(apply, _SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text behind an output. The marks stand in no part, so each is found where it was put."""
    def part(before: str, after: str | None) -> Column:
        tail = F.split_part(output, F.lit(before), F.lit(2))
        return tail if after is None else F.split_part(tail, F.lit(after), F.lit(1))

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def report(docs: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return transformed(docs, **method).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                       OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain'
                  WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM o
"""
