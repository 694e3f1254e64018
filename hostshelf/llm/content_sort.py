"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort
puts equal texts next to each other, and each row is compared in full with its
neighbour. The range key is (first 32 bytes, hash, code points descending,
doc_id): splitters stay short whatever the text length, and a group of copies
of any size is spread over as many ranges as it needs. A group that a range
border cuts is joined again: only the first and last runs of the partitions
take part in that, matched by SHA-256.

Defined results: null text counts as empty; all texts without a visible
character form one group; of repeated rows (same id, same text) exactly one is
kept; null ids sort last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostshelf.llm.common import only, rows_of, split_join, staged

#: Bytes of the text in the range key; bounds what the splitter sample sends to the driver.
PREFIX_BYTES = 32
_RUN_SHIFT = 40
_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: code points of the text, its bytes without white space, and the short range key."""
    for batch in batches:
        body = [t.as_buffer().to_pybytes().translate(None, _SPACE) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pc.utf8_length(batch.column("text")), pa.array([x[:PREFIX_BYTES] for x in body], pa.binary()),
             pa.array(np.array([xxhash.xxh64_intdigest(x) for x in body], np.uint64).view(np.int64)), pa.array(body, pa.binary())],
            names=["doc_id", "text_key", "n", "prefix", "hash", "body"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; `head` marks the first row of each."""
    base, ordinal, last, digest = TaskContext.get().partitionId() << _RUN_SHIFT, -1, None, ""
    for batch in batches:
        run, head, sha = [], [], []
        for body in batch.column("body"):
            body = body.as_buffer()
            new = last is None or not body.equals(last)
            if new:
                ordinal, last = ordinal + 1, pa.py_buffer(body.to_pybytes())
                digest = hashlib.sha256(last).hexdigest()
            run.append(base + ordinal)
            head.append(new)
            sha.append(digest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(run, pa.int64()), pa.array(head, pa.bool_()), pa.array(sha, pa.string())],
            names=["doc_id", "text_key", "run", "head", "text_sha256"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, text_key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the row with the most
    code points in its original text, then the smallest doc_id, is kept.
    """
    rows = rows_of(docs).select("doc_id", "text_key", "text").mapInArrow(
        _normalised, "doc_id long, text_key long, n int, prefix binary, hash long, body binary")
    best = [F.col("n").desc(), F.col("doc_id").asc_nulls_last()]
    runs = staged(rows.repartitionByRange("prefix", "hash", *best).sortWithinPartitions("prefix", "hash", "body", *best)
                  .select("doc_id", "text_key", "body")
                  .mapInArrow(_runs, "doc_id long, text_key long, run long, head boolean, text_sha256 string"), "runs")

    heads = runs.where("head")
    part = F.shiftright("run", _RUN_SHIFT)
    ends = runs.groupBy(part.alias("part")).agg(F.min("run").alias("lo"), F.max("run").alias("hi"))
    ends = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("run"))
    cut = (heads.join(ends, "run").groupBy("text_sha256")
           .agg(F.min("run").alias("root"), F.count("*").alias("pieces")).where("pieces > 1"))
    moved = heads.join(ends, "run").join(cut, "text_sha256").select("run", "root")

    rows = runs.join(moved, "run", "left").withColumn("root", F.coalesce("root", "run"))
    sizes = rows.groupBy("root").agg(F.count("*").alias("group_size"))
    keepers = heads.select(F.col("run").alias("root"), F.col("doc_id").alias("keep_id")).join(sizes, "root")
    return split_join(rows, keepers, ["root"]).select(
        "doc_id", "text_key", "keep_id", "group_size", (F.col("head") & (F.col("run") == F.col("root"))).alias("kept"),
        "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    kept = exact_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ord"), "text_key")
    return only(docs, kept)


def report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(docs).drop("text_key")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id)
"""
