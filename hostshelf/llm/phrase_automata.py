"""Substring dedup with repeated-phrase automata.

Removes every word that lies in a window of `window` words whose word sequence
also stands anywhere else (all places go, the first included). Recurring
passages are confirmed per gram (see `anchors`: equal windows always meet in
the blocks of one gram), compiled into Aho-Corasick automata over word numbers,
and the blocks of all documents that hold the gram are streamed through the
automaton to locate every occurrence. An automaton holds the passages of one
portion of a shard, so its size is bounded, and a document is only sent to the
automata that can match it: total work follows the input, not input x patterns.

Defined results: null text has no words; texts shorter than a window stay
whole; repeated rows count as separate places, so their windows go; null ids
are kept apart by their text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostshelf.llm import anchors
from hostshelf.llm.anchors import Kind
from hostshelf.llm.common import rows_of

WINDOW, GRAM = 35, 8
#: Bytes of block text behind one automaton.
PORTION = 1 << 20


def _window_numbers(words: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal windows, by the numbers of their parts (powers of two long): exact, and 8 bytes a place."""
    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]

    if len(words) < window:
        return words[:0]
    part, span, number, done = words, 1, None, 0
    while True:
        if window & span:
            number = part if number is None else paired(number[:len(part) - done], part[done:])
            done += span
        if done == window:
            return number
        part, span = paired(part[:-span], part[span:]), 2 * span


def passages(blocks: list[tuple[tuple[int, ...], int]], window: int) -> set[tuple[int, ...]]:
    """Recurring passages of the blocks (word numbers, members).

    A window recurs if it stands in two places (each member of a block counts).
    Neighbouring windows with the same places, moved by one, form one passage,
    so that every place of any of them is a place of the whole passage.
    """
    length = np.array([len(words) for words, _ in blocks], np.int64)
    number = _window_numbers(np.fromiter(chain.from_iterable(words for words, _ in blocks), np.int64, int(length.sum())), window)
    starts = np.maximum(length - window + 1, 0)
    block = np.repeat(np.arange(len(blocks)), starts)
    if not len(block):
        return set()
    i = np.arange(len(block)) - np.repeat(np.cumsum(starts) - starts, starts)
    number = np.unique(number[np.repeat(np.cumsum(length) - length, starts) + i], return_inverse=True)[1]
    kinds = int(number.max()) + 1
    members = np.array([m for _, m in blocks], np.int64)
    total = np.zeros(kinds, np.int64)
    np.add.at(total, number, members[block])
    after = np.full(len(block), -1)
    inner = np.flatnonzero(block[1:] == block[:-1])
    after[inner] = number[inner + 1]
    # A window goes on if all its places have the same next window and that has no other place.
    least, most = np.full(kinds, kinds), np.full(kinds, -1)
    np.minimum.at(least, number, after)
    np.maximum.at(most, number, after)
    places = np.bincount(number, minlength=kinds)
    goes_on = ((least == most) & (most >= 0) & (places[np.maximum(most, 0)] == places))[number]
    recurs = total[number] >= 2
    first = recurs.copy()
    first[1:] &= ~((block[1:] == block[:-1]) & goes_on[:-1])
    end = np.flatnonzero(recurs & ~goes_on)
    at = np.flatnonzero(first)
    at = at[np.unique(number[at], return_index=True)[1]]  # equal windows begin the same passage
    last = end[np.searchsorted(end, at)]
    return {blocks[block[a]][0][i[a]:i[z] + window] for a, z in zip(at.tolist(), last.tolist())}


def occurrences(patterns: set[tuple[int, ...]], texts: list[tuple[int, ...]]) -> Iterator[tuple[int, int, int]]:
    """(text, start, length) of every place of every pattern, overlaps included."""
    if not patterns:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    for t, words in enumerate(texts):
        for end, length in automaton.iter(words):
            yield t, end - length + 1, length


def _locate(window: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in anchors.grouped(batches, PORTION):
            number: dict[bytes, int] = {}
            texts = [tuple([number.setdefault(w, len(number)) for w in body.split()]) for body in rows["body"]]
            patterns = passages(list(zip(texts, rows["members"])), window)  # equal windows have one gram
            yield anchors.span_batch([(rows["ord"][t], rows["text_key"][t], rows["s"][t] + at, n)
                                      for t, at, n in occurrences(patterns, texts)])
    return apply


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = anchors.CROWD) -> DataFrame:
    """One row per input row: doc_id, text_key, n_words, n_removed, kept (the other words joined by one space)."""
    kind = Kind(True, window, gram)
    rows = rows_of(docs)
    found = anchors.spans(rows, kind, False, _locate(window), crowd)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                gone = anchors.covered(len(words), spans)
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(words if gone is None else [words[i] for i in np.flatnonzero(~gone)]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "text_key", "n_words", "n_removed", "kept"])

    return (anchors.with_spans(rows, found).select("doc_id", "text_key", "text", "spans")
            .mapInArrow(apply, "doc_id long, text_key long, n_words long, n_removed long, kept string"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(data: bytes, gone: np.ndarray) -> bytes:
    """`data` without the words marked in `gone`: a run of them goes with the white space up to the next word; the rest keeps its layout."""
    out, at = [], 0
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(data[at:starts[first]])
        at = starts[last]
    return b"".join([*out, data[at:]])


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = anchors.CROWD) -> DataFrame:
    """`docs` with the repeated passages cut out of `text` (and `n_chars` counted anew, if there is such a column).

    A document of which no word is left goes; one without a repeat stays as it is.
    """
    rows = rows_of(docs, "_row")
    found = anchors.spans(rows.drop("_row"), Kind(True, window, gram), False, _locate(window), crowd)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            texts = pc.struct_field(b.column("_row"), "text").fill_null("")
            for text, spans in zip(texts, b.column("spans").to_pylist()):
                data = text.as_buffer().to_pybytes()
                gone = anchors.covered(len(data.split()), spans)
                new.append(data if gone is None else None if gone.all() else cut_words(data, gone))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(new, pa.binary()).cast(pa.string())], names=["_row", "new"])

    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).schema["_row"].dataType.simpleString()
    out = (anchors.with_spans(rows.select("_row", "ord", "text_key"), found).select("_row", "spans").mapInArrow(apply, f"_row {kind}, new string")
           .where("new IS NOT NULL"))
    value = {"text": F.when(F.col("_row.text").isNotNull(), F.col("new")), "n_chars": F.char_length("new").cast("long")}
    return out.select(*[value.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs, **method).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
        FROM d, unnest(range(1, len(words) - {WINDOW - 2})) AS s(i)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM again, range(0, {WINDOW}) AS t(o)),
word AS (SELECT r, i, words[i] AS w FROM d, unnest(range(1, len(words) + 1)) AS s(i)),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
