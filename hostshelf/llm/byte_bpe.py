"""Byte-level BPE encoding and decoding: ranked merges folded over the bytes of distinct words.

Texts are split by the vocabulary's pattern (JVM regular expressions), and the
distinct words of a portion of documents are brought together. The ranked
merges are folded over the bytes of each distinct word, with the rank table of
the vocabulary file; the documents then look their words' ids up. Decoding maps
ids to their byte pieces and concatenates them. No stage needs a shuffle, and a
portion is bounded in tokens, so memory does not depend on the input; a text
longer than a portion is a portion of its own.

The fold comes in two forms with equal results:

* `native=True`: Spark's `transform` and `aggregate` over the bytes, with the
  rank table as a literal array of small maps (the place is a checksum of the
  bytes, since Spark looks maps up one key after the other) and the pieces as a
  literal array. Bytes are written in hex, two digits each.
* the default: the same fold in Arrow batches, where the portions are anyway.
  It takes about an eighth of the time (figures in the README).

Words over `LONG_WORD` bytes (runs of one kind of character without a break)
are merged by the same rule with a heap, since a fold over an array costs the
square of the length.

Defined results: null text is empty, with no ids; repeated rows are encoded one
by one; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostshelf.llm import vocab
from hostshelf.llm.common import id_and_text, let

_SLOTS = 1 << 16
#: Tokens of the documents whose distinct words share a row.
PORTION = 1 << 20
LONG_WORD = 200
_REMEMBERED = 300_000
_NONE = 1 << 62


def rank_literal(ranks: dict[bytes, int]) -> Column:
    slots: list[dict[str, int]] = [{} for _ in range(_SLOTS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        slots[zlib.crc32(key.encode()) % _SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex().upper()
    return F.split(F.lit(",".join(pieces)), ",")


def rank_of(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % _SLOTS).cast("int")), key)


def encoded_word(word: Column, table: Column) -> Column:
    """Ids of one word (hex): the word itself if it has a rank, else its bytes after all ranked merges."""
    n = (F.length(word) / 2).cast("int")
    upto = lambda stop: F.when(stop >= 0, F.sequence(F.lit(0), stop)).otherwise(F.array().cast("array<int>"))
    start = F.struct(
        F.transform(upto(n - 1), lambda i: F.substring(word, i * 2 + 1, F.lit(2))).alias("p"),
        F.transform(upto(n - 2), lambda i: rank_of(table, F.substring(word, i * 2 + 1, F.lit(4)))).alias("r"))

    def merge(state: Column, i: Column) -> Column:
        """Join pieces i and i + 1 (from 1): the ranks beside them change, all others stay."""
        p, r = state.getField("p"), state.getField("r")
        joined = lambda a, b: F.concat(F.get(p, a), F.get(p, b))
        left = F.when(i > 1, F.array(rank_of(table, F.concat(F.get(p, i - 2), joined(i - 1, i))))).otherwise(
            F.array().cast("array<int>"))
        right = F.when(i < F.size(r), F.array(rank_of(table, F.concat(joined(i - 1, i), F.get(p, i + 1))))).otherwise(
            F.array().cast("array<int>"))
        return F.struct(
            F.concat(F.slice(p, F.lit(1), i - 1), F.array(joined(i - 1, i)), F.slice(p, i + 2, F.size(p))).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right,
                     F.slice(r, i + 2, F.size(p))).alias("r"))

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state.getField("r")), lambda least: F.when(least.isNull(), state).otherwise(
            let(F.array_position(state.getField("r"), least).cast("int"), lambda i: merge(state, i))))

    folded = F.aggregate(upto(n - 2), start, step).getField("p")
    return let(rank_of(table, word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(
        F.transform(folded, lambda x: rank_of(table, x))))


def decoded(ids: Column, pieces: Column) -> Column:
    """Bytes of an array of ids."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges (lowest rank first, then leftmost) with a heap, for very long words."""
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))  # piece at i is word[i:end[i]]; end 0 once it is merged away
    before = list(range(-1, len(word) - 1))

    def push(i: int) -> None:
        j = end[i]
        if j < len(word) and (rank := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(len(word) - 1):
        push(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < len(word):
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


_CLASSES: dict[str, str] = {}


def _as_class(points: list[int]) -> str:
    """A nested class of the ranges of `points`; only characters from the first point on are looked up in it."""
    if not points:
        return ""
    cuts = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    ranges = "".join(f"\\x{{{points[a]:X}}}-\\x{{{points[b - 1]:X}}}" for a, b in zip(cuts, cuts[1:]))
    return f"[\\x{{{points[0]:X}}}-\\x{{10FFFF}}&&[{ranges}]]"


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """`pattern` for the JVM: Unicode white space, and the letters and numbers of later Unicode versions than the JVM's."""
    if pattern not in _CLASSES:
        point = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
        kinds = (spark.range(0x110000).where("id < 55296 OR id > 57343")
                 .select("id", *[point.rlike(f"(?U)^\\{k}$").alias(n) for k, n in (("p{L}", "l"), ("p{N}", "n"))])
                 .groupBy().agg(*[F.collect_list(F.when(F.col(c), F.col("id"))).alias(c) for c in "ln"]).first())
        extra, everything = {}, "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
        for c in "ln":
            known = set(kinds[c])
            extra[c] = _as_class([ord(x) for x in regex.findall(rf"\p{{{c.upper()}}}", everything) if ord(x) not in known])
        letters, numbers = f"\\p{{L}}{extra['l']}", f"\\p{{N}}{extra['n']}"
        java = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]")
                .replace(r" ?\p{L}+", f" ?[{letters}]+").replace(r" ?\p{N}+", f" ?[{numbers}]+"))
        _CLASSES[pattern] = "(?U)" + java
    return _CLASSES[pattern]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[bytes]]]:
    """Per portion: the documents' ids, the ends of their words, the words' numbers, and the distinct words."""
    for b in batches:
        tokens, ids = b.column("tokens"), b.column("doc_id")
        ends = tokens.offsets.to_numpy().astype(np.int64)
        i = 0
        while i < len(tokens):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + PORTION, "right")) - 1)
            coded = tokens.values.slice(ends[i], ends[j] - ends[i]).dictionary_encode()
            yield (ids.slice(i, j - i).to_pylist(), ends[i + 1:j + 1] - ends[i], coded.indices.to_numpy(zero_copy_only=False),
                   coded.dictionary.cast(pa.binary()).to_pylist())
            i = j


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per portion, for the native form: words in hex, their numbers as int32 bytes."""
    for doc_ids, ends, numbers, words in _grouped(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([doc_ids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())),
             pa.array([numbers.astype("<i4").tobytes()], pa.binary()),
             pa.array([[w.hex().upper() for w in words]], pa.list_(pa.string()))], names=["doc_ids", "ends", "numbers", "words"])


def split_words(docs: DataFrame, pattern: str = vocab.PATTERN) -> DataFrame:
    """doc_id and `tokens`, the matches of the pattern in order."""
    return id_and_text(docs).select("doc_id", F.regexp_extract_all(
        "text", F.lit(java_pattern(docs.sparkSession, pattern)), F.lit(0)).alias("tokens"))


def portions(docs: DataFrame, pattern: str = vocab.PATTERN) -> DataFrame:
    """Rows of documents and their distinct words (`words`, in hex)."""
    return split_words(docs, pattern).mapInArrow(
        _portions, "doc_ids array<long>, ends array<long>, numbers binary, words array<string>")


def folded_natively(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Portions with the words' `ids` (null for long words) and decoded bytes (`pieces`), by higher-order functions."""
    ids = let(rank_literal(ranks), lambda table: F.transform("words", lambda w: F.when(
        F.length(w) <= 2 * LONG_WORD, encoded_word(w, table))))
    return (rows.withColumn("ids", ids)
            .withColumn("pieces", let(piece_literal(ranks), lambda p: F.transform("ids", lambda x: decoded(x, p)))))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the word's own if it has one, else those of its bytes after all merges, lowest rank first, then leftmost."""
    get = ranks.get
    if (whole := get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return merged_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    beside = [get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while beside and (least := min(beside)) != _NONE:
        i = beside.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del beside[i]
        if i:
            beside[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        if i < len(beside):
            beside[i] = get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


class _Words:
    """Ids of words, remembered per Python worker up to a bound (a cache: results do not depend on it)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}

    def ids(self, word: bytes) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = merged(word, self.ranks)
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found


_WORDS: dict[int, _Words] = {}


def _worker_words(shared) -> _Words:
    """This worker's words for a vocabulary; a broadcast has one value object per worker."""
    held = _WORDS.get(0)
    if held is None or held.ranks is not shared.value and held.ranks != shared.value:
        held = _WORDS[0] = _Words(shared.value)
    return held


def _folded(batches: Iterator[pa.RecordBatch], words: _Words):
    """Per portion: document ids, their word numbers, and per distinct word its ids and decoded bytes."""
    piece = {rank: token for token, rank in words.ranks.items()}
    for doc_ids, ends, numbers, own in _grouped(batches):
        ids = [words.ids(w) for w in own]
        yield doc_ids, np.split(numbers, ends[:-1]), ids, [b"".join([piece[i] for i in x]) for x in ids]


def _from_native(batches: Iterator[pa.RecordBatch], words: _Words):
    """The same from portions that are folded natively; long words are filled in."""
    for b in batches:
        for r in b.to_pylist():
            ids, data = r["ids"], r["pieces"]
            for w, x in enumerate(ids):
                if x is None:
                    data[w] = bytes.fromhex(r["words"][w])
                    ids[w] = words.ids(data[w])
            yield r["doc_ids"], np.split(np.frombuffer(r["numbers"], "<i4"), r["ends"][:-1]), ids, data


def _applied(docs: DataFrame, ranks: dict[bytes, int], pattern: str, native: bool, schema: str, per_portion) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file
    read = _from_native if native else _folded

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in read(batches, _worker_words(shared)):
            yield per_portion(*portion)

    rows = folded_natively(portions(docs, pattern), ranks) if native else split_words(docs, pattern)
    return rows.mapInArrow(apply, schema)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str = vocab.PATTERN, native: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids."""
    def per_portion(doc_ids, docs_words, ids, data):
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()),
             pa.array([[i for w in words.tolist() for i in ids[w]] for words in docs_words], pa.list_(pa.int32()))],
            names=["doc_id", "ids"])

    return _applied(docs, ranks, pattern, native, "doc_id long, ids array<int>", per_portion)


def report(docs: DataFrame, ranks: dict[bytes, int], pattern: str = vocab.PATTERN, native: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def per_portion(doc_ids, docs_words, ids, data):
        text = [",".join(map(str, x)).encode() for x in ids]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        n, ids_sha, data_sha = [], [], []
        for words in docs_words:
            n.append(int(count[words].sum()))
            words = words.tolist()
            ids_sha.append(hashlib.sha256(b",".join([text[w] for w in words])).hexdigest())
            data_sha.append(hashlib.sha256(b"".join([data[w] for w in words])).hexdigest())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
             pa.array(data_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _applied(docs, ranks, pattern, native,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", per_portion)
