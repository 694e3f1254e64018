"""Phrase collocations by dynamic itemset counting.

Counts of contiguous phrases are collected while the corpus is scanned shard
by shard, round and round, and phrases of all lengths are counted in the same
scan. Words are counted from the first scan on. A longer phrase is activated
once both of its subphrases (all but its last, all but its first word) have
reached the threshold in what was scanned so far; it is then counted for one
full cycle, wherever in the cycle that began, and is done. Both subphrases of a
phrase that reaches the threshold reach it too, so no such phrase is missed,
and its count is that of the whole corpus.

How a scan knows what is active: a table of `SLOTS` bytes (its size does not
depend on the input) holds, per hash slot, the first scan at which a phrase of
that slot had reached the threshold; a phrase has entered when all its slots
have. Phrases that share slots may be taken to have entered too early, and
always at the same scan, since an entry never changes: what follows from them
is counted for its own full cycle, with an exact count, and falls to the same
threshold. A crowded table costs time, never a row.

Texts are split into words once, before the first scan: each task turns portions
of text into word numbers with array operations and writes these with the words
they stand for; the scans read the numbers. A scan counts a portion's distinct
phrases of every length by number (exact, no hashing); the shuffle sums them by
language and the phrase itself. A scan's sums are written to the shared folder,
which cuts the lineage, and replace those before them.

Score of a candidate cut into two parts l and r: floor(1000 * a * n / (l * r)),
in decimals of 38 digits. The lowest cut counts. A candidate is dropped when a
longer one that contains it has `absorbed` percent of its count.

Defined results: null text has no words; null language is `und`; documents are
not told apart, so repeated rows count each time; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostshelf.llm.common import discard, staged

LONGEST, THRESHOLD, ABSORBED, TOP = 5, 100, 100, 2000
SHARDS = 2
SLOTS = 1 << 23
UNDETERMINED = "und"
#: Bytes of text that a task turns into numbers at once, and portions of a file (Spark reads a small file's rows as one batch).
PORTION, PORTIONS = 1 << 23, 4
_NEVER = 255
_PORTIONS = "shard int, langs array<string>, lang binary, words binary, codes binary"
_COUNTS = "lang string, phrase string, since int, a long"
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Translations of bytes: to lower case, and to 0 in words, 1 for blanks, 2 for breaks.
_LOWER = bytes(range(256)).lower()
_KIND = bytes(1 if b in _BLANKS else 2 if b in _BREAKS else 0 for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _longer(left: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all their words but the last, and of the last."""
    return _mix(left * np.uint64(0x9E3779B97F4A7C15) + last)


def _spelled(words: pa.Array, langs: list[str], lang: np.ndarray) -> np.ndarray:
    """Hashes of words (none is empty), each of the language of its number: sums over their bytes and places."""
    offsets, data = (np.frombuffer(b, t) for b, t in zip(words.buffers()[1:], (np.int32, np.uint8)))
    start, stop = offsets[words.offset:][:len(words)], offsets[words.offset + 1:][:len(words)]
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(start[0], stop[-1]) - np.repeat(start, stop - start)
    spelling = np.add.reduceat(_mix(place.astype(np.uint64) << np.uint64(8) | data[start[0]:stop[-1]]), start - start[0])
    return _mix(spelling + np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], np.uint64)[lang])


def _slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of a phrase's hash."""
    return h & np.uint64(slots - 1), (h >> np.uint64(32)) & np.uint64(slots - 1)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, the number of every key, how often each occurs)."""
    order = np.argsort(keys)
    new = np.concatenate(([True], np.diff(keys[order]) != 0))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    return order[head], number, np.diff(np.concatenate((head, [len(keys)])))


def _strings(start: np.ndarray, stop: np.ndarray, data: np.ndarray) -> pa.StringArray:
    """The strings whose bytes stand in `data` without gaps."""
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))


class Words:
    """A portion of documents as word numbers. `code` tells (language, word) pairs apart; `piece` rises at every break.

    `spelling` and `lang` (a number in `langs`) are by code.
    """

    def __init__(self, texts: list[bytes], langs: list[str]):
        joined = b"\n".join(texts)
        kind = np.frombuffer(joined.translate(_KIND), np.uint8)
        inside = np.concatenate(([False], kind == 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        words = _strings(start, stop, np.frombuffer(joined.translate(_LOWER), np.uint8)[inside[1:-1]]).dictionary_encode()
        word = words.indices.to_numpy().astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([number[x] for x in langs], np.int32)[np.searchsorted(ends, start, "right")]
        first, self.code, _ = _numbered(lang * len(words.dictionary) + word) if len(word) else (word,) * 3
        self.lang, self.spelling = lang[first], words.dictionary.take(pa.array(word[first]))

    def packed(self) -> tuple:
        """What `unpacked` takes: langs, and as bytes lang, the words by code, the codes (inverted where a piece begins)."""
        begins = np.diff(self.piece, prepend=-1) != 0
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(self.spelling)], self.spelling), " ")[0].as_buffer().to_pybytes()
        return self.langs, self.lang.tobytes(), words, np.where(begins, ~self.code, self.code).astype(np.int32).tobytes()

    @classmethod
    def unpacked(cls, langs: list[str], lang, words, codes) -> Words:
        self, data, code = cls.__new__(cls), np.frombuffer(words, np.uint8), np.frombuffer(codes, np.int32)
        self.langs, self.lang = langs, np.frombuffer(lang, np.int32)
        stop = np.append(np.flatnonzero(data == 32), len(data))
        self.spelling = _strings(np.append(0, stop[:-1] + 1), stop, data[data != 32])
        self.piece = np.cumsum(code < 0, dtype=np.int32)
        self.code = np.where(code < 0, ~code, code).astype(np.int64)
        return self

    @property
    def hash(self) -> np.ndarray:
        return _spelled(self.spelling, self.langs, self.lang)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        parts = [self.spelling.take(pa.array(self.code[at + i])) for i in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]


def count_portion(words: Words, scan: int, shards: int, longest: int, entered: Callable) -> Iterator[tuple]:
    """(first places, k, since, counts) of the phrases that `scan` counts, shortest first.

    `entered(hashes)` gives the scan from which each phrase counts as frequent, or _NEVER.
    """
    if not len(words.code):
        return
    word, code, n = words.hash, words.code, len(words.code)
    hashes = word
    begun = np.zeros(len(hashes), np.int64)  # the scan from which each phrase of the level at hand is counted
    if scan < shards:
        first = np.empty(len(word), np.int64)
        first[code] = np.arange(n)
        yield first, 1, begun, np.bincount(code)
    valid = np.ones(n, bool)
    for k in range(2, longest + 1):
        since = np.maximum(entered(hashes), begun)
        frequent = valid & (since != _NEVER)[code]
        follows = frequent[:-1] & frequent[1:]
        if k == 2:
            follows &= words.piece[:-1] == words.piece[1:]
        at = np.flatnonzero(follows)
        # What is counted no more matters only as a part of longer phrases, if it has entered.
        over = np.flatnonzero(np.maximum(since[code[at]], since[code[at + 1]]) <= scan - shards)
        known = entered(_longer(hashes[code[at[over]]], word[words.code[at[over] + k - 1]]))
        at = np.delete(at, over[known == _NEVER])
        if not len(at):
            return
        first, number, count = _numbered(code[at] * len(word) + words.code[at + k - 1])
        first = at[first]
        begun = np.maximum(since[code[first]], since[code[first + 1]])
        hashes = _longer(hashes[code[first]], word[words.code[first + k - 1]])
        now = np.flatnonzero(begun > scan - shards)
        if len(now):
            yield first[now], k, begun[now], count[now]
        valid, code = np.zeros(n, bool), np.zeros(n, np.int64)
        valid[at], code[at] = True, number


def _numbers(shards: int, portion: int) -> Callable:
    """Texts to rows of `_PORTIONS`; a task deals its documents out to the shards in turn."""
    def row(shard: int, texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        words = Words(texts, langs)
        if len(words.code):
            kinds = (pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, *words.packed()), kinds)],
                                             names=[x.split()[0] for x in _PORTIONS.split(", ")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, held = [[] for _ in range(shards)], [[] for _ in range(shards)], [0] * shards
        shard = TaskContext.get().partitionId() % shards
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                texts[shard].append(text.as_buffer().to_pybytes())
                langs[shard].append(lang)
                held[shard] += len(texts[shard][-1])
                if held[shard] >= portion:
                    yield from row(shard, texts[shard], langs[shard])
                    texts[shard], langs[shard], held[shard] = [], [], 0
                shard = (shard + 1) % shards
        for shard in range(shards):
            if texts[shard]:
                yield from row(shard, texts[shard], langs[shard])

    return apply


def _counts(table, slots: int, scan: int, shards: int, longest: int) -> Callable:
    def entered(h: np.ndarray) -> np.ndarray:
        one, two = _slots(h, slots)
        return np.maximum(table.value[one], table.value[two])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, *parts in zip(b.column("langs").to_pylist(), *(b.column(c) for c in ("lang", "words", "codes"))):
                words = Words.unpacked(langs, *(x.as_buffer() for x in parts))
                names = pa.array(langs, pa.string())
                for at, k, since, count in count_portion(words, scan, shards, longest, entered):
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(words.lang[words.code[at]])), words.phrases(at, k), pa.array(since.astype(np.int32)),
                         pa.array(count.astype(np.int64))], names=[x.split()[0] for x in _COUNTS.split(", ")])

    return apply


def n_words(phrase: str = "phrase") -> Column:
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "))) + 1


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS,
                     slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, a) of all phrases with a >= threshold, (lang, n) with n the word occurrences)."""
    spark = docs.sparkSession
    portions = staged(docs.select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), F.col("text"))
                      .where("text IS NOT NULL").mapInArrow(_numbers(shards, PORTION), _PORTIONS),
                      "portions", by="shard", codec="zstd", maxRecordsPerFile=PORTIONS)
    table = np.full(slots, _NEVER, np.uint8)
    state, done, totals = None, [], None
    scan, last = 0, shards - 1
    while scan <= last:
        if scan >= _NEVER - 1:
            raise RuntimeError("phrase counting: too many scans")  # longest x shards at most
        known = spark.sparkContext.broadcast(table)  # `slots` bytes
        counted = (portions.where(F.col("shard") == scan % shards).drop("shard")
                   .mapInArrow(_counts(known, slots, scan, shards, longest), _COUNTS))
        if state is not None:
            counted = counted.union(state.where(F.col("since") > scan - shards))
        summed = counted.groupBy("lang", "phrase", "since").agg(F.sum("a").alias("a"))
        before, state = state, staged(summed, f"scan-{scan}", codec="zstd")
        if before is not None:
            discard(before)
        known.unpersist()
        if scan == shards - 1:
            totals = staged(state.where("since = 0").groupBy("lang").agg(F.sum("a").alias("n")), "totals")
        frequent = state.where(F.col("a") >= threshold).withColumn("k", n_words())
        done.append(staged(frequent.where(F.col("since") == scan + 1 - shards).select("lang", "phrase", "k", "a"), f"done-{scan}"))
        if _enter(table, frequent.where(F.col("k") < longest), scan + 1):
            last = scan + shards
        scan += 1
    discard(portions)
    discard(state)
    found = done[0]
    for other in done[1:]:
        found = found.union(other)
    return found, totals


def _enter(table: np.ndarray, phrases: DataFrame, scan: int) -> bool:
    """Mark the slots of `phrases` that nothing has marked; False if there are none. At most slots / 64 rows of bits come back."""
    slots = len(table)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, words = b.column("lang").dictionary_encode(), pc.split_pattern(b.column("phrase"), " ")
            names, lang, size = langs.dictionary.to_pylist(), langs.indices.to_numpy(), pc.list_value_length(words).to_numpy()
            h = _spelled(pc.list_element(words, 0), names, lang)
            for i in range(1, max(size, default=0)):
                more = np.flatnonzero(size > i)
                h[more] = _longer(h[more], _spelled(pc.list_element(words.take(pa.array(more)), i), names, lang[more]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(h, slots)).astype(np.int64))], names=["slot"])

    bits = (phrases.select("lang", "phrase").mapInArrow(apply, "slot long").groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toPandas())
    if not len(bits):
        return False
    word, bits = bits["word"].to_numpy(np.int64), bits["bits"].to_numpy(np.int64).view(np.uint64)
    row, bit = np.nonzero((bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    at = word[row] * 64 + bit
    at = at[table[at] == _NEVER]
    table[at] = scan
    return len(at) > 0


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """The phrases of two words or more with their lowest-scoring cut: lang, phrase, k, a, l, r, n, score."""
    candidates = found.where("k >= 2")
    words = F.split("phrase", " ")
    cuts = (candidates.select("lang", "phrase", "k", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "phrase", "k", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("head"),
                    F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ").alias("tail")))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = {c: f"CAST({c} AS DECIMAL(19,0))" for c in "alnr"}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    return (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
            .groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
            .select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score"))


def not_absorbed(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Candidates that no longer candidate contains with at least `absorbed` percent of their count."""
    longer = candidates.where("k >= 3").select("lang", "a", F.expr(
        "explode(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))").alias("phrase"))
    holders = longer.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    return (candidates.join(holders, ["lang", "phrase"], "left")
            .where(F.col("held").isNull() | (100 * F.col("held") < absorbed * F.col("a"))).drop("held"))


def first_per_lang(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """`rank` 1..top per language. A language's rows are cut to `top` per bucket before they meet in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    buckets = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = Window.partitionBy("lang", "bucket").orderBy(*order)
    best = (candidates.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
            .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def report(docs: DataFrame, threshold: int = THRESHOLD, absorbed: int = ABSORBED, top: int = TOP, **method) -> DataFrame:
    """Per language the first `top` collocations: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent_phrases(docs, threshold, **method)
    best = first_per_lang(not_absorbed(staged(scored(found, totals), "scored"), absorbed), top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '{UNDETERMINED}') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, CAST(len(words) - k + 2 AS BIGINT)), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, {LONGEST + 1}) AS t(k) WHERE len(words) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND a >= {THRESHOLD}),
part AS MATERIALIZED (SELECT c.lang, c.k, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS head,
                             array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS tail
                      FROM c, range(1, {LONGEST}) AS x(j) WHERE j < c.k),
seen AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= {THRESHOLD}),
cut AS (SELECT part.*, h.a AS l, t.a AS r, n.n, (CAST(1000 AS HUGEINT) * part.a * n.n) // (CAST(h.a AS HUGEINT) * t.a) AS score
        FROM part JOIN seen AS h ON h.lang = part.lang AND h.phrase = part.head
        JOIN seen AS t ON t.lang = part.lang AND t.phrase = part.tail JOIN n ON n.lang = part.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT s.lang, s.phrase FROM c AS s JOIN c AS longer ON s.lang = longer.lang AND s.k < longer.k
         AND contains(' ' || longer.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * longer.a >= {ABSORBED} * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN held USING (lang, phrase)
QUALIFY rank <= {TOP}
"""
