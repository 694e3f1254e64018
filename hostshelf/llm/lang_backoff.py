"""Language ID by word-first backoff.

Every labelled document outside the held-out fold is counted: word frequencies
per language, and from them the frequencies of the words' character n-grams
(4 down to 1, with word borders). A text scores each known word by its
per-language log frequency; an unseen word falls back to the longest n-grams
of it that are known. The language with the highest total wins; `score` is its
share after a softmax.

The counts cover all training rows (combined per batch, then summed by Spark).
The model keeps the `max_words` most frequent words and the `max_grams` most
frequent n-grams per order of *every language*, among equals those first in
order, so a rare language keeps its units beside large ones; units that no
language has `min_count` times are left out. A kept unit has its counts of all
languages. A word beyond the bound is scored by its n-grams. The model is sparse
(unit, language, count): it grows with the languages, not with the corpus.

Defined results: null text or text without a letter is `und` with score 0;
rows with null language or null text teach nothing; ties go to the language
first in order; without training rows every text is `und`; a null id is not
held out; any number of `lang` values is fine.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostshelf.llm.common import staged

ORDERS = (4, 3, 2, 1)
#: Per language: words, n-grams of each order, and the least count of a unit.
MAX_WORDS, MAX_GRAMS, MIN_COUNT = 30_000, 10_000, 3
SMOOTHING = 0.5
UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2


def _ranges(categories: str) -> str:
    """The characters of the Unicode categories, as ranges of a pattern."""
    inside = [unicodedata.category(chr(c))[0] in categories for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(inside) + 1) if (c < len(inside) and inside[c]) != (c > 0 and inside[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


#: Words begin with a letter; marks stay with the letters they belong to, numeric signs are none.
_LETTERS = re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")
#: Figures in a worker's table of unit scores and words that it remembers (caches, never limits on results).
_CACHE, _CACHED_WORDS = 4_000_000, 300_000


#: The same where no character is a mark or a numeric sign; much faster.
_PLAIN_LETTERS = re.compile(r"[^\W\d_]+")
_MARK_OR_SIGN = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\U0010ffff]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_LETTERS if _MARK_OR_SIGN.search(text) else _PLAIN_LETTERS).findall(text)


def grams_of(word: str, order: int) -> list[str]:
    word = f"^{word}$" if order > 1 else word
    return [word[i:i + order] for i in range(len(word) - order + 1)]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            found.setdefault(lang, Counter()).update(words_of(text.as_py()))
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[tuple[str, int], dict[str, int]] = {}
        for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for order in ORDERS:
                counts = found.setdefault((lang, order), {})
                for g in grams_of(word, order):
                    counts[g] = counts.get(g, 0) + n
        for (lang, order), counts in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(np.full(len(counts), order, np.int32)),
                 pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "ord", "unit", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, ord, unit, n) over all training rows: ord 0 are words, the others n-grams of that length."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("lang", "text")
    words = staged(rows.mapInArrow(_count_words, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = (words.mapInArrow(_count_grams, "lang string, ord int, unit string, n long")
             .groupBy("lang", "ord", "unit").agg(F.sum("n").alias("n")))
    return words.select("lang", F.lit(0).alias("ord"), F.col("word").alias("unit"), "n").union(grams)


class Model:
    """Log frequencies of the kept units.

    `index` gives a unit's number per order, `floor` the log frequency per order
    and language of a unit never seen there, and the entries ``starts[i]`` to
    ``starts[i + 1]`` of `langs_at` and `gains` what unit i has above it. A worker
    spreads the words that it meets into rows of one dense table.
    """

    def __init__(self, langs: list[str], index: dict[int, dict[str, int]], floor: dict[int, np.ndarray],
                 starts: np.ndarray, langs_at: np.ndarray, gains: np.ndarray):
        self.langs, self.index, self.floor = langs, index, floor
        self.starts, self.langs_at, self.gains = starts, langs_at, gains
        self.room = max(1, _CACHE // max(1, len(langs)))
        self.seen, self.place, self.table = {}, {}, np.zeros((0, len(langs)))

    def logs(self, order: int, unit: int) -> np.ndarray:
        row = self.floor[order].copy()
        own = slice(self.starts[unit], self.starts[unit + 1])
        row[self.langs_at[own]] += self.gains[own]
        return row

    def _units(self, word: str) -> tuple[int, list[int]]:
        """The word itself, else its longest known n-grams; none if nothing of it is known."""
        at = self.index[0].get(word)
        if at is not None:
            return 0, [at]
        for order in ORDERS:
            known = self.index[order]
            if units := [known[g] for g in grams_of(word, order) if g in known]:
                return order, units
        return 0, []

    def _row(self, order: int, unit: int) -> int:
        at = self.place.get(unit)
        if at is None:
            at = self.place[unit] = len(self.place)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((min(self.room - at, max(1024, at)), len(self.langs)))])
            self.table[at] = self.logs(order, unit)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share): every word counts once per place, an unseen one by the mean of its n-grams."""
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        at, weight, total = [], [], np.zeros(len(self.langs))
        for word, n in Counter(words).items():
            rows = self.seen.get(word)
            if rows is None:
                order, units = self._units(word)
                if len(units) > self.room:  # more than the table holds
                    total += sum(self.logs(order, u) for u in units) * (n / len(units))
                    continue
                if len(self.place) + len(units) > self.room or len(self.seen) >= _CACHED_WORDS:
                    total += self._sum(at, weight)
                    at, weight, self.seen, self.place = [], [], {}, {}
                rows = self.seen[word] = [self._row(order, u) for u in units]
            if len(rows) == 1:
                at.append(rows[0])
                weight.append(n)
            elif rows:
                at += rows
                weight += [n / len(rows)] * len(rows)
        total += self._sum(at, weight)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(share[best] / share.sum())

    def _sum(self, at: list[int], weight: list[float]) -> np.ndarray:
        return np.array(weight, float) @ self.table[np.array(at, np.intp)]


def kept_units(counts: DataFrame, max_words: int, max_grams: int, min_count: int) -> DataFrame:
    """(ord, unit): the most frequent of every language and order, equals by unit.

    Ranked in parts by the unit's hash first, so the task that ranks a language
    has at most the bound times the shuffle partitions.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = F.when(F.col("ord") == 0, max_words).otherwise(max_grams)
    ranked = counts.where(F.col("n") >= min_count).withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)))
    for keys in (("lang", "ord", "part"), ("lang", "ord")):
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "unit")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bound).drop("rank")
    return ranked.select("ord", "unit").distinct()


def learn(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, min_count: int = MIN_COUNT) -> Model:
    """Count, keep the most frequent units of every language, and take logarithms.

    What comes to the driver are the kept units with their counts, at most
    ``max_words + 4 * max_grams`` units for each language.
    """
    counts = staged(counted(docs), "counts")
    totals = {(r["ord"], r["lang"]): r["n"] for r in counts.groupBy("ord", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    number = {x: i for i, x in enumerate(langs)}
    rows = (counts.join(kept_units(counts, max_words, max_grams, min_count), ["ord", "unit"]).select("ord", "unit", "lang", "n")
            .toPandas().sort_values(["ord", "unit", "lang"], ignore_index=True))
    first = ~rows.duplicated(["ord", "unit"]).to_numpy(bool)
    units = rows[first]
    index = {o: {} for o in (0, *ORDERS)}
    for i, (o, unit) in enumerate(zip(units["ord"].tolist(), units["unit"].tolist())):
        index[o][unit] = i
    spread = {o: np.array([totals.get((o, x), 0) for x in langs], float) + SMOOTHING * max(1, len(index[o])) for o in index}
    floor = {o: np.log(SMOOTHING / spread[o]) for o in index}
    gains = np.log((rows["n"].to_numpy(float) + SMOOTHING) / SMOOTHING)
    langs_at = np.array([number[x] for x in rows["lang"]], np.int32)
    return Model(langs, index, floor, np.append(np.flatnonzero(first), len(rows)), langs_at, gains)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Only `text` decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded per language by max_words and max_grams

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in out], pa.string()),
                 pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select("doc_id", held_out().alias("held_out"), "text")
            .mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double"))


def report(docs: DataFrame, **method) -> DataFrame:
    return predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), learn(docs, **method))
