"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base rules are fixed by contract. On top of them each score (share of symbols,
of exclamation marks, of capitals, of repeated words, of repeated lines) gets
one cutoff per stratum (language). Labelled documents are the holdout: for
every (stratum, rule, cutoff of a fixed grid) count the good documents n and
those k that the cutoff would reject. Two families of tests share delta:

* Split: the cutoff of a rule is certified when the exact binomial tail
  P(Bin(n, alpha / rules) <= k) is at most delta / 2 / tests (Bonferroni over
  all strata, rules and cutoffs). That needs about 900 good labels.
* Joint: the set that all rules together reject at one common cutoff is tested
  at the whole alpha, P(Bin(n, alpha) <= k) <= delta / 2 / strata, as a fixed
  sequence from the highest cutoff down (k only grows on the way, so the levels
  before the first failure are those that pass). At a level that passes every
  rule may have any cutoff from there up, since the set so rejected is a part
  of the certified one. That needs about 100 good labels with four strata.

With confidence 1 - delta no stratum then loses more than a share `alpha` of
its good documents to all rules together. Of a rule's certified cutoffs the one
that rejects the most bad documents less good ones applies, of equal ones the
highest, so that a rule takes no more than it needs; per stratum the family
with the greater sum of the rules' gains applies, on a tie the split. A stratum
with too few labels has no cutoff, and only the base rules hold there.
Documents that the base rules reject take no part.

The holdout's rows are counted by (stratum, rule, number of cutoffs reached),
which the map tasks combine; everything after that works on at most 22 rows per
stratum and rule.

Defined results: null text has no words (so it fails the base rule); a null
language is a stratum of its own; null labels are ignored; a document with
several labels counts as good if one of them says so, else as bad; without
labels only the base rules apply.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostshelf.llm.common import SPACE, let, staged

#: Contract values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

#: Production parameters of the method.
ALPHA, DELTA = 0.05, 0.05
GRID = tuple(round(0.01 * 1.25 ** i, 4) for i in range(21))
RULES = ("symbol_share", "mark_share", "capital_share", "repeat_share", "dup_line_share")
JOINT = "all"


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more: sort (hash, place), keep equal neighbours, add up their cover."""
    hashes = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))

    def cover(sorted_pairs: Column) -> Column:
        same = lambda e, j: F.get(sorted_pairs, j).getField("h").eqNullSafe(e.getField("h"))
        again = F.filter(sorted_pairs, lambda e, j: same(e, j - 1) | same(e, j + 1))
        places = F.array_sort(F.transform(again, lambda e: e.getField("i")))
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
        return F.aggregate(places, zero, lambda a, i: F.struct(
            (a.getField("sum") + i + WINDOW - F.greatest(a.getField("end"), i)).alias("sum"),
            (i + WINDOW).alias("end"))).getField("sum")

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
        let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), cover)))


def measured(docs: DataFrame, name: str = "m") -> DataFrame:
    """`docs` with one struct column of the base counts, n_lines, n_marks and n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    from_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    from_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda chars: F.regexp_count(text, F.lit(chars)).cast("long")
    return docs.withColumn(name, F.struct(
        from_words.alias("w"), from_lines.alias("l"), count("[#*$%&|<>]").alias("n_symbols"),
        count("!").alias("n_marks"), count("[A-Z]").alias("n_capitals")))


def base_failed(m: str = "m") -> Column:
    n = F.col(f"{m}.w.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{m}.w.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def scores(m: str = "m") -> dict[str, Column]:
    """Rule name to score, from 0 (good) upwards."""
    over = lambda a, b: F.when(F.col(f"{m}.{b}") > 0, F.col(f"{m}.{a}") / F.col(f"{m}.{b}")).otherwise(0.0)
    parts = (("n_symbols", "w.word_chars"), ("n_marks", "w.word_chars"), ("n_capitals", "w.word_chars"),
             ("w.n_repeat_words", "w.n_words"), ("l.n_dup_lines", "l.n_lines"))
    return {rule: over(*p) for rule, p in zip(RULES, parts)}


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in logarithms; 0 where k is at or above the mean."""
    first, step = n * math.log1p(-p), math.log(p) - math.log1p(-p)

    def add(a: Column, i: Column) -> Column:
        term = a.getField("term") + F.log((n - i + 1) / i) + step
        return let(term, lambda t: F.struct(t.alias("term"), (
            F.greatest(a.getField("sum"), t) + F.log1p(F.exp(-F.abs(a.getField("sum") - t)))).alias("sum")))

    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
                        F.struct(first.alias("term"), first.alias("sum")), add).getField("sum")
    return F.when(k >= n * p, 0.0).otherwise(total)


def cells(rows: DataFrame, labels: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, rule, n, steps) of the labelled strata; `steps` holds k and bad for every cutoff of the grid.

    The rule `all` is the set that any rule rejects at that cutoff.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    cuts = F.array(*[F.lit(c) for c in grid])
    reached = lambda score: F.size(F.filter(cuts, lambda c: score >= c))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), reached(score).alias("reached"))
                               for name, score in (*((r, F.col(r)) for r in RULES), (JOINT, F.greatest(*RULES)))]))
    counts = (rows.join(known, "doc_id").select("stratum", "good", each.alias("at"))
              .groupBy("stratum", "at.rule", "at.reached")
              .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")))

    def above(j: Column, kind: str) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.when(x.getField("reached") > j, x.getField(kind)).otherwise(0))

    steps = F.transform(cuts, lambda c, j: F.struct(c.alias("cut"), above(j, "good").alias("k"), above(j, "bad").alias("bad")))
    return (counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("reached", "good", "bad")).alias("parts"))
            .select("stratum", "rule", "n", steps.alias("steps")))


def certified_cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                      grid: tuple[float, ...] = GRID) -> DataFrame:
    """(stratum, one cutoff column per rule) of the labelled strata; null where no cutoff is certified.

    `rows` holds doc_id, stratum and the score columns. A score at or above its cutoff is rejected.
    """
    counted = staged(cells(rows, labels, grid), "cells")
    limit = math.log(delta / 2 / max(counted.where(F.col("rule") == JOINT).count(), 1))
    n, k, joint = F.col("n"), F.col("k"), F.col("rule") == JOINT
    tested = (counted.select("stratum", "rule", "n", F.inline("steps"))
              .withColumn("split_ok", ~joint & (log_binomial_cdf(n, k, alpha / len(RULES)) <= limit - math.log(len(RULES) * len(grid))))
              .withColumn("level_ok", joint & (log_binomial_cdf(n, k, alpha) <= limit))
              .withColumn("joint_ok", F.max("level_ok").over(Window.partitionBy("stratum", "cut"))))
    best = lambda ok: F.max(F.when(F.col(ok), F.struct((F.col("bad") - k).alias("gain"), F.col("cut"))))
    chosen = tested.where(~joint).groupBy("stratum", "rule").agg(best("split_ok").alias("split"), best("joint_ok").alias("joint"))
    gain = lambda family: F.coalesce(F.sum(f"{family}.gain"), F.lit(0))
    of = lambda family, r: F.max(F.when(F.col("rule") == r, F.col(f"{family}.cut")))
    return chosen.groupBy("stratum").agg(*[F.when(gain("joint") > gain("split"), of("joint", r)).otherwise(of("split", r)).alias(f"cut_{r}")
                                           for r in RULES])


def judged(rows: DataFrame, labels: DataFrame, m: str = "m", **method) -> DataFrame:
    """`rows` (with doc_id, lang and the struct `m`) plus base_failed and kept."""
    scored = rows.where(~base_failed(m)).select("doc_id", _stratum().alias("stratum"), *[c.alias(r) for r, c in scores(m).items()])
    cuts = staged(certified_cutoffs(scored, labels, **method), "cutoffs")
    rejected = F.coalesce(*[F.when(c >= F.col(f"cut_{r}"), True) for r, c in scores(m).items()], F.lit(False))
    return (rows.withColumn("stratum", _stratum()).join(cuts, "stratum", "left")
            .withColumn("base_failed", base_failed(m)).withColumn("kept", ~F.col("base_failed") & ~rejected))


def _stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def report(docs: DataFrame, labels: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept."""
    rows = staged(measured(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", "m"), "measured")
    return judged(rows, labels, **method).select(
        "doc_id", F.col("m.w.n_words").alias("n_words"), F.col("m.w.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"), F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"), "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **method) -> DataFrame:
    """The rows of `docs` that pass, with their own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = staged(measured(whole.select("_row", "_row.doc_id", "_row.text", "_row.lang")).drop("text"), "measured")
    return judged(rows, labels, **method).where("kept").select("_row.*")


_GRID_SQL = ", ".join(str(c) for c in GRID)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g
        FROM w, unnest(range(1, len(words) - 6)) AS s(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(0, 8) AS t(o) GROUP BY r),
m AS (SELECT r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
             length(text) - length(replace(text, '!', '')) AS n_marks,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN cov USING (r)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             [CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END,
              CASE WHEN word_chars > 0 THEN n_marks / word_chars ELSE 0 END,
              CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END,
              CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
              CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END] AS score FROM m),
known AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
cell AS (SELECT stratum, rule, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND x >= cut) AS k,
                count(*) FILTER (NOT good AND x >= cut) - count(*) FILTER (good AND x >= cut) AS gain
         FROM (SELECT stratum, good, rule, CASE WHEN rule = 6 THEN list_max(score) ELSE score[rule] END AS x
               FROM s JOIN known USING (doc_id), range(1, 7) AS a(rule) WHERE NOT base_failed), unnest([{_GRID_SQL}]) AS b(cut)
         GROUP BY ALL),
tail AS (SELECT *, CASE WHEN rule = 6 THEN {ALPHA} ELSE {ALPHA / len(RULES)} END AS q,
                {DELTA / 2} / (SELECT count(DISTINCT stratum) FROM cell) / CASE WHEN rule = 6 THEN 1 ELSE {len(RULES) * len(GRID)} END AS most
         FROM cell),
fine AS (SELECT *, CASE WHEN k >= n * q THEN false ELSE
             list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                 + i * ln(q) + (n - i) * ln(1 - q)))) <= most END AS ok FROM tail),
family AS (SELECT 'split' AS family, stratum, rule, cut, gain FROM fine WHERE ok AND rule < 6
           UNION ALL
           SELECT 'joint', stratum, f.rule, cut, f.gain FROM fine f JOIN fine j USING (stratum, cut)
           WHERE j.rule = 6 AND j.ok AND f.rule < 6),
best AS (SELECT * FROM family QUALIFY row_number() OVER (PARTITION BY family, stratum, rule ORDER BY gain DESC, cut DESC) = 1),
total AS (SELECT family, stratum, sum(gain) AS total FROM best GROUP BY ALL),
used AS (SELECT stratum, CASE WHEN coalesce(max(total) FILTER (family = 'joint'), 0) > coalesce(max(total) FILTER (family = 'split'), 0)
                              THEN 'joint' ELSE 'split' END AS family FROM total GROUP BY stratum),
cuts AS (SELECT stratum, rule, cut FROM best JOIN used USING (stratum, family)),
bad AS (SELECT DISTINCT r FROM s JOIN cuts USING (stratum) WHERE score[rule] >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM s
"""
