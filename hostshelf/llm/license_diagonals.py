"""License scans by diagonal voting (DataFrame functions only).

All rolling word k-grams of a document are hashed and joined to the positions
of the same grams in a fixed set of templates. A hit at document word i and
template word p votes for diagonal i - p. Votes are counted per (document,
template, diagonal), neighbouring diagonals (a word more or less in between)
are merged, and every merged span is verified word by word against the
template. Short phrases (the base ones) use 2-grams and must match in full;
longer templates use 3-grams and need a share `min_cover` of their words.

The template table has a few hundred rows, fixed in this file, so broadcasting
it is bounded. Hits are pre-aggregated per diagonal before the shuffle; the
text is read a second time only for verification.

Defined results: null text has no words; n copies of one row (same id, same
text) give n equal result rows; no hit gives empty labels, null first_word and
last_word, and score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hostshelf.llm.common import keyed, staged

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases of the contract and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices and opening passages of public licences, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under the mozilla public license version 2 0", "mpl-2.0"),
    ("this file is licensed under the bsd 3 clause license", "bsd-3-clause"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies", "isc-text"),
)

GRAM, SHORT_GRAM = 3, 2
MIN_COVER, SLACK = 0.9, 2
_OWN = "own row"  # stands for the document itself, so that one pass also returns documents without a hit


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def _gram(words: Column, i: Column, k: int) -> Column:
    """Hash of k words from place i (from 0) on; the length is hashed too."""
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def _places(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def templates(spark, base=BASE, more=TEMPLATES) -> DataFrame:
    """(template, label, base, t_words, k): one row per template."""
    rows = [(i, label, i < len(base), text.split(" "), SHORT_GRAM if i < len(base) else GRAM)
            for i, (text, label) in enumerate([*base, *more])]
    return spark.createDataFrame(rows, "template int, label string, base boolean, t_words array<string>, k int")


def _positions(t: DataFrame) -> DataFrame:
    """(h, template, p): every gram of every template, and the documents' own row."""
    grams = [t.where(F.col("k") == k).select("template", F.posexplode(F.transform(
        _places(F.col("t_words"), k), lambda i: _gram(F.col("t_words"), i, k))).alias("p", "h")) for k in (SHORT_GRAM, GRAM)]
    own = t.limit(1).select(F.lit(-1).alias("template"), F.lit(0).alias("p"), F.xxhash64(F.lit(_OWN)).alias("h"))
    return grams[0].union(grams[1]).union(own)


def diagonals(docs: DataFrame, t: DataFrame, short_words: list[str]) -> DataFrame:
    """(doc_id, text_key, n_words, template, d, votes, lo, hi): votes per diagonal; template -1 counts equal rows."""
    w = F.col("words")
    short = F.transform(F.filter(_places(w, SHORT_GRAM), lambda i: F.get(w, i + 1).isin(short_words)),
                        lambda i: F.struct(i.alias("i"), _gram(w, i, SHORT_GRAM).alias("h")))
    long = F.transform(_places(w, GRAM), lambda i: F.struct(i.alias("i"), _gram(w, i, GRAM).alias("h")))
    own = F.array(F.struct(F.lit(0).alias("i"), F.xxhash64(F.lit(_OWN)).alias("h")))
    grams = (keyed(docs).select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
             .select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
                     F.explode(F.concat(own, short, long)).alias("g"))
             .select("doc_id", "text_key", "n_words", F.col("g.i").alias("i"), F.col("g.h").alias("h")))
    return (grams.join(F.broadcast(_positions(t)), "h")  # fixed in this file
            .groupBy("doc_id", "text_key", "n_words", "template", (F.col("i") - F.col("p")).alias("d"))
            .agg(F.count("*").alias("votes"), F.min("i").alias("lo"), F.max("i").alias("hi")))


def spans(votes: DataFrame, t: DataFrame, slack: int = SLACK) -> DataFrame:
    """Merge diagonals of one template that are at most `slack` apart: parts (d, lo, hi) per span."""
    key = ["doc_id", "text_key", "template"]
    order = Window.partitionBy(*key).orderBy("d")
    apart = F.when(F.col("base") | (F.col("d") - F.lag("d").over(order) > slack), 1).otherwise(0)
    hit = votes.join(F.broadcast(t), "template")
    hit = hit.where(~F.col("base") | (F.col("votes") >= F.size("t_words") - 1))  # >=: equal rows vote together
    return (hit.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
            .groupBy(*key, "span").agg(F.collect_list(F.struct("d", "lo", "hi")).alias("parts")))


def verified(found: DataFrame, docs: DataFrame, t: DataFrame) -> DataFrame:
    """Each span with the share `cover` of the template's words that stand in the text where the votes say."""
    w, tw, k = F.col("words"), F.col("t_words"), F.col("k")
    def stands(s: Column) -> Column:
        at = F.filter(F.sequence(s["lo"], s["hi"] + k - 1), lambda i: F.get(w, i) == F.get(tw, i - s["d"]))
        return F.transform(at, lambda i: i - s["d"])
    by_doc = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("template", "span", "parts")).alias("s"))
    return (by_doc.alias("f").join(keyed(docs).alias("x"), F.expr("f.doc_id <=> x.doc_id AND f.text_key = x.text_key"))
            .select("f.doc_id", "f.text_key", words_of(F.col("x.text")).alias("words"), F.explode("f.s").alias("s"))
            .select("doc_id", "text_key", "words", "s.template", "s.span", "s.parts")
            .join(F.broadcast(t), "template")
            .select("doc_id", "text_key", "template", "span", "label", "base",
                    F.array_min(F.transform("parts", lambda x: x["d"])).alias("start"),
                    (F.size(F.array_distinct(F.flatten(F.transform("parts", stands)))) / F.size(tw)).alias("cover"))
            .dropDuplicates(["doc_id", "text_key", "template", "span"]))


def scan(docs: DataFrame, base=BASE, more=TEMPLATES, min_cover: float = MIN_COVER, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """(votes, spans): the votes per diagonal, and the verified spans (doc_id, text_key, label, base, start, cover)."""
    t = templates(docs.sparkSession, base, more)
    short = sorted({w for text, _ in base for w in text.split(" ")[1:]})
    votes = staged(diagonals(docs, t, short), "votes")
    found = verified(spans(votes.where("template >= 0"), t, slack), docs, t)
    found = found.where(F.when(F.col("base"), F.col("cover") >= 1.0).otherwise(F.col("cover") >= min_cover))
    return votes, found


def report(docs: DataFrame, **method) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    votes, found = scan(docs, **method)
    base = F.col("base")
    joined = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"))
    own = votes.where("template = -1").select("doc_id", "text_key", "n_words", F.col("votes").alias("copies"))
    return (own.alias("o").join(per_doc.alias("f"), F.expr("o.doc_id <=> f.doc_id AND o.text_key = f.text_key"), "left")
            .select("o.doc_id", "o.n_words", F.coalesce("f.n_base", F.lit(0).cast("long")).alias("n_base"),
                    "f.first_word", "f.last_word", F.coalesce("f.base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("f.labels", F.lit("")).alias("labels"), F.coalesce("f.score", F.lit(0.0)).alias("score"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("o.copies"))).alias("copy"))
            .drop("copy"))
