import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hostshelf.llm import catalog
from hostshelf.llm import residual_packing as pack

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = ["École, ", "Wort.", "mot&&&", "mot.'s", "x<|", "a_b_", "(a)", "NAÏVE! ", "I.", "xÿ", "a×b", "÷", "ß", "ǰ", "J\u030c", "s", "<|ENDOFTEXT|>", ", ", "Alpha ", "beta's ", "gamma\n", "漢字", "１２3 ", "!?", "<|endoftext|>", " <|startoftext|> ", "é", "́", "İΣ",
         " ", "\x1c", "\x85", " ", "don't ", "''ll", "\t", "\x0b", "ﬁ", "각", "가", " ̈", "\0"]


def true_ids(tok, text):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, pieces, capacity):
    """All ids in order, only longer documents cut, gapless sequences; returns tokens per sequence."""
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = true_ids(tok, t)
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[i, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert all(0 < n <= capacity for n in sequences.values())
    return sequences


@pytest.mark.parametrize("settings_", [{}, {"capacity": 64, "slack": 1}, {"capacity": 64, "slack": 2, "pool": 16, "group": 24}])
def test_pieces_and_sequences(spark, frame, settings_):
    rnd = random.Random(len(settings_))
    rows = [(i, "".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 5, 20, 60, 200])))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "x y"), (7, rows[7][1]), (7, "another"), (902, "word " * 9000), (903, "a" * 40_000)]
    pieces = pack.packed(frame(rows).repartition(7), PATH, **settings_).collect()
    capacity = settings_.get("capacity", pack.CAPACITY)
    sequences = check(rows, pieces, capacity)
    fewest = -(-sum(sequences.values()) // capacity)
    assert len(sequences) <= fewest * 1.04 + 1


def test_residual_bins_of_many_partitions_meet(spark, frame):
    """Every partition alone leaves a bin of a quarter; merged they are as few as can be."""
    rows = [(i, "the " * 15) for i in range(64)]
    pieces = pack.packed(frame(rows).repartition(64), PATH, capacity=64, slack=0).collect()
    assert len(check(rows, pieces, 64)) == 16


def test_bins_that_cannot_merge_end_the_rounds(spark, frame):
    rows = [(i, "the " * 40) for i in range(200)]
    pieces = pack.packed(frame(rows).repartition(8), PATH, capacity=64, slack=0, group=10).collect()
    assert len(check(rows, pieces, 64)) == 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(WORDS) | st.text(max_size=6), max_size=25))
def test_ids_equal_the_library(parts):
    text = "".join(parts)
    with open(PATH, encoding="utf-8") as f:
        encoder = pack.Encoder.shared(PATH, f.read())
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == true_ids(encoder.tokenizer, text)[:-1].tolist()


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(pack, "_KNOWN", 3)
    with open(PATH, encoding="utf-8") as f:
        encoder = pack.Encoder(f.read())
    text = " ".join(random.Random(1).choices(["one", "two", "three", "four", "five's", "six", "x" * 90], k=400))
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == true_ids(encoder.tokenizer, text)[:-1].tolist()
    assert len(encoder) <= 3 and len(encoder.older) <= 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_follows_its_rule(sizes):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in bins if 40 - sum(sizes[x] for x in b) >= sizes[i]]
        if fits:
            max(fits, key=lambda b: sum(sizes[x] for x in b)).append(i)
        else:
            bins.append([i])
    got = pack.best_fit(sizes, 40)
    assert sorted(x for own, _ in got for x in own) == list(range(len(sizes)))
    assert all(room == 40 - sum(sizes[x] for x in own) for own, room in got)
    assert sorted(room for _, room in got) == sorted(40 - sum(sizes[x] for x in b) for b in bins)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sequences = check(rows, catalog.op13_residual_packing(spark, sf).collect(), pack.CAPACITY)
    assert len(sequences) <= -(-sum(sequences.values()) // pack.CAPACITY) + 1


def test_empty_table(spark, frame):
    assert pack.packed(frame([]), PATH).collect() == []
