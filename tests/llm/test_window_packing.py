import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostshelf.llm import window_packing as pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["alpha", " beta", "gamma\n", " 漢字", " 1234", "!?", " <|endoftext|>", "  "]


def check(rows, pieces):
    """Every id lies in exactly one piece; sequences are gapless and short of 1024 only in the last of a partition."""
    tok = Tokenizer.from_file(PATH)
    want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    left = sorted(((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, want)), key=repr)
    ids = {}
    for (i, _), x in zip(rows, want):
        ids.setdefault((i, len(x)), []).append(x)
    spans = {}
    for p in pieces:
        spans.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert sum(p.length for p in pieces) == sum(map(len, want)) and len(left) == len(rows)
    for key, own in spans.items():
        copies = ids[key]
        for p in own:
            assert any(zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for x in copies)
        count = np.zeros(key[1], int)
        for p in own:
            count[p.start:p.start + p.length] += 1
        assert (count == len(copies)).all()
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    short = [s for s, n in sequences.items() if n & (n - 1)]
    assert all(n <= 1024 for n in sequences.values())
    assert len(short) <= len({s >> 40 for s in sequences})
    return sequences


@pytest.mark.parametrize("pool", [1 << 20, 3000])
def test_pieces_cover_all_ids_with_little_padding(frame, monkeypatch, pool):
    monkeypatch.setattr(pack, "POOL_TOKENS", pool)
    rnd = random.Random(pool)
    rows = [(i, "".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 30, 200, 400, 700, 3000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "x y"), (7, rows[7][1]), (502, "word " * 30000)]
    pieces = pack.packed(frame(rows).coalesce(2), PATH).collect()
    sequences = check(rows, pieces)
    assert {n for n in sequences.values() if not n & (n - 1)} >= {1024}


def test_tiers_hold_items_of_their_own_length():
    packer = pack._Packer(0, pack.TIERS)
    for i, n in enumerate([700, 600, 300, 300, 200, 100, 90, 500, 1024, 2500]):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.pack()
    by = {}
    for r in packer.rows:
        by.setdefault(r[5], []).append(r)
    for rows in by.values():
        tier = rows[0][7]
        assert sum(r[2] for r in rows) == tier
    assert sum(x[0] for x in packer.open) < 128
    packer.pack(last=True)
    assert not packer.open and sum(r[2] for r in packer.rows) == 700 + 600 + 300 + 300 + 200 + 100 + 90 + 500 + 1024 + 2500


def test_step_groups_have_equal_tokens():
    packer = pack._Packer(0, pack.TIERS)
    for i in range(200):
        packer.add(i, np.zeros(1024, "<u4"))
    steps = {}
    for r in packer.rows:
        steps[r[8]] = steps.get(r[8], 0) + r[2]
    assert sorted(steps.values())[1:] == [pack.STEP_TOKENS] * (len(steps) - 1)


def test_empty_table(frame):
    assert pack.packed(frame([(1, "a")]).where("false"), PATH).collect() == []


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "\n" * 1_000_000, " \n\t" * 400_000 + "x", "x " * 10 + " " * 1_000_000 + "é"])
def test_long_runs(frame, text):
    rows = [(1, "before"), (2, text), (3, "after")]
    check(rows, pack.packed(frame(rows), PATH).collect())
