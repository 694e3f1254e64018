import hashlib
import random

import numpy as np
import pytest

from hostshelf.llm import fim_chunks as fim


def expected(doc_id, text):
    """The contract, character by character."""
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i:i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    if h4 % 100 < 20:
        return len(t), "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def texts(seed):
    rnd = random.Random(seed)
    passage = "".join(rnd.choices("abcdé漢😀 \n\0", k=3000))
    own = ["", None, "x", "é", "😀", "<P", "P><S", "a<P>b", "<M>", "a" * 200_000, "漢" * 70_000, passage * 3, "\0" * 20_000]
    own += ["".join(rnd.choices("ab<PSM>é😀 ", k=rnd.randrange(60))) for _ in range(120)]
    return own + [f"{i}{passage}{i}" for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_rule_by_characters(spark, frame, seed):
    rows = [(i * 7, t) for i, t in enumerate(texts(seed))] + [(None, "null id"), (7, "x"), (7, "y"), (7, "x")]
    got = fim.transformed(frame(rows)).withColumn("back", fim.restored()).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(
        ((i, *expected(i, t)) for i, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_equal_passages_share_chunks_and_summaries_add_up():
    rnd = np.random.default_rng(1)
    passage = rnd.integers(32, 127, 50_000).astype(np.uint8).tobytes()
    cache = fim.ChunkCache()
    one, two = fim.Units(b"head " + passage, cache), fim.Units(b"another opening " + passage + b" end", cache)
    held = {one.data[a:b] for a, b in zip(one.starts, one.starts[1:])}
    shared = [two.data[a:b] in held for a, b in zip(two.starts, two.starts[1:])]
    assert len(shared) > 20 and sum(shared) >= len(shared) - 3
    text = "".join(random.Random(2).choices("aé漢😀", k=40_000))
    units = fim.Units(text.encode(), cache)
    assert units.n == len(text) and any(units.leads)  # a chunk begins inside a code point
    for k in random.Random(3).sample(range(len(text) + 1), 300):
        assert units.byte_of(k) == len(text[:k].encode())


def test_a_small_cache_gives_the_same_summaries():
    cache = fim.ChunkCache(limit=100)
    for i in range(200):
        chunk = f"é{i}".encode() * (1 + i % 9)
        assert cache.summary(chunk) == fim.summary(chunk) == cache.summary(chunk)
    assert cache.held <= 100 + 40


def test_chunks_are_bounded():
    for data in (b"a" * 100_000, b"", b"x", bytes(range(256)) * 300):
        if data:
            ends = fim.chunk_ends(np.frombuffer(data, np.uint8))
            assert ends[-1] == len(data) and np.diff(ends, prepend=0).max() <= fim.LONGEST and (np.diff(ends, prepend=0) > 0).all()


def test_empty_table(spark, frame):
    assert fim.report(frame([])).collect() == []
