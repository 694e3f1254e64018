import random

import numpy as np
import pytest
import xxhash

from hostshelf.llm import simhash_cover as sim
from hostshelf.llm.common import components


def slow_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute(fps, radius):
    """Component label of every distinct value."""
    values = sorted(set(fps))
    label = {v: v for v in values}
    def find(v):
        while label[v] != v:
            v = label[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


TEXTS = ["one two three four five six seven", "ONE two three four five six seven", "a b", "A  B", "", None, " \n\t", "é É ü Ü",
         "x " * 20000, "漢字 " * 3 + "a", "same " * 9] + [" ".join(random.Random(i).choices("abcdefgh", k=60)) for i in range(20)]


def test_fingerprints_equal_the_definition():
    for t in TEXTS:
        assert sim.fingerprint(t or "") == slow_fingerprint(t)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_pair_within_the_radius_meets_in_some_table(radius):
    rnd, tables = random.Random(radius), sim.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        bits = rnd.sample(range(64), radius)
        differ = sum(1 << b for b in bits)
        assert any(m & differ == 0 for m in tables)


@pytest.mark.parametrize("crowded", [4096, 8])
def test_bucket_edges_span_the_link_graph(monkeypatch, crowded):
    monkeypatch.setattr(sim, "_CROWDED", crowded)
    rnd = random.Random(7)
    mask, fps = sim.masks(4)[6], set()
    centre = [rnd.getrandbits(64) & ~mask for _ in range(6)]
    for c in centre:
        x = c
        for _ in range(60):
            x ^= sum(1 << b for b in rnd.sample([i for i in range(64) if not mask >> i & 1], rnd.randint(1, 6)))
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    edges = sim.bucket_edges(fps, ~mask & (1 << 64) - 1, 4)
    assert len(edges) < len(fps)
    label = {int(f): int(f) for f in fps}
    def find(v):
        while label[v] != v:
            v = label[v]
        return v
    for a, b in edges.tolist():
        label[max(find(a), find(b))] = min(find(a), find(b))
    assert {v: find(v) for v in label} == brute([int(f) for f in fps], 4)


def expected(rows):
    fps = {r: slow_fingerprint(r[1]) for r in rows}
    label = brute(fps.values(), 4)
    ids = {}
    for r, f in fps.items():
        if r[0] is not None:
            ids[label[f]] = min(ids.get(label[f], r[0]), r[0])
    return sorted(((r[0], f"{fps[r]:016x}", ids.get(label[fps[r]])) for r in rows), key=repr)


def test_components_equal_brute_force(frame):
    rnd = random.Random(5)
    base = [" ".join(rnd.choices([f"w{i}" for i in range(300)], k=150)) for _ in range(25)]
    def near(t):
        words = t.split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = "new"
        return " ".join(words)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, near(rnd.choice(base))) for i in range(250)] + [(None, "only here"), (7, TEXTS[7])]
    got = sorted([tuple(r) for r in sim.report(frame(rows)).collect()], key=repr)
    assert got == expected(rows)
    kept = sim.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({x[2] for x in expected(rows) if x[2] is not None})


def test_empty_table(frame):
    assert sim.report(frame([(1, "a")]).where("false")).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (-9, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: -9 for i in range(61)}, **{1000 + i: 1000 for i in range(1, 80)}}
