import hashlib
import random
import re

import numpy as np
import pytest

from hostshelf.llm import anchors, phrase_automata, repeat_tree

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n=60, unit=None):
    """Random texts with shared passages, nested and overlapping ones, repeats inside one text, exact copies."""
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choices(WORDS, k=rnd.choice([20, 36, 50, 90]))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 60))) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(0, 3)):
            words = rnd.choice(passages).split()
            a = rnd.randint(0, len(words) // 2)
            parts.insert(rnd.randint(0, len(parts)), " ".join(words[a:rnd.randint(a, len(words))]))
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, " \n "), (505, "é漢😀" * 200), (506, "漢😀é" * 200),
             (507, "ab" * 3000), (508, "x " * 3000), (None, rows[5][1]), (3, rows[3][1]), (509, "\0" * 300), (510, "\0" * 250 + "a")]
    return rows


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_words(rows, w):
    seen = {}
    for i, t in rows:
        x = words_of(t)
        for j in range(len(x) - w + 1):
            seen[tuple(x[j:j + w])] = seen.get(tuple(x[j:j + w]), 0) + 1
    out = []
    for i, t in rows:
        x = words_of(t)
        gone = set()
        for j in range(len(x) - w + 1):
            if seen[tuple(x[j:j + w])] > 1:
                gone.update(range(j, j + w))
        kept = " ".join(x[j] for j in range(len(x)) if j not in gone)
        out.append((i, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, w):
    """Places are (doc_id, start); equal rows have equal places."""
    first = {}
    order = lambda i: (i is not None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - w + 1):
            p = (*order(i), j)
            first[b[j:j + w]] = min(first.get(b[j:j + w], p), p)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - w + 1):
            if first[b[j:j + w]] < (*order(i), j):
                gone[j:j + w] = True
        gone = gone[:len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        n_spans = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("seed,crowd", [(1, 20_000), (2, 1)])
def test_words_equal_brute_force(frame, seed, crowd):
    rows = corpus(seed)
    assert rows_of(phrase_automata.report(frame(rows), crowd=crowd)) == brute_words(rows, 35)


@pytest.mark.parametrize("seed,crowd", [(3, 20_000), (4, 1)])
def test_bytes_equal_brute_force(frame, seed, crowd):
    rows = corpus(seed)
    assert rows_of(repeat_tree.report(frame(rows), crowd=crowd)) == brute_bytes(rows, 100)


def test_long_texts_in_pieces(monkeypatch, spark):
    """Texts over the chunk size are cut into overlapping pieces (seen here without Spark)."""
    monkeypatch.setattr(anchors, "CHUNK", 1 << 10)
    import pyarrow as pa
    rnd = random.Random(9)
    text = " ".join(rnd.choices(WORDS, k=4000))
    for kind in (anchors.Kind(True, 35, 8), anchors.Kind(False, 100, 24)):
        got = [x for x in anchors.batch_blocks(pa.array(["", text, "", "a b", text[:5000], ""]), kind)]
        n = len(text.split()) if kind.words else len(text)
        for doc, size in ((1, n), (4, len(text[:5000].split()) if kind.words else 5000)):
            starts = sorted((s, s + length - kind.window) for _, _, t, ss, nn in got for d, s, length in zip(t, ss, nn) if d == doc)
            assert [a for a, _ in starts[1:]] == [b + 1 for _, b in starts[:-1]]
            assert starts[0][0] == 0 and starts[-1][1] == size - kind.window
        hashes = {}
        for h, g, t, s, nn in got:
            for x in zip(h.tolist(), g.tolist(), t.tolist(), s.tolist(), nn.tolist()):
                hashes.setdefault(x[2], set()).add(x[:2] + x[3:])
        assert len(hashes[4] & hashes[1]) > 0.5 * len(hashes[4])


def test_maximal_repeats_are_left_diverse_with_all_occurrences():
    rnd = random.Random(2)
    core = "".join(rnd.choices("abcdefgh", k=30))
    bodies = [f"{l}{core}{r}".encode() for l, r in (("x1", "yy"), ("x1", "yz"), ("q2", "yy"), ("zz", "pp"))]
    rows = {"body": bodies, "left": [-1] * 4, "ord": [0, 1, 2, 3], "text_key": [0] * 4, "s": [0] * 4}
    found = {(depth, tuple(o[:2] for o in occ)) for depth, occ in repeat_tree.maximal_repeats(rows, 20)}
    whole = [b.find(core.encode()) for b in bodies]
    assert (30, tuple((i, whole[i]) for i in range(4))) in found
    assert (32, ((0, 2), (2, 2))) in found and (33, ((0, 0), (1, 0))) in found
    assert all(len(occ) > 1 for _, occ in found)


def test_interval_tree_marks_each_loser_once_with_its_longest_earlier_match():
    rnd = random.Random(4)
    for _ in range(200):
        words = sorted("".join(rnd.choices("ab", k=8)) for _ in range(rnd.randint(1, 12)))
        lcp = [next((i for i in range(8) if a[i] != b[i]), 8) for a, b in zip(words, words[1:])]
        place = list(range(len(words)))
        rnd.shuffle(place)
        marks = {x: d for _, _, d, x in repeat_tree.interval_tree(lcp, place, 3) if x is not None}
        for i, w in enumerate(words):
            best = max((next((k for k in range(8) if w[k] != v[k]), 8) for j, v in enumerate(words) if place[j] < place[i]), default=0)
            assert marks.get(i, 0) == (best if best >= 3 else 0)


def test_repeat_groups_report_every_class(frame):
    rows = corpus(8, n=30)
    groups = repeat_tree.repeat_groups(frame(rows)).collect()
    text = {i: (t or "").encode() for i, t in rows}
    by = {}
    for r in groups:
        by.setdefault(r.group, set()).add(text[r.doc_id][r.start:r.start + r.length])
        assert r.length >= 100
    assert by and all(len(x) == 1 for x in by.values())


def test_cleaned_keeps_layout_and_clean_documents(frame):
    passage = " ".join(WORDS[:40])
    rows = [(1, f"start  here\n{passage}\nend  there", "en", "s"), (2, f"{passage}", "en", "s"), (3, "clean\n\ttext", "de", "s"),
            (4, f"other {passage} tail", "fr", None), (5, None, None, None), (6, "", "en", "s")]
    got = phrase_automata.cleaned(frame(rows, extra=False)).collect()
    assert {r.doc_id: r.text for r in got} == {1: "start  here\nend  there", 3: "clean\n\ttext", 4: "other tail", 5: None, 6: ""}
    assert {r.doc_id: r.n_chars for r in got}[1] == len("start  here\nend  there")


def test_empty_table(frame):
    for f in (phrase_automata.report, repeat_tree.report, phrase_automata.cleaned):
        assert f(frame([(1, "a")]).where("false")).collect() == []


def test_zero_bytes_at_the_end_of_a_block(frame):
    p = "".join(random.Random(3).choices("abcdefgh", k=100))
    rows = [(1, "x" + p + "\0"), (2, "z" + p), (3, "y" + p + "\0")]
    assert [r.n_removed for r in sorted(repeat_tree.report(frame(rows)).collect(), key=lambda r: r.doc_id)] == [0, 100, 101]


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_of_zero_bytes_equal_brute_force(frame, seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choices("\0\0ab", k=rnd.randint(60, 240))) for _ in range(6)]
    rows = [(i, "".join(rnd.choice(parts)[rnd.randint(0, 40):] for _ in range(rnd.randint(1, 4))) + "\0" * rnd.randint(0, 3)) for i in range(25)]
    assert rows_of(repeat_tree.report(frame(rows))) == brute_bytes(rows, 100)


def test_spans_are_merged_within_documents():
    rng = random.Random(3)
    found = [(rng.choice([1, 2, -(1 << 63)]), rng.choice([-5, 9]), rng.randint(0, 200), rng.randint(1, 9)) for _ in range(150)]
    out = [tuple(r.values()) for b in anchors.merged([anchors.span_batch(found)]) for r in b.to_pylist()]
    cells = lambda spans: {(o, k, i) for o, k, s, n in spans for i in range(s, s + n)}
    assert cells(out) == cells(found) and sum(n for *_, n in out) == len(cells(found))
    assert not any((o, k, s + n) in cells(out) for o, k, s, n in out)
    assert list(anchors.merged([anchors.span_batch([])])) == []


@pytest.mark.parametrize("crowd", [anchors.CROWD, 1])
def test_a_task_runs_one_python_worker(frame, crowd):
    """Between two exchanges there is at most one Python operator: chained ones hold a worker's memory each, at the same time."""
    docs = frame(corpus(4))
    for made in (phrase_automata.cleaned(docs, crowd=crowd), repeat_tree.without_repeats(docs, crowd=crowd)):
        above = []
        for line in made._jdf.queryExecution().executedPlan().toString().split("\n"):
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in above if x[0] < depth]
            name = line[depth:].split("(")[0].split(" ")[0].lstrip("*")
            if name == "MapInArrow":
                own = [n for _, n in above]
                last = max((i for i, n in enumerate(own) if n == "Exchange"), default=-1)
                assert "MapInArrow" not in own[last + 1:], own
            above.append((depth, name))


def test_passages_of_many_blocks_with_one_phrase():
    """Many different blocks around one phrase: the phrase and what goes on with it, as by plain counting of places."""
    rnd = random.Random(8)
    phrase = tuple(range(100, 160))
    for window, n, words in ((35, 400, 5000), (3, 60, 3), (4, 60, 2)):
        blocks = []
        for _ in range(n):
            own = tuple(rnd.choices(range(words), k=rnd.randrange(30)))
            blocks.append((own + phrase[rnd.randrange(30):rnd.randrange(30, 60)], rnd.choice([1, 1, 1, 2])))
        places = {}
        for j, (x, _) in enumerate(blocks):
            for i in range(len(x) - window + 1):
                places.setdefault(x[i:i + window], []).append((j, i))
        expected = set()
        for x, _ in blocks:
            at = [places[x[i:i + window]] for i in range(len(x) - window + 1)]
            again = [sum(blocks[j][1] for j, _ in p) > 1 for p in at]
            joined = [i > 0 and [(j, k + 1) for j, k in at[i - 1]] == at[i] for i in range(len(at))]
            for i in range(len(at)):
                if again[i] and not joined[i]:
                    stop = i + 1
                    while stop < len(at) and joined[stop]:
                        stop += 1
                    expected.add(x[i:stop + window - 1])
        assert phrase_automata.passages(blocks, window) == expected
    assert phrase_automata.passages([], 35) == phrase_automata.passages([((1, 2), 5), ((), 1)], 35) == set()


def test_long_runs_of_one_unit(frame):
    size = 300_000
    rows = [(1, "a" * size), (2, "b" + "a" * size), (3, "w " * 40_000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeat_tree.report(frame(rows)).collect()}
    assert got == {1: (size, size - 1, 1), 2: (size + 1, size, 1), 3: (80_000, 79_998, 1)}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in phrase_automata.report(frame(rows)).collect()}
    assert words == {1: (1, 0), 2: (1, 0), 3: (40_000, 40_000)}
