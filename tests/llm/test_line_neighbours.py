import hashlib
import random

import pytest

from hostshelf.llm import line_neighbours

BLANKS = " \t\n\r\x0b\x0c"


def near(x, y):
    """Edit distance at most 1."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[i + 1:] == y[i + 1:] if len(x) == len(y) else x[i:] == y[i + 1:]


def brute(rows, min_chars=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    place = lambda k, i: (rows[k][0] is not None, rows[k][0] or 0, i)
    lines = [(place(k, i), x) for k in order for i, x in enumerate((rows[k][1] or "").split("\n")) if x.strip(BLANKS)]
    out = []
    for k in range(len(rows)):
        kept, n, gone, n_near = [], 0, 0, 0
        for i, x in enumerate((rows[k][1] or "").split("\n")):
            if not x.strip(BLANKS):
                kept.append(x)
                continue
            n += 1
            before = [y for p, y in lines if p < place(k, i)]
            same = x in before
            close = len(x) >= min_chars and any(len(y) >= min_chars and y != x and near(x, y) for y in before)
            if same or close:
                gone += 1
                n_near += not same
            else:
                kept.append(x)
        out.append((rows[k][0], n, gone, n_near, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def changed(rnd, s):
    s = list(s)
    for _ in range(rnd.choice([0, 1, 1, 1, 2])):
        kind, i = rnd.choice("sid"), rnd.randint(0, len(s))
        if kind == "i":
            s.insert(i, rnd.choice("abé漢"))
        elif i < len(s):
            s[i:i + 1] = [] if kind == "d" else [rnd.choice("abé😀")]
    return "".join(s)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(frame, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("ab éñ漢😀", k=rnd.randint(18, 60))) for _ in range(14)]
    rows = [(i, "\n".join(rnd.choice([changed(rnd, rnd.choice(base)), "short", "", "  "]) if rnd.random() < 0.9
                          else "x" * rnd.randint(19, 23) for _ in range(rnd.randint(0, 9)))) for i in range(90)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, base[0]), (7, rows[7][1]), (503, "y" * 30000), (504, "y" * 30001 + "\r")]
    got = sorted((tuple(r) for r in line_neighbours.report(frame(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_a_key_shared_by_very_many_lines(frame):
    rows = [(i, f"a line about number {chr(0x4E00 + i)} here") for i in range(300)] + [(i, "hot line of the corpus") for i in range(300, 500)]
    got = line_neighbours.report(frame(rows)).collect()
    assert sum(r.n_removed for r in got) == 299 + 199


def test_empty_table(frame):
    assert line_neighbours.report(frame([(1, "a")]).where("false")).collect() == []


def test_rows_that_share_an_id(frame):
    """Lines at one place of two texts with one id: a near copy of either goes, and the two stay apart."""
    one, two = "the first of two quite different lines", "another line that nobody else would write"
    rows = [(1, one), (1, two), (1, one[:-1] + "x"), (2, one + "s"), (3, two[1:]), (None, one[1:]), (None, two + "!")]
    got = line_neighbours.report(frame(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
