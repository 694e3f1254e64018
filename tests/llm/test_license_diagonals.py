import re

from hostshelf.llm import license_diagonals as lic

PHRASES = [(p.split(), label) for p, label in lic.BASE]


def brute(i, t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    hits = [(k, label) for k in range(len(w)) for p, label in PHRASES if w[k:k + len(p)] == p]
    places = [k for k, _ in hits]
    return i, len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


ROWS = [(1, "Released under the MIT License."), (2, "GNU General Public License, GNU-general/public license; cc by cc by-nc"),
        (3, None), (4, ""), (5, "gnu general public"), (6, "The apache\tLICENSE mit\x00license m it license"), (6, "The apache\tLICENSE mit\x00license m it license"),
        (7, "mit license " * 3000), (8, "mité license émit license K cc  by"), (None, "cc-by"), (9, "word " * 50000 + "apache license"),
        (10, "Licensed under the Apache License, Version 2.0"), (11, "gnu gnu general public license license")]


def test_base_equals_brute_force(frame):
    got = [tuple(r)[:6] for r in lic.report(frame(ROWS)).collect()]
    assert sorted(got, key=repr) == sorted((brute(*r) for r in ROWS), key=repr)


def test_method_labels_tolerate_small_changes(frame):
    mit = dict((label, text) for text, label in lic.TEMPLATES)["mit-text"]
    words = mit.split()
    words[20:20] = ["really"]
    words[40] = "changed"
    rows = [(1, mit.upper()), (2, "preface " + " ".join(words) + " end"), (3, " ".join(words[:15])), (4, " ".join(reversed(words))),
            (5, "licensed under the mozilla public license version 2 0")]
    got = {r.doc_id: r for r in lic.report(frame(rows)).collect()}
    assert got[1].labels == "mit-text" and got[1].score == 1.0
    assert got[2].labels == "mit-text" and 0.9 <= got[2].score < 1
    assert got[3].labels == "" and got[4].labels == "" and got[3].score == 0.0
    assert got[5].labels == "mpl-2.0" and got[5].n_base == 0


def test_labels_hold_the_base_ones_and_scores_stay_in_range(frame):
    for r in lic.report(frame(ROWS)).collect():
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.labels == "")


def test_empty_table(frame):
    assert lic.report(frame([(1, "a")]).where("false")).collect() == []


def test_no_python_in_the_plan(frame):
    plan = lic.report(frame(ROWS).drop("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
