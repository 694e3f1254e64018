import math
import random
import zlib

import pytest

from hostshelf.llm import lang_backoff as lang
from hostshelf.llm.common import documents

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    docs = documents(spark, SF01)
    got = lang.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_does_not_see_labels_of_the_held_out_fold(spark, frame):
    rows = [(i, "the cat and the dog of the house" if i % 2 else "der hund und die katze im haus", "en" if i % 2 else "de", "s")
            for i in range(60)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else l, s) for i, t, l, s in rows]
    a, b = (sorted(map(tuple, lang.report(frame(r)).collect())) for r in (rows, wrong))
    assert a == b and {x[2] for x in a} == {"en", "de"}


def test_backoff_for_unseen_words_and_defined_cases(frame):
    train = [(i, "walking talking running jumping" if i % 2 else "gehende laufende springende rennende", "en" if i % 2 else "de", "s")
             for i in range(80)]
    cases = [(1001, "swimming", None, None), (1002, "badende", None, None), (1003, None, "en", None), (1004, "123 !?", "de", None),
             (1005, "", None, None), (None, "walking", "en", None), (1003, None, "en", None), (1006, "walking " * 30000, None, None),
             (1007, "漢字", None, None)]
    got = [tuple(r) for r in lang.report(frame(train + cases)).collect()]
    assert len(got) == 89
    by = {r[0]: r for r in got}
    assert by[1001][2] == "en" and by[1002][2] == "de" and by[1006][2] == "en" and by[1007][2] in ("en", "de")
    assert [by[i][2:] for i in (1003, 1004, 1005)] == [("und", 0.0)] * 3
    assert by[None][1] is False and by[None][2] == "en"


def test_bounded_model_still_scores(frame):
    rows = [(i, "one two three four" if i % 2 else "eins zwei drei vier", "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100 + i, "often often rest", "en", "s") for i in range(40)]
    model = lang.learn(frame(rows), max_words=2, max_grams=30)
    assert set(model.index[0]) == {"often", "rest", "drei", "eins"}  # two of each language, equals by their order
    assert len(model.index[4]) <= 60 and len(model.starts) == 1 + sum(map(len, model.index.values()))
    assert model.predict("often")[0] == "en" and model.predict("oft")[0] == "en"


def _plainly(rows, max_words, max_grams, min_count):
    """The kept units and their logarithms, counted without Spark."""
    n, totals = {}, {}
    for i, text, label, *_ in rows:
        if label is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        for w in lang.words_of(text):
            for unit in [(0, w)] + [(o, g) for o in lang.ORDERS for g in lang.grams_of(w, o)]:
                n[label, unit] = n.get((label, unit), 0) + 1
                totals[label, unit[0]] = totals.get((label, unit[0]), 0) + 1
    langs, kept = sorted({x for x, _ in n}), set()
    for x in langs:
        for o in (0, *lang.ORDERS):
            ranked = sorted((-c, u) for (y, u), c in n.items() if y == x and u[0] == o and c >= min_count)
            kept |= {u for _, u in ranked[:max_grams if o else max_words]}
    size = {o: max(1, sum(u[0] == o for u in kept)) for o in (0, *lang.ORDERS)}
    return langs, {u: [math.log((n.get((x, u), 0) + 0.5) / (totals.get((x, u[0]), 0) + 0.5 * size[u[0]])) for x in langs] for u in kept}


def test_model_and_prediction_equal_a_plain_count(frame):
    rng = random.Random(5)
    vocab = {x: ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60)]
             for x, letters in (("aa", "abcdef"), ("bb", "cdefgh"), ("cc", "xyzabc"))}
    rows = [(i, " ".join(rng.choices(vocab[x], k=rng.randint(1, 30))), x, "s") for i, x in enumerate(rng.choices(list(vocab), k=120))]
    model = lang.learn(frame(rows), max_words=20, max_grams=15, min_count=2)
    langs, logs = _plainly(rows, 20, 15, 2)
    assert model.langs == langs and {(o, u) for o, units in model.index.items() for u in units} == set(logs)
    for (o, u), want in logs.items():
        assert model.logs(o, model.index[o][u]).tolist() == pytest.approx(want)
    small = lang.learn(frame(rows), max_words=20, max_grams=15, min_count=2)
    small.room = 3  # the worker's table is emptied within a text
    for _, text, *_ in rows:
        total = [0.0] * len(langs)
        for w in lang.words_of(text):
            found = [logs[0, w]] if (0, w) in logs else next(
                (g for o in lang.ORDERS if (g := [logs[o, x] for x in lang.grams_of(w, o) if (o, x) in logs])), [])
            total = [a + sum(f[i] for f in found) / max(1, len(found)) for i, a in enumerate(total)]
        share = [math.exp(a - max(total)) for a in total]
        for m in (model, small):
            best, score = m.predict(text)
            assert share[langs.index(best)] == pytest.approx(1.0) and score == pytest.approx(1 / sum(share))


def test_a_rare_language_keeps_its_words(frame):
    rng = random.Random(7)
    words = {x: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)] for x in ("big", "rare")}
    rows = [(i, " ".join(rng.choices(words["rare" if i % 1000 == 1 else "big"], k=60)), "rare" if i % 1000 == 1 else "big", "s")
            for i in range(12_000)]
    model = lang.learn(frame(rows), max_words=300, max_grams=200, min_count=1)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    fresh = [" ".join(rng.choices(words["rare"], k=60)) for _ in range(50)]
    assert [model.predict(t)[0] for t in fresh].count("rare") >= 49
    assert sum(model.predict(t)[0] == x for _, t, x, _ in held) >= 0.99 * len(held)


def test_very_many_languages(frame):
    rows = [(i, f"word{chr(97 + i % 26)} " + "".join(chr(97 + int(d)) for d in str(i)) * 3, f"l{i:04d}", "s") for i in range(1500)]
    got = lang.report(frame(rows), min_count=1).collect()
    assert len(got) == 1500 and all(0 < r.score <= 1 for r in got)


def test_no_training_rows(frame):
    got = lang.report(frame([(1, "words here", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert lang.report(frame([(1, "a")]).where("false")).collect() == []


@pytest.mark.parametrize("word,order,want", [("ab", 4, ["^ab$"]), ("ab", 3, ["^ab", "ab$"]), ("ab", 1, ["a", "b"]), ("a", 4, [])])
def test_grams(word, order, want):
    assert lang.grams_of(word, order) == want


def test_both_patterns_agree_below_the_marks():
    low = "".join(chr(c) for c in range(0x300) if not lang._MARK_OR_SIGN.search(chr(c)))
    assert lang._PLAIN_LETTERS.findall(low) == lang._LETTERS.findall(low)


def test_words_need_a_letter(frame):
    from hostshelf.llm.lang_backoff import words_of
    assert words_of("½ ² ① Ⅷ 12 _") == [] and words_of(None) == []
    assert words_of("हिन्दी ไทยที่ e\u0301te\u0301 x² naïve_漢字") == ["हिन्दी", "ไทยที่", "e\u0301te\u0301", "x", "naïve", "漢字"]
    rows = [(i, "plain words of a text", "en") for i in range(40)] + [(100, "½ ²"), (101, "\u0301\u0301"), (102, "12 ③")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.report(frame(rows)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[1][0] == "en"
