import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hostshelf.llm import quality_risk as q


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(t):
    w = words_of(t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    cover = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    n = len(w)
    return (n, len("".join(w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover),
            n < 20 or 100 * len(cover) > 30 * n)


TEXTS = ["", None, " \n\n ", "a " * 25, "a b c d e f g h i j k l m n o p q r s t u", ("one two three four five six seven eight nine ten " * 3),
         "x y z w v u t s r q p o n m l k j i h g f e " + "p1 p2 p3 p4 p5 p6 p7 p8 p9 mid p1 p2 p3 p4 p5 p6 p7 p8 tail",
         "l1 é漢\nl1 é漢\n\nl1 é漢 \n# * $ % & | < > !", " ".join(f"w{i}" for i in range(30000)), "same\n" * 5000, "\ta\x0bb\x0cc\r\nd" * 9]


def test_base_counts_equal_brute_force(spark, frame):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "a b")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in q.report(frame(rows), labels).collect()]
    want = [(i, *brute(t), not brute(t)[-1]) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n,p", [(1, 0.01), (50, 0.1), (400, 0.01), (5000, 0.002)])
def test_binomial_tail(spark, n, p):
    ks = [k for k in {0, 1, 2, 3, int(n * p / 2)} if k < n * p]
    rows = spark.createDataFrame([(n, k) for k in ks], "n long, k long").select("k", q.log_binomial_cdf(F.col("n"), F.col("k"), p).alias("c"))
    for r in rows.collect():
        exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(r.k + 1))
        assert r.c == pytest.approx(math.log(exact), rel=1e-9, abs=1e-9)


def test_binomial_tail_of_a_large_holdout_does_not_underflow(spark):
    r = spark.sql("SELECT 1000000L AS n, 9000L AS k").select(q.log_binomial_cdf(F.col("n"), F.col("k"), 0.01).alias("c")).first()
    assert -100 < r.c < -40


def good(i):
    return " ".join(f"word{(i * 7 + k) % 997}" for k in range(40))


def test_certified_cutoffs_reject_junk_and_keep_good(spark, frame):
    rows = [(i, good(i), "en" if i % 3 else None, "s") for i in range(3000)] + [(5000 + i, good(i).upper() + " !!" * 9, "en", "s") for i in range(50)]
    rows += [(6000 + i, good(i).upper(), "rare", "s") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(5000 + i, 0, 0) for i in range(50)] + [(None, 1, 0), (7, None, 0), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.report(frame(rows), labels).collect()}
    assert sum(not got[i].kept for i in range(3000)) <= 3000 * q.ALPHA
    assert not any(got[5000 + i].kept for i in range(50))
    assert all(got[6000 + i].kept for i in range(5))  # no cutoff is certified for a stratum without labels
    kept = q.keep_good(frame(rows), labels)
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_no_cutoff_without_enough_labels(spark, frame):
    rows = [(i, good(i), "en", "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    scored = spark.createDataFrame([(i, "en", *[0.0] * 5) for i in range(20)], "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in q.RULES))
    assert [x for r in q.certified_cutoffs(scored, labels).collect() for x in r[1:]] == [None] * 5
    assert all(r.kept for r in q.report(frame(rows), labels).collect())


def test_empty_table_and_native_plan(spark, frame):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.report(frame([(1, "a")]).where("false"), labels).collect() == []
    plan = q.measured(frame([(1, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def tail(n, k, p):
    return 1.0 if k >= n * p else sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def joint_brute(rows):
    """stratum to its cutoffs, from (stratum, good, scores)."""
    out, names = {}, sorted({s for s, *_ in rows})
    for name in names:
        good, bad = ([x for s, g, x in rows if s == name and g == kind] for kind in (True, False))
        found = []
        for family in ("split", "joint"):
            cuts, total = [], 0
            for r in range(5):
                ok = []
                for c in q.GRID:
                    k = sum(x[r] >= c for x in good)
                    if family == "split":
                        fine = tail(len(good), k, q.ALPHA / 5) <= q.DELTA / 2 / (len(names) * 5 * len(q.GRID))
                    else:
                        fine = all(tail(len(good), sum(max(x) >= d for x in good), q.ALPHA) <= q.DELTA / 2 / len(names)
                                   for d in q.GRID if d >= c)
                    ok += [(sum(x[r] >= c for x in bad) - k, c)] * fine
                cuts.append(max(ok)[1] if ok else None)
                total += max(ok)[0] if ok else 0
            found.append((total, cuts))
        out[name] = found[1][1] if found[1][0] > found[0][0] else found[0][1]
    return out


def test_joint_cutoffs_equal_brute_force(spark):
    rnd = random.Random(3)
    quiet = lambda: [0.0, 0.0, rnd.uniform(0, 0.03), 0.0, rnd.choice([0.0] * 60 + [0.3])]
    junk = lambda: [rnd.uniform(0.1, 0.38), 0.0, 0.02, 0.0, 0.0]
    rows = [("aa", True, quiet()) for _ in range(250)] + [("aa", False, junk()) for _ in range(30)]
    rows += [("bb", True, [0.0, 0.0, 0.05, 0.0, 0.0]) for _ in range(1100)] + [("bb", False, [0.0, 0.013, 0.0, 0.0, 0.0]) for _ in range(9)]
    rows += [("cc", True, [0.0] * 5) for _ in range(93)] + [("cc", False, junk()) for _ in range(9)]
    rows += [("dd", True, [0.0] * 5) for _ in range(99)] + [("dd", False, junk()) for _ in range(9)]
    scored = spark.createDataFrame([(i, s, *x) for i, (s, _, x) in enumerate(rows)],
                                   "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in q.RULES))
    labels = spark.createDataFrame([(i, int(g), 0) for i, (_, g, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r[0]: list(r[1:]) for r in q.certified_cutoffs(scored, labels).collect()}
    assert got == joint_brute(rows)
    assert got["aa"][0] is not None and got["bb"][1] == 0.0125 and got["cc"] == [None] * 5 and got["dd"][0] is not None


def test_pipeline_rejects_junk_of_a_rare_language(spark, frame, tmp_path):
    rows = [(i, good(i), "xx", "s") for i in range(120)] + [(500 + i, good(i) + " #*$%" * 20, "xx", "s") for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(500 + i, 0, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.quality(spark, frame(rows), str(tmp_path)).collect()) == list(range(120))


def test_columns_named_like_the_stage_s_own(spark, frame):
    names = ["kept", "stratum", "m", "_row", "base_failed", "cut_symbol_share", "measured", "n_words"]
    docs = frame([(i, " ".join(f"word{j}" for j in range(30)), "en") for i in range(3)], extra=False).selectExpr("*", *[f"'own {n}' AS `{n}`" for n in names])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = q.keep_good(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
