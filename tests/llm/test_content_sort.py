import hashlib
import random
import re

from hostshelf.llm import content_sort


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b\tc"), (2, "abc"), (3, " a b c "), (3, " a b c "), (4, None), (5, ""), (6, " \n"), (7, "é漢" * 30000),
        (8, "é 漢" + "é漢" * 29999), (None, "abc"), (9, "a bc"), (10, "x\0y"), (11, "x\0 y"), (12, "x"), (13, "x\0")]


def result(df):
    return sorted([tuple(r) for r in content_sort.report(df).collect()], key=repr)


def test_groups_equal_brute_force_with_nulls_ties_and_clashing_columns(frame):
    assert result(frame(ROWS)) == brute(ROWS)


def test_a_group_over_many_ranges_is_joined_again(spark, frame):
    random.seed(3)
    rows = [(i, random.choice(["hot text", "hot  text ", f"own {i % 40}"])) for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(frame(rows).repartition(7)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keep_first_returns_whole_rows_once(frame):
    kept = content_sort.keep_first(frame(ROWS))
    assert kept.columns == frame(ROWS).columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(r[0] for r in brute(ROWS) if r[3])


def test_empty_table(frame):
    assert result(frame([(1, "a")]).where("false")) == []
    assert content_sort.keep_first(frame([(1, "a")]).where("false")).collect() == []
