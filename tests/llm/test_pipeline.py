"""The pipeline against a brute-force version of its stages, and the registered queries."""
import re

import pytest

import __spark_entry__
import corpus_pipeline
from hostshelf.llm import catalog, quality_risk
from llm.test_simhash_cover import brute as link_brute
from llm.test_simhash_cover import slow_fingerprint
from llm.test_substrings import words_of

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_and_order(stages):
    assert [n for n, *_ in stages] == ["quality rules", "exact dedup", "near dedup", "substring dedup", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    _, docs, out = stages[0]
    verdict = as_rows(quality_risk.report(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(as_rows(out)) == {i for i, r in verdict.items() if r.kept}


def test_exact_stage(stages):
    _, docs, out = stages[1]
    best = {}
    for r in docs.collect():
        body = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        key = (-len(r.text or ""), r.doc_id)
        best[body] = min(best.get(body, key), key)
    assert set(as_rows(out)) == {k[1] for k in best.values()}


def test_near_stage(stages):
    _, docs, out = stages[2]
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    label = link_brute(fps.values(), 4)
    first = {}
    for i, f in fps.items():
        first[label[f]] = min(first.get(label[f], i), i)
    assert set(as_rows(out)) == set(first.values())


def test_substring_stage(stages):
    _, docs, out = stages[3]
    rows, seen, w = docs.collect(), {}, 35
    for r in rows:
        x = words_of(r.text)
        for j in range(len(x) - w + 1):
            seen[tuple(x[j:j + w])] = seen.get(tuple(x[j:j + w]), 0) + 1
    got = as_rows(out)
    for r in rows:
        x = words_of(r.text)
        gone = {k for j in range(len(x) - w + 1) if seen[tuple(x[j:j + w])] > 1 for k in range(j, j + w)}
        if not gone:
            assert got[r.doc_id] == r
        elif len(gone) == len(x):
            assert r.doc_id not in got
        else:
            assert words_of(got[r.doc_id].text) == [x[j] for j in range(len(x)) if j not in gone]
            assert got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_packing_stage_and_run(spark, stages):
    _, docs, out = stages[4]
    from llm.test_window_packing import check
    check([(r.doc_id, r.text) for r in docs.collect()], out.collect())
    again = corpus_pipeline.run(spark, SF)
    cover = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert cover(again) == cover(out) and corpus_pipeline.ORACLE_SQL is None


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names and set(catalog.oracle_sql()) <= set(catalog.queries())
