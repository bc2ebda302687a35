"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import os

import pytest
from compare import compare, duck

import corpus_pipeline
from gaugeworks.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    source = "embeddings" if "neighbours" in name else "documents"
    rows = spark.read.parquet(f"{SF}/{source}.parquet").count()
    found = QUERIES[name](spark, SF)
    if "neighbours" in name:
        assert found.count() == 20 * -(-rows // 20)
    else:
        assert found.select("doc_id").distinct().count() == rows


def test_pipeline(spark):
    """Each stage on what its predecessor kept, as brute force has it."""
    import numpy as np
    from cases import lines, near, repeats

    from gaugeworks.llm import toxicity
    from gaugeworks.session import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SF), "test-stage")
        if name != names[-1]:
            assert after.columns == docs.columns
        kept[name] = (before, after)
        before = after
    scored = toxicity.op8_toxicity(spark, SF).where("predicted = 0")
    assert {r.doc_id for r in scored.collect()} == {r.doc_id for r in kept["toxicity"][1].collect()}

    def rows(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    a, b = map(rows, kept["line dedup"])
    want = [(i, t) for (i, _), (t, n, gone) in zip(a, lines([t for _, t in a])) if not (gone and not (t or "").strip())]
    assert b == want
    a, b = map(rows, kept["n-gram Jaccard join"])
    assert b == [x for k, (x, (_, c)) in enumerate(zip(a, near([t for _, t in a]))) if c == k]
    a, b = map(rows, kept["suffix-array dedup"])
    want = [(i, t if not gone else left.decode("utf-8", "ignore")) for (i, t), (size, gone, _, left) in zip(a, repeats([t for _, t in a])) if not gone or gone < size]
    assert b == want
    packed = kept["best-fit packing"][1].collect()
    assert {r.doc_id for r in packed} == {i for i, _ in b}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
