import collections

import corpus_pipeline
from folioscope.llm import mixing, near_dedup, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf).cache()
        assert out.columns == docs.columns and out.count() > 0, name
        if name != "mixing":
            assert not ids(out) - ids(seen[-1])
        seen.append(out)
    clean, good, single, mixed = seen[1:]
    assert ids(good) == ids(quality.judge(clean).filter("kept"))
    assert ids(single) == ids(near_dedup.groups(good).filter("kept"))
    want = {r.doc_id: r.copies for r in mixing.mix(single).filter("copies > 0").collect()}
    assert ids(mixed) == want
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, sf)
    assert ids(last) == want
    assert collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
