"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline
from tarnflow.llm import secrets
from tarnflow.llm.decontaminate import find_contamination
from tarnflow.llm.near_dup_simhash import simhash_components
from tarnflow.session import materialize

DIR = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], DIR), name.replace(" ", "_")))
    for a, b in zip(seen, seen[1:-1], strict=False):
        assert b.columns == docs.columns and b.schema == a.schema
        assert {r.doc_id for r in b.select("doc_id").collect()} <= {r.doc_id for r in a.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * len(labels)
    assert simhash_components(seen[2]).filter("doc_id <> component_id").count() == 0
    assert find_contamination(seen[3], bench).count() == 0
    words = secrets.encoding(open(secrets.VOCABULARY, "rb").read())
    assert all(not secrets.secret_spans(r.text or "", words) for r in seen[4].collect())
    final = seen[5].collect()
    assert final and all(r.copies > 0 and r.taken <= 3 * len((r.text or "").split()) for r in final)
    assert {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, DIR).collect()} == {(r.doc_id, r.copies) for r in final}
