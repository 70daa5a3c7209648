"""The pipeline against a plain version of its first three stages, and invariants of the rest."""

from collections import defaultdict

import corpus_pipeline as C
import test_dartminhash as near
import test_pii as private
import test_quality as rules
import test_wumanber as bench
from llm_helpers import SF001
from rxlake.llm import quality


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept, stages = docs, {}
    for name, stage in C.STAGES:
        before = kept
        kept = stage(spark, before, SF001)
        if name != "packing":
            assert kept.columns == docs.columns
            kept = kept.cache()
        stages[name] = kept.collect()

    text = {r.doc_id: r.text for r in docs.collect()}
    passed = {r.doc_id for r in stages["quality_rules"]}
    assert passed <= {i for i, t in text.items() if not rules.brute(t)[-1]}
    report = quality.report(docs, spark.read.parquet(f"{SF001}/labels.parquet")).where("kept").collect()
    assert passed == {r.doc_id for r in report}

    first = {c for _, c in near.brute([(i, text[i]) for i in sorted(passed)])}
    assert {r.doc_id for r in stages["near_dedup"]} == first

    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    ids = sorted(first)
    dirty = {i for i, r in zip(ids, bench.brute([(i, text[i]) for i in ids], items)) if r[-1]}
    assert {r.doc_id for r in stages["decontamination"]} == first - dirty and dirty

    clean = {r.doc_id: r.text for r in stages["personal_data"]}
    assert set(clean) == first - dirty
    assert not any(private.base(t) for t in clean.values())
    assert all(clean[i] == text[i] for i in clean if not private.base(text[i]))

    pieces = defaultdict(int)
    for r in stages["packing"]:
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in pieces} == set(clean) and all(n == v for (_, n), v in pieces.items())
    assert sorted(map(tuple, stages["packing"])) == sorted(map(tuple, C.run(spark, SF001).collect()))
