import re

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_quality import brute as measured

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            want = {i: t for i, t in before.items() if measured(t)[-1]}
        elif name == "near_duplicates":
            keep = {c for _, _, n, c in groups(list(before.items())) if n}
            want = {i: t for i, t in before.items() if i in keep}
        elif name == "benchmark_leaks":
            want = {r[0]: before[r[0]] for r in leaks(list(before.items()), bench) if not r[-1]}
        else:
            want = after
            assert set(after) == set(before)
            assert not [v for i, t in before.items() for v in re.findall(r"[\w.]+@[\w.]+", t) if v in after[i]]
        assert after == want, name
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(before)


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_leaks", "personal_data", "sequences"]
    assert corpus_pipeline.run(spark, SF).count() > 0
