"""Every pipeline stage on rows with nulls, empty and very long texts, ties, repeats and further columns."""

from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import pii
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_quality import brute as measured
from tests.llm.test_tokens import library

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id string, piece int, p string"


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean = " ".join(f"word{i} stands" for i in range(60)) + "."
    texts = [None, "", " \n\t ", clean, clean, clean.upper(), " ".join(f"term{i * i}" for i in range(30_000)), "x" * 100_000, item, f"{clean} {item}", f"{clean} mail ann@example.org", "<|endoftext|> é中\U0001f600 " + clean]
    rows = given + [(10_000 + i, t) for i, t in enumerate(texts)]
    return rows + [(10_003, clean)]  # one row twice


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", 2, "y") for i, t in rows], SCHEMA)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_rules(spark, rows):
    df = STAGES["quality_rules"](spark, frame(spark, rows), SF)
    assert kept(df) == Counter((i, t) for i, t in rows if measured(t)[-1])


def test_near_duplicates(spark, rows):
    df = STAGES["near_duplicates"](spark, frame(spark, rows), SF)
    distinct = list(dict(rows).items())
    first = {c for _, _, n, c in groups(distinct) if n}
    got = kept(df)
    assert {i for i, _ in got if i in first} == first
    assert {i for i, _ in got} - first <= {i for _, i, n, _ in groups(distinct) if not n}
    assert got[10_003, dict(rows)[10_003]] == 1 and not got[10_004, dict(rows)[10_004]]


def test_benchmark_leaks(spark, rows):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = STAGES["benchmark_leaks"](spark, frame(spark, rows), SF)
    bad = {r[0] for r in leaks(list(dict(rows).items()), bench) if r[-1]}
    assert 10_008 in bad
    assert kept(df) == Counter((i, t) for i, t in rows if i not in bad)


def test_personal_data(spark, rows):
    df = STAGES["personal_data"](spark, frame(spark, rows), SF)
    got, before = kept(df), dict(rows)
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in rows)
    after = dict(got.keys())
    assert after[10_000] is None and after[10_001] == "" and after[10_003] == before[10_003]
    assert "ann@example.org" not in after[10_010] and after[10_010].startswith(before[10_003])
    assert pii.clean(df).schema == df.schema


def test_sequences(spark, rows):
    got = STAGES["sequences"](spark, frame(spark, rows), SF).collect()
    lengths, used = Counter(), {}
    for r in got:
        lengths[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter()
    for i, t in rows:
        want[i] += len(library("word_bpe_49k.json", t, 1))
    assert lengths == want
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    assert STAGES[name](spark, frame(spark, []), SF).count() == 0
