import math
import random
import re
from collections import Counter

import pytest

from quarry.llm import lm
from tests.helpers import check


def brute(rows):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    uni = Counter(w for d in docs for w in d)
    total = sum(uni.values())
    pairs = [Counter(zip(d, d[1:])) for d in docs]
    heads = [Counter(d[:-1]) for d in docs]
    big, ctx = sum(pairs, Counter()), sum(heads, Counter())
    out = []
    for (i, _), d, p, h in zip(rows, docs, pairs, heads):
        s = seen = 0
        for k, w in enumerate(d):
            if k and big[d[k - 1], w] > p[d[k - 1], w]:
                seen += 1
                s += math.log10((big[d[k - 1], w] - p[d[k - 1], w]) / (ctx[d[k - 1]] - h[d[k - 1]]))
            else:
                s += math.log10(uni[w] / total) + (math.log10(0.4) if k else 0)
        out.append((i, len(d), seen, round(s / len(d), 5) if d else None))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, bucket string, score double").repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_seen, None if r.score is None else round(r.score, 5)) for r in lm.scores(df).collect()), key=repr)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3] == w[3] or g[3] == pytest.approx(w[3], abs=2e-5)


ROWS = [(1, "the cat sat on the mat"), (2, "The dog sat on the log the cat"), (3, None), (4, ""), (5, "word"), (6, "the"), (None, "on the mat on the mat"), (1, "the cat sat on the mat"), (7, "é ü é ü " * 500), (8, "zzz yyy zzz")]


def test_oracle(spark):
    assert check(spark, lm.query, lm.ORACLE_SQL) == 200


def test_against_brute_force(spark):
    same(result(spark, ROWS), brute(ROWS))


@pytest.mark.parametrize("frequent, paired", [(1, 1), (20, 5), (10_000, 20), (10_000, 10_000)])
def test_frequent_words_and_bigrams(spark, monkeypatch, frequent, paired):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "PAIRED", min(frequent, paired))
    same(result(spark, ROWS), brute(ROWS))


def test_slices_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 20)
    monkeypatch.setattr(lm, "SLICES", 3)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    one, three = (sorted(map(tuple, lm.scores(df, n).collect()), key=repr) for n in (1, 3))
    assert one == three and [r[:3] for r in one] == [r[:3] for r in brute(ROWS)]


def test_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    same(result(spark, rows + rows[:7]), brute(rows + rows[:7]))


def test_empty_table(spark):
    assert result(spark, ROWS[2:4]) == brute(ROWS[2:4])
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_counts_are_joined_where_the_rows_are(spark, monkeypatch):
    plans, write = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    df = spark.createDataFrame([(i, f"a b c{i} a b d{i % 3}") for i in range(9)], "doc_id long, text string")
    assert lm.scores(df).count() == 9
    terms = [plan for name, plan in plans if name == "terms"]
    assert len(terms) == lm.SLICES
    for plan in terms:
        assert sum("Window [" in x for x in plan.splitlines()) == 1 and sum("RepartitionByExpression" in x for x in plan.splitlines()) == 1
