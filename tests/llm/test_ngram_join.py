import re

import numpy as np
import pytest

from quarry.llm import ngram_join
from quarry.llm.common import word_hashes

SCHEMA = "doc_id long, text string, node string, n int"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d is None, d or 0, len(s), (least.get(find(i)) if s else d) or 0) for i, ((d, _), s) in enumerate(zip(rows, sets))))


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "W%d" % rng.integers(0, 4000)
    rows, n = [], 0
    passage = [word() for _ in range(30)]
    for size in (1, 1, 2, 3, 5, 20, 60):
        base = [word() for _ in range(rng.integers(20, 120))] + (passage if size > 2 else [])
        for _ in range(size):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, " ".join([word() for _ in range(60)] + passage)) for i in range(40)]
    n += 40
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "few words"), (n + 4, "FEW  words\n"), (n + 5, "few words more"), (None, "few words"), (n + 6, "é ü ñ é ü ñ é"), (n + 7, rows[3][1]), (3, rows[3][1]), (3, "other text with the same id here")]
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    return df, sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(df).collect())


def test_against_brute_force(spark):
    rows = corpus()
    assert result(spark, rows)[1] == brute(rows)


@pytest.mark.parametrize(("group", "held", "shingles", "sets"), [(2, 300, 2_000_000, 20_000), (16, 300, 500, 20_000), (1, 500_000, 500, 20_000), (4, 500_000, 2_000_000, 4)])
def test_crowds_small_tasks_and_large_blocks(spark, monkeypatch, group, held, shingles, sets):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    rows = corpus(sets)
    assert result(spark, rows)[1] == brute(rows)


def test_sizes_of_one_band_can_link():
    n = np.arange(1, 100_000)
    bands = ngram_join.band(n)
    for k in np.unique(bands):
        own = n[bands == k]
        assert 4 * own.min() >= 3 * own.max()


def test_one_of_every_component_stays(spark):
    rows = corpus(5)
    df, _ = result(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {c for _, _, n, c in brute(rows) if n}
    assert len(got) == len(groups) + sum(not shingles(t) for _, t in rows)
    assert {d for d, t in got if shingles(t)} == groups


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicates(df).count() == 0 and ngram_join.keep_one(df).count() == 0


def test_trie_finds_every_link():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pool = np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
        sets = {i: np.sort(rng.choice(pool, rng.integers(1, 40), replace=False)) for i in range(25)}
        trie = ngram_join.Trie(list(sets.values()))
        for i, s in enumerate(trie.sets):
            want = {j for j, t in enumerate(trie.sets) if len(np.intersect1d(s, t)) >= ngram_join.need(len(s), len(t))}
            assert set(trie.matches(s, np.ones(25, np.int64))) == want


def test_word_hashes_are_of_words():
    words = ["a", "b", "ab", "ba", "AB", "aé", "x" * 3000, "日本"]
    h = [int(word_hashes(w.encode())[0]) for w in words]
    assert len(set(h)) == len(words) - 1 and h[2] == h[4]
    text = " \t".join(words) + "\x0b\n"
    assert word_hashes(("  " + text).encode()).tolist() == h
    assert word_hashes(b"") .size == 0 and word_hashes(b" \n").size == 0


def test_oracle(spark):
    from tests.helpers import check

    assert check(spark, ngram_join.query, ngram_join.ORACLE_SQL) == 200


def test_drift_chain_of_500_texts_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    ids = np.random.default_rng(9).permutation(500)
    rows = [(int(d), " ".join(f"v{6 * i + k}" for k in range(54))) for i, d in enumerate(ids)]
    want = brute(rows)
    assert {w[3] for w in want} == {0}
    assert result(spark, rows)[1] == want
