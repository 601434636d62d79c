import re

from quarry.llm import decontaminate
from tests.helpers import check

SCHEMA = "doc_id long, text string, key string, n_words int"


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(13, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def item(k, n):
    return " ".join(f"it{k}w{j}" for j in range(n))


ITEMS = [(1, item(1, 30)), (2, item(2, 13)), (10, item(2, 13)), (3, "Just three words"), (4, "solo"), (5, ""), (6, None), (7, "É " + item(1, 30)), (8, "one two three four five six"), (8, "one two three four five six")]
DOCS = [
    (0, None), (1, ""), (2, item(1, 30)), (3, "pad " * 100 + item(1, 14) + " pad" * 100), (4, item(1, 12)), (5, "x JUST-three, words y"), (6, "just three"), (7, "a solo b solo"), (8, item(2, 13).upper() + " é " + item(1, 30)),
    (9, "É " + item(1, 30)), (10, "one two three four five six seven one two three four five six"), (11, " ".join(f"z{i}" for i in range(3000)) + " " + item(2, 13)), (2, item(1, 30)), (2, "other text"), (None, item(2, 13)), (12, item(1, 30).replace("it1w20", "no")),
]


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "k", 3) for r in docs], SCHEMA)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, window int")
    return [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontaminate.contamination(d, b).collect()], d, b



def test_oracle(spark):
    assert check(spark, decontaminate.query, decontaminate.ORACLE_SQL) == 200


def test_against_brute_force(spark):
    got, d, b = run(spark, DOCS, ITEMS)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(DOCS, ITEMS), key=key)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    want = [(i, t) for (i, t), r in zip(DOCS, brute(DOCS, ITEMS)) if not r[-1]]
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect())) == sorted((i, t or "") for i, t in want)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(run(spark, DOCS, ITEMS)[0], key=key) == sorted(brute(DOCS, ITEMS), key=key)


def test_empty_tables(spark):
    assert run(spark, DOCS[:3], [])[0] and all(r[2] == 0 for r in run(spark, DOCS[:3], [])[0])
    assert run(spark, [], ITEMS)[0] == []
