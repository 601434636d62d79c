import re

from quarry.llm import quality
from tests.helpers import check

TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x y z", ("w " * 60).strip(), "same line\nsame line\n\n\nother | # %", "\n".join(f"line {i} of text with words" for i in range(20)) + "\n" + " ".join(f"u{i}" for i in range(100)), "é\x0bü ñ 日本 語", " ".join(f"w{i % 997}" for i in range(20000))]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    n, chars, sym, dup, rep = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    base = n < 50 or 100 * rep > 50 * n
    return n, chars, sym, dup, rep, base, not (base or 100 * sym > 20 * n or 100 * dup > 40 * len(lines))


def test_oracle(spark):
    assert check(spark, quality.query, quality.ORACLE_SQL) == 200


def test_measures_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(None, "one", 1, ""), (3, "one", 5, "x")], "doc_id long, text string, n_words int, failed string")
    rows = quality.ledger(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "one" if r.doc_id is None else TEXTS[r.doc_id]
        base, kept = r.failed & quality.mask(quality.BASE) != 0, r.failed & quality.mask(quality.POLICIES["v1"]) == 0
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, base, kept) == brute(text)


def test_keep_returns_the_rows_as_they_were(spark):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, failed string")
    got = quality.keep(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, t in enumerate(TEXTS) if brute(t)[-1]]
    assert quality.keep(df.limit(0)).count() == 0


def test_ablations(spark):
    bits = [0, 1, 1, 3, 4, 5, 8, 16]
    got = {r.rule: (r.fails, r.alone, r.rejected_without) for r in quality.ablations(spark.createDataFrame([(b,) for b in bits], "failed long"), "v1").collect()}
    m = quality.mask(quality.POLICIES["v1"])
    for rule in quality.POLICIES["v1"]:
        b = quality.mask([rule])
        assert got[rule] == (sum(x & b != 0 for x in bits), sum(x & m == b for x in bits), sum(x & m & ~b != 0 for x in bits))
