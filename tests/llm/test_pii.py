import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm import pii


def stream(part, other, i, tweak):
    h = hashlib.sha512(f"{pii.KEY}|{tweak}|{i}|{len(part)}|{other}".encode()).hexdigest()
    out = []
    for j, c in enumerate(part):
        k = int(h[(j % 32) * 4 : (j % 32) * 4 + 4], 16)
        for low, size in (("0", 10), ("a", 26), ("A", 26)):
            if ord(low) <= ord(c) < ord(low) + size:
                c = chr((ord(c) - ord(low) + k) % size + ord(low))
                break
        out.append(c)
    return "".join(out)


def feistel(s, tweak):
    cut = -(-len(s) // 2)
    left, right = s[:cut], s[cut:]
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = stream(left, right, i, tweak)
        else:
            right = stream(right, left, i, tweak)
    return left + right


def luhn(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str((10 - total % 10) % 10)


def one(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    return {r.doc_id: (r.text, r["_found"]) for r in pii.pseudonymise(df).collect()}


def test_feistel_against_brute_force(spark):
    values = ["", "1", "12", "123456789", "aB3-x_9Z", "a" * 90, "0" * 33, "é12"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.f for r in df.select(pii.feistel(F.col("v"), "t").alias("f")).collect()] == [feistel(v, "t") for v in values]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v")).select(pii.feistel(F.col("v"), "t").alias("f"))
    assert df.distinct().count() == 1000


def test_cards_phones_emails_secrets(spark):
    rng = random.Random(1)
    cards = [b + luhn(b) for b in ("".join(rng.choice("0123456789") for _ in range(n)) for n in (12, 14, 15, 15, 18))]
    bad = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards]
    got = one(spark, [f"a {c} b" for c in cards + bad])
    for i, c in enumerate(cards):
        new = feistel(c[:-1], "card")
        assert got[i] == (f"a {new + luhn(new)} b", ["card"])
    for i, c in enumerate(bad, len(cards)):
        assert got[i][0] == f"a {c} b"
    spaced = " ".join(cards[2][k : k + 4] for k in range(0, 16, 4))
    mail, phone, secret = "jo.e+x@mail.example.com", "+1 (415) 555-2671", "9f86d081884c7d659a2feaa0c55ad015"
    got = one(spark, [spaced + " and " + cards[2], mail, phone, f'token = "{secret}"', "a-very-long-hyphenated-word-without-numbers", f"{mail}, {phone}; {secret}."])
    a, b = got[0][0].split(" and ")
    assert a.replace(" ", "") == b and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a)
    assert got[1][0] == feistel("jo.e+x@mail.example", "email") + ".com"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[2][0]) and got[2][0] != phone
    assert got[3][0] == f'token = "{feistel(secret, "secret")}"'
    assert got[4] == ("a-very-long-hyphenated-word-without-numbers", [])
    assert got[5][0] == f"{got[1][0]}, {got[2][0]}; {feistel(secret, 'secret')}." and got[5][1] == ["email", "phone", "secret"]


def test_dates_numbers_and_addresses(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(0, 73049, 997)]
    got = one(spark, [f"{d:%Y-%m-%d} {d:%d/%m/%Y} {d:%d.%m.%Y}" for d in days])
    seen = set()
    for i in got:
        a, b, c = got[i][0].split()
        new = datetime.date.fromisoformat(a)
        assert 1900 <= new.year <= 2099 and (f"{new:%d/%m/%Y}", f"{new:%d.%m.%Y}") == (b, c)
        seen.add(new)
    assert len(seen) == len(days)
    got = one(spark, ["123-45-6789", "000-45-6789", "666-45-6789", "10.20.30.40", "10.20.30.400", "1.2.3.4.5", "2023-02-30", "1850-01-01", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "3.14 and 2024", "version 1.2.3"])
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", got[0][0]) and got[0][0] != "123-45-6789"
    assert all(0 <= int(x) < 256 for x in got[3][0].split(".")) and got[3][1] == ["ip"]
    iban = got[8][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[8][0].startswith("DE") and len(got[8][0]) == 27
    for i, t in ((1, "000-45-6789"), (2, "666-45-6789"), (4, "10.20.30.400"), (5, "1.2.3.4.5"), (6, "2023-02-30"), (7, "1850-01-01"), (9, "DE88 3704 0044 0532 0130 00"), (10, "3.14 and 2024"), (11, "version 1.2.3")):
        assert got[i] == (t, [])


def test_equal_values_stay_linked_and_edges(spark):
    long = "word " * 20000 + "192.168.1.77" + " word" * 20000
    got = one(spark, ["at 192.168.1.77!", long, None, "", "192.168.1.77 192.168.1.77"])
    ip = got[0][0][3:-1]
    assert ip != "192.168.1.77" and got[1][0] == long.replace("192.168.1.77", ip) and got[4][0] == f"{ip} {ip}"
    assert got[2] == (None, []) and got[3] == ("", [])
    df = spark.createDataFrame([(1, "x 192.168.1.77", "q", 14)] * 2, "doc_id long, text string, lang string, n_chars long")
    rows = pii.clean(df).collect()
    assert rows[0] == rows[1] and rows[0].n_chars == len(rows[0].text) and list(rows[0].asDict()) == df.columns
    assert pii.clean(df.limit(0)).count() == 0


def test_no_value_of_the_table_is_left(spark):
    rows = pii.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        before = re.findall(r"[\w.]+@[\w.]+|\+\d \(\d+\) \d+-\d+", texts[r.doc_id])
        assert not [v for v in before if v in r.text]
        if not any(r[f"n_{k}"] for k in pii.KINDS):
            assert r.text == texts[r.doc_id]


def test_long_secrets_are_replaced_whole(spark):
    long, late = "a1B2" * 200, "x" * 150 + "1234" + "y" * 12
    got = one(spark, [f"key {long} end", f"key {late} end", "z" * 3000, "w7" * 20000])
    assert got[0][0] == f"key {feistel(long, 'secret')} end" and got[1][0] == f"key {feistel(late, 'secret')} end"
    assert got[2] == ("z" * 3000, []) and got[3][0] == feistel("w7" * 20000, "secret")
    assert [got[i][1] for i in range(4)] == [["secret"], ["secret"], [], ["secret"]]


def test_dates_month_first_stay_so_and_are_permuted_one_to_one(spark):
    days = [f"{m:02d}/{d:02d}/1985" for m in range(1, 13) for d in range(13, 29)]
    rows = spark.createDataFrame([(i, f"born {x} here") for i, x in enumerate(days)], "doc_id long, text string")
    out = [r.text.split()[1] for r in pii.pseudonymise(rows).collect()]
    assert len(set(out)) == len(days) and not set(out) & set(days[:3])
    assert all(int(x[:2]) <= 12 < int(x[3:5]) for x in out)


def test_addresses_are_linked_in_any_case_and_keys_differ(spark):
    rows = spark.createDataFrame([(1, "Ann@X.org"), (2, "ann@x.org"), (3, "bob@x.org")], "doc_id long, text string")
    one, two = ({r.doc_id: r.text for r in pii.pseudonymise(rows, k).collect()} for k in ("a", "b"))
    assert one[1].lower() == one[2] != one[3] and one[1] != one[2] and one[2] != two[2]
    spark.conf.set(pii.KEY_SETTING, "b")
    try:
        assert {r.doc_id: r.text for r in pii.pseudonymise(rows).collect()} == two
    finally:
        spark.conf.unset(pii.KEY_SETTING)
