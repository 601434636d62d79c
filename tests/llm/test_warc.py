import hashlib

from quarry.llm import warc
from quarry.llm.common import shared_path
from tests.helpers import check

FALSE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nnot a record"


def test_oracle(spark):
    assert check(spark, warc.query, warc.ORACLE_SQL) == 50


def pages():
    long = "é" * 700
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/4 x\r\ny", long), (5, "u", long), (9, "u", long), (9, "u", long), (None, "u", long), (6, "u", "a" * 999), (7, "u", "a" * 999)]
    rows += [(10, "u", "start " + FALSE), (11, "u", FALSE + "\r\n\r\n"), (12, "u", "WARC/1.0\r\n" * 50), (13, "u", ("x" * 300 + FALSE) * 10), (14, "u", ("x" * 300 + FALSE) * 10)]
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int")
    path = shared_path(spark, "w")
    warc.write_warc(df.repartition(3), path)
    return warc.read_warc(spark, path).collect()


def expected(rows):
    out = []
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    for i, _, h in rows:
        again = h in top and i != top[h]
        out.append((i, "revisit" if again else "response", top[h] if again else None, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()))
    return out


def shape(r):
    again = r.type == "revisit"
    return (r.page_id, r.type, r.refers_to, r.full_bytes if again else r.payload_bytes, r.named if again else r.actual)


def test_magic_inside_payloads_is_rejected(spark):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(shape, result(spark, pages())), key=key) == sorted(expected(pages()), key=key)


def test_magic_and_records_across_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = [(i, f"http://h/{i}", ("text %d " % i) * (i % 40) + (FALSE if i % 3 == 0 else "")) for i in range(120)]
        got = sorted(map(shape, result(spark, rows)))
        assert got == sorted(expected(rows), key=lambda x: x[0])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared_path(spark, "w")
    warc.write_warc(df, path)
    assert warc.read_warc(spark, path).count() == 0


def test_shuffled_decisions_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(shape, result(spark, pages())), key=key) == sorted(expected(pages()), key=key)
