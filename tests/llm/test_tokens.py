import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quarry.llm import packing, tokenfile  # noqa: E402
from quarry.llm.common import shared_path  # noqa: E402
from quarry.llm.tokens import encoder, public_path  # noqa: E402

TEXTS = [
    None, "", "   ", "Hello, world! It's 3 o'clock.\n\n  Tabs\tand  spaces ", "Été déjà vu; ÇA VA? Œuvre", "数字 и кириллица ΟΔΟΣ", "a b\u0085c​d", "naïve café İstanbul",
    "x" * 5000 + " " + "word " * 3000, "<|endoftext|> <|startoftext|>", "\x00\x1c\x1f control", "²³¹¼ 1234567890", "— “quotes” … €5",
]


def library(name, text, end):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return [*(t.encode(text or "", add_special_tokens=False).ids), end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_give_the_librarys_ids(name):
    enc = encoder(public_path(name))
    for _ in range(2):
        for text in TEXTS:
            assert np.frombuffer(enc.encode(text or ""), "<u4").tolist() == library(name, text, 0)[:-1]


def frame(spark, rows, extra=True):
    if extra:
        return spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, offset int, ids string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_token_file_round_trip(spark):
    rows = [(5 * i % 13, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    path = shared_path(spark, "t")
    tokenfile.write_tokens(frame(spark, rows), path, public_path("byte_bpe_50k.json"), 0, partitions=3)
    got = tokenfile.token_digests(spark, path).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start])[:-1].tolist()
    ids = [r.doc_id for r in by_start]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(library("byte_bpe_50k.json", t, 0), "<u4").tobytes())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want


def test_token_file_reads_in_part(spark):
    path = shared_path(spark, "t")
    tokenfile.write_tokens(frame(spark, [(i, f"text {i}") for i in range(50)]), path, public_path("byte_bpe_50k.json"), partitions=2)
    part = tokenfile.read_tokens(spark, path, 10, 12)
    assert sorted(r.doc_id for r in part.collect()) == [10, 11, 12]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in part._jdf.queryExecution().toString()
    meta = tokenfile.read_tokens(spark, path).select("doc_id", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString()


def test_token_file_of_an_empty_table(spark):
    path = shared_path(spark, "t")
    tokenfile.write_tokens(frame(spark, [(1, "x")], False).limit(0), path, public_path("byte_bpe_50k.json"))
    assert tokenfile.token_digests(spark, path).count() == 0


def packed(df):
    bins = {}
    for r in df:
        bins.setdefault(r.sequence_id, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist()
        assert sum(r.length for r in rows) <= packing.CAPACITY
    return len(bins)


def test_packing_pieces_and_sequences(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    got = packing.pack_documents(frame(spark, rows), public_path("word_bpe_49k.json")).collect()
    want = []
    for i, t in rows:
        ids = library("word_bpe_49k.json", t, 1)
        want += [(i is None, i or 0, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert packed(got) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack_documents(frame(spark, rows).limit(0), public_path("word_bpe_49k.json")).count() == 0


def optimum(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_genetic_packing_against_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(25):
        lengths = sorted(rng.integers(1, 60, rng.integers(3, 10)).tolist(), reverse=True)
        bound = packing.lower_bound(np.array(lengths), 100)
        best = optimum(lengths, 100)
        assert bound <= best
        bins = packing.evolve(lengths, 100, [], bound, trial, generations=60)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) == best


def test_crossover_keeps_every_item_once():
    import random

    lengths = [60, 50, 40, 30, 30, 20, 10, 10]
    one, two = [[0, 2], [1, 3, 5], [4, 6, 7]], [[0, 3, 6], [1, 2, 7], [4, 5]]
    for seed in range(20):
        child = packing.crossover(one, two, lengths, 100, 0.5, random.Random(seed))
        assert sorted(i for b in child for i in b) == list(range(8))


def test_islands_and_levels(spark, monkeypatch):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1000, 2100, 600).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length int")
    got = packing.pack(items, 4096, block_items=100).join(items, "item").collect()
    assert sorted(r.item for r in got) == list(range(600))
    fills = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 4096 and len(fills) <= 1.2 * packing.lower_bound(np.array(lengths), 4096)


def test_files_are_not_split_and_special_tokens_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, f"text {i} <|endoftext|> end") for i in range(30)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "4")
    try:
        tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), path, partitions=3)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    before = 0
    for r in sorted(tokenfile.token_digests(spark, str(tmp_path / "t")).collect()):
        ids = plain.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert 50256 in ids and (r.start, r.n_tokens) == (before, len(ids) + 1)
        before += len(ids) + 1


def test_new_pre_tokens_of_bytes_go_to_the_model_alone(monkeypatch):
    from quarry.llm.tokens import SAFE, Encoder

    name = "byte_bpe_50k.json"
    chars = [c for c in map(chr, range(0x2100)) if not SAFE.search(c)]
    texts = ["".join(chars), " ".join(chars), "\n".join(f"{c}{c} a{c}" for c in chars), "won't  stop\r\n\t é1²'s ", "un mot, un mot"]
    want = [library(name, text, 0)[:-1] for text in texts]
    whole = lambda *_: (_ for _ in ()).throw(AssertionError("the library got a text"))
    monkeypatch.setattr(Encoder, "_library", whole)
    monkeypatch.setattr(Encoder, "_words", whole)
    for remembered in (0, 900_000):
        enc = Encoder(public_path(name), remembered, True)
        assert [np.frombuffer(enc.encode(text), "<u4").tolist() for text in texts * 2] == want * 2
        assert bool(enc.known) == (remembered > 0) and not enc.known.missed
