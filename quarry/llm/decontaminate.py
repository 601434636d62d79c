"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows of 13 consecutive words (all its words if fewer). A window is
contained in a document exactly where all its shingles (5 words, or the window if shorter) stand in
their places. One pass over the documents finds where any item shingle stands; that gives each
shingle's rarity over all documents. A containment needs every shingle, so the necessary prefix of a
window, its shingles ordered by rarity, is the rarest one: only its places are candidates. The place
within the window gives the start, which must leave room for the window in the document's length.
What is left is verified word by word on the candidate documents alone.

Everything is SQL functions and joins. Documents are never shuffled whole, only those with a
candidate. The item side is broadcast up to a checked number of rows, and shuffled beyond it.

Defined results: null or empty text has no words, no hits and is not contaminated; a null or empty
item has no windows; repeated document rows give a row each; a null doc_id is a value like others;
repeated items count by distinct item_id; an empty table on either side gives no hits; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table

WINDOW = 13
SHINGLE = 5
# Fixed value: the word class after A-Z are lower-cased.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The smaller side of a join is broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 400_000
SALTS = 16


# Fixed value: code points other than those (of Latin-1 and some punctuation) on which lower() changes A-Z alone.
CAPITALS = r"[^\x00-\xBF\xD7\xDF-\xFF\u2010-\u2027\u20AC]"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased: by lower() where it does just that, which is several times faster than translate()."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    small_letters = F.when(t.rlike(CAPITALS), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.regexp_extract_all(small_letters, F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """Two 64-bit hashes: with the doc_id they name a row's text, so repeated rows share their results."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("b"))


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is small; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(window, item_id, w): a window's words with the items it is of; `window` numbers distinct word lists."""
    df = benchmark.select("item_id", words(F.col("text")).alias("t")).where(F.size("t") > 0)
    df = df.withColumn("n", F.least(F.size("t"), F.lit(WINDOW)))
    df = df.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1)))
    df = df.select("item_id", F.slice("t", F.col("at"), F.col("n")).alias("w")).distinct()
    return df.withColumn("window", F.sha1(F.array_join("w", " ")))


def _shingles(w: str, width: int) -> Column:
    """Hashes of all runs of `width` words of the array column w, in order; none if it is shorter."""
    at = lambda i: F.get(F.col(w), i)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(F.lit(width), *[at(i + k) if k else at(i) for k in range(width)]))
    return F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, n, width, place, sh): every shingle of every distinct window."""
    df = windows.select("window", "w").dropDuplicates(["window"]).withColumn("n", F.size("w"))
    parts = [df.where(F.least("n", F.lit(SHINGLE)) == k).select("window", "n", F.lit(k).alias("width"), F.posexplode(_shingles("w", k)).alias("place", "sh")) for k in range(1, SHINGLE + 1)]
    return reduce(DataFrame.unionByName, parts)


_SENTINEL = 0x5EED


def places(docs: DataFrame, item_shingles: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, sh, pos): where item shingles stand, and a row with pos -1 for every document row.

    The one pass over whole texts. The row with pos -1 comes from a number put before each document's shingles.
    """
    widths = sorted(r.width for r in item_shingles.select("width").distinct().collect())  # at most SHINGLE values
    wanted = item_shingles.select("sh").distinct().unionByName(docs.sparkSession.createDataFrame([(_SENTINEL,)], "sh long"))
    df = docs.select("doc_id", text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    parts = []
    for k in widths or [SHINGLE]:
        head = F.array(F.lit(_SENTINEL).cast("long")) if k == (widths or [SHINGLE])[0] else F.array(F.lit(0).cast("long"))
        parts.append(df.select("doc_id", "key", "n_words", F.posexplode(F.concat(head, _shingles("w", k))).alias("pos", "sh")))
    return reduce(DataFrame.unionByName, parts).join(small(wanted), "sh").select("doc_id", "key", "n_words", "sh", (F.col("pos") - 1).alias("pos"))


def prefixes(item_shingles: DataFrame, found: DataFrame) -> DataFrame:
    """(window, n, place, sh): the rarest shingle of each window whose shingles all stand in some document."""
    rarity = found.where("pos >= 0").groupBy("sh").agg(F.count("*").alias("df"))
    ranked = item_shingles.join(rarity, "sh", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("sh"), F.col("place"))).alias("least"))
    return ranked.where("least.df > 0").select("window", "n", F.col("least.place").alias("place"), F.col("least.sh").alias("sh"))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document row: doc_id, key, n_words), (per distinct document with hits: doc_id, key, n_hit, items)."""
    windows = materialize(item_windows(benchmark), "windows")
    shingles = materialize(window_shingles(windows), "window-shingles")
    found = materialize(places(docs, shingles), "places")
    rows = found.where("pos < 0").select("doc_id", "key", "n_words")

    prefix = materialize(prefixes(shingles, found), "prefixes")
    stand = found.where("pos >= 0").distinct()
    if prefix.count() <= BROADCAST_ROWS:
        met = stand.join(F.broadcast(prefix), "sh")
    else:  # a shingle may stand in a third of all documents: deal it by a salt too
        dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = stand.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int")).join(dealt, ["sh", "salt"])
    start = F.col("pos") - F.col("place")
    met = met.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc_id", "key", start.alias("start"), "window")
    met = materialize(met, "window-candidates")

    # verify on the texts of the documents that have a candidate
    keys = small(materialize(met.select(F.col("key").alias("k"), F.col("doc_id").alias("d")).distinct(), "candidate-documents"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select("doc_id", text_key(text).alias("key"), text.alias("t")).join(keys, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").dropDuplicates(["doc_id", "key"])
    distinct_words = windows.select("window", "w").dropDuplicates(["window"])
    met = met.join(small(distinct_words), "window")
    listed = met.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "window", "w")).alias("c"))
    both = chosen.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), words(F.col("t")).alias("t")).join(listed, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    both = both.withColumn("c", F.filter("c", lambda c: F.slice(F.col("t"), c["start"] + 1, F.size(c["w"])) == c["w"])).where(F.size("c") > 0)
    hit = F.size(F.array_distinct(F.flatten(F.transform("c", lambda c: F.sequence(c["start"], c["start"] + F.size(c["w"]) - 1)))))
    true = materialize(both.select("doc_id", "key", hit.cast("long").alias("n_hit"), F.array_distinct(F.transform("c", lambda c: c["window"])).alias("windows")), "contained")
    of = true.select("doc_id", "key", "n_hit", F.explode("windows").alias("window")).join(small(windows.select("window", "item_id")), "window")
    items = of.groupBy("doc_id", "key", "n_hit").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return rows, items


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: doc_id, key, n_words, n_hit, items (sorted as strings), contaminated."""
    rows, items = occurrences(docs, benchmark)
    items = items.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_hit", "items")
    joined = rows.join(items, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n_words").cast("long")
    return joined.select(
        "doc_id", "key", n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    bad = small(materialize(bad, "contaminated"))
    key = text_key(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, (key == F.col("_k")) & docs["doc_id"].eqNullSafe(F.col("_d")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ip AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, n, w[s:s+n-1] AS x FROM ip
), lens AS (SELECT DISTINCT n FROM win
), dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n
), hit AS (SELECT dp.doc_id, dp.s, dp.n, win.item_id FROM dp JOIN win ON dp.n = win.n AND dp.w[dp.s:dp.s+dp.n-1] = win.x
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
