"""Stupid-backoff scores of all documents under the corpus's own bigrams, computed relationally.

S(w | h) is c(h w) / c(h .) over the other documents if any of them has h w, else 0.4 * c(w) / N; a
document's first word scores c(w) / N. c(h .) counts h where a word follows; c(w) and N count all
words of the corpus. A document's score is the mean of log10 S over its words.

1. The unigram table (word, n, follows) counts all words. Words with at least 1/`FREQUENT` of all
   occurrences, so at most `FREQUENT`, get short numbers, and their counts are broadcast. The same
   pass names every bigram with at least 1/`PAIRED` of all occurrences, and at most twice `PAIRED`.
2. Documents are exploded into rows (document, h, w, times), a row per distinct bigram of a document.
   Rows are dealt by a hash of the word, salted by its context if the word is frequent, and by the
   document in a frequent bigram. So no hash partition gets more than a small share through one word
   or bigram, at any size.
3. In the hash partitions the rows are sorted once, which makes the table of bigram counts (h, w, c)
   beside the rows that look it up: no bigram count or row is shuffled again for that. The counts of
   other words are dealt by the same hash and joined there, those of frequent words from the broadcast
   table. What is left open is joined after
   that: counts of other contexts from the unigram table, those of frequent bigrams from a table of
   them. Terms are summed per document before each shuffle.

Step 2 runs in `SLICES` slices of the hash, so that executors' disks hold one slice's rows at a time.

Words are runs other than space and 0x09-0x0D with A-Z lower-cased, as 48-bit hashes, so that at 10
million words no two are expected to be mixed up. A document is named by a 64-bit hash of its doc_id
and text; equal rows share a name, and their sums are divided among them.

Defined results: null, empty and blank texts have no words and a null score; a text of one word has
its unigram score; repeated rows are documents of their own, and see each other's bigrams; a null
doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import drop, materialize, mix, release, shuffle_partitions, small, table, word_hashes

ALPHA = 0.4
#: Words with 1/FREQUENT of all occurrences are frequent: FREQUENT rows of three numbers at most are broadcast.
FREQUENT = 100_000
#: Bigrams with 1/PAIRED of all occurrences are frequent; they and others, 2 PAIRED at most, are broadcast.
PAIRED = 5_000
SLICES = 2
_MASK = np.uint64((1 << 48) - 1)
#: A word is a number from 1 (frequent words), with salts above the lowest BITS, or HASHED with its hash; FIRST stands before a text.
FIRST, BITS, SALTS, KNOWN, HASHED = 0, 17, 4096, 1 << 30, 1 << 48
#: Words that a task gathers before it counts them.
HELD = 1_500_000


def words_of(text: pa.StringScalar) -> np.ndarray:
    return word_hashes(text.as_buffer() or b"") & _MASK


def _places(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x is in the sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


class Words:
    """Sorted hashes of words, found by their leading bits: a few look-ups a word instead of a binary search."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = np.append(words, _MASK + np.uint64(1)), np.uint64(48 - max(1, len(words).bit_length() + 1))
        lead = (words >> self.shift).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << 48 - int(self.shift)) + 1)).astype(np.int32)
        self.most = int(np.diff(self.start).max()) if len(words) else 0

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where each x is, or -1."""
        at = self.start[(x >> self.shift).astype(np.int64)]
        found = np.where(self.words[at] == x, at, -1)
        for k in range(1, self.most):
            found = np.where(self.words[np.minimum(at + k, len(self.words) - 1)] == x, at + k, found)
        return found.astype(np.int64)


def _chunks(columns: list, names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
    for i in range(0, whole.num_rows, rows):
        yield whole.slice(i, rows)


# --- 1: unigrams, frequent words and frequent bigrams --------------------------------------------

UNIGRAMS = "word long, context long, n long, ends long"


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and how often they end a document; and, with a context, counts of bigrams that are many at a time.

    A bigram with 1/PAIRED of all occurrences has half of that in parts of the corpus where it makes up 1/(2 PAIRED), so the
    counts given here add up to 1/(2 PAIRED) of all.
    """
    waiting, held = [], 0

    def flush():
        words = np.concatenate(waiting)
        keys, counts = np.unique(words, return_counts=True)
        last = np.cumsum([len(w) for w in waiting]) - 1
        ends = np.bincount(np.searchsorted(keys, words[last]), minlength=len(keys))
        waiting.clear()
        none = pa.nulls(len(keys), pa.int64())
        yield from _chunks([keys.astype(np.int64), none, counts, ends], UNIGRAMS.replace(",", "").split()[::2])
        least = max(2, len(words) // (2 * PAIRED))
        able = keys[counts >= least]
        p = _places(able, words)
        both = (p[:-1] >= 0) & (p[1:] >= 0)
        both[last[:-1]] = False
        pairs, n = np.unique(p[:-1][both] * len(able) + p[1:][both], return_counts=True)
        pairs, n = pairs[n >= least], n[n >= least]
        if len(pairs):
            yield from _chunks([able[pairs % len(able)].astype(np.int64), able[pairs // len(able)].astype(np.int64), n, np.zeros(len(n), np.int64)], UNIGRAMS.replace(",", "").split()[::2])

    for batch in batches:
        for text in batch.column(1):
            w = words_of(text)
            if len(w):
                waiting.append(w)
                held += len(w)
            if held > 3 * HELD:
                yield from flush()
                held = 0
    if held:
        yield from flush()
    release()


# --- 2: documents' bigrams as rows ----------------------------------------------------------------

BIGRAMS = "w long, h long, doc long, times long"
_NAMES = [x.split()[0] for x in BIGRAMS.split(", ")]


def _in_text(codes: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, ...]:
    """A text's distinct bigrams with words in the slice: h, w, and their times with, in the lower half, those of h as a
    context; first its first word."""
    order = np.argsort(codes)
    by = codes[order]
    new = np.ones(len(by), bool)
    np.not_equal(by[1:], by[:-1], out=new[1:])
    own, rank = by[new], np.empty(len(by), np.int64)
    rank[order] = np.cumsum(new) - 1
    here = (mix(own.astype(np.uint64)) >> np.uint64(40)) % np.uint64(parts) == part
    pairs = (rank[:-1] * len(own) + rank[1:])[here[rank[1:]]]
    pairs.sort()
    new = np.ones(len(pairs) + 1, bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:-1])
    at = np.flatnonzero(new)  # the last is the end
    pair = pairs[at[:-1]]
    h = pair // len(own)
    contexts = np.bincount(rank[:-1], minlength=len(own))
    found = own[h], own[pair - h * len(own)], np.diff(at) << 32 | contexts[h]
    if here[rank[0]]:
        found = np.append(FIRST, found[0]), np.append(codes[:1], found[1]), np.append(1 << 32, found[2])
    return found


def _bigrams(shared, part: int, parts: int):
    """The documents' bigrams in slice `part` of `parts`: the columns of BIGRAMS.

    A frequent word is its number, as w with salts above it and, in a frequent bigram, the sign KNOWN; any other word is
    its hash. `times` holds the times of the bigram and, in the lower half, those of its context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Words(shared.value[0]), shared.value[1]
        held, names, size = [], [], 0

        def flush():
            h, w, times = (np.concatenate(c) for c in zip(*held))
            doc = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            docs = np.array(names, np.int64)
            held.clear()
            names.clear()
            few = w < HASHED
            at = np.flatnonzero(few)
            hot = (h[at] < HASHED) & (_places(pairs, h[at] << BITS | w[at]) >= 0)
            salt = mix(np.where(hot, docs[doc[at]], h[at]).astype(np.uint64)) & np.uint64(SALTS - 1)
            w[at] |= salt.astype(np.int64) << BITS | np.where(hot, KNOWN, 0)
            yield from _chunks([w, h, docs[doc], times], _NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = words_of(text)
                if len(x):
                    at = words.places(x)
                    held.append(_in_text(np.where(at >= 0, at + 1, x.astype(np.int64) | HASHED), part, parts))
                    names.append(doc)
                    size += len(held[-1][0])
                if size > HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        release()

    return run


# --- 3: joins with the count tables ---------------------------------------------------------------


def _share(total: int):
    """What one word has of all."""
    return F.lit(1.0 / max(total, 1))


def _terms(rows: DataFrame, frequent: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """Per document, and per count that is not here: sums of words with, in the lower half, seen bigrams; and of terms.

    `context` is null where nothing is left open. It is a context that is not frequent, where the bigrams wait for
    log10(c(context .) - nh), or below 0 a frequent bigram, that waits for all of its term; nh has the bigram's times
    in its upper half there, as equal documents are summed here.
    """
    # in each hash partition: the table of bigram counts c beside the rows that they count, sorted by a hash first, as most
    # rows are then told apart by one number; and the counts of words, dealt as the rows are (words not in `repeated` have one)
    n = F.shiftright("times", 32)
    # (larger partitions than usual, as a document's terms are summed per partition before they are shuffled)
    df = rows.repartition(max(1, 3 * shuffle_partitions(rows.sparkSession) // 5), "w").select("w", "h", "doc", n.alias("n"), F.col("times").bitwiseAND(F.lit(0xFFFFFFFF)).alias("nh"), F.xxhash64("w", "h").alias("by"))
    df = df.withColumn("c", F.sum("n").over(Window.partitionBy("by", "w", "h"))).drop("by")
    df = df.join(repeated.hint("shuffle_hash"), "w", "left").withColumn("cw", F.coalesce("cw", F.lit(1)))
    # joined with the counts of frequent words
    number = F.when(F.col("w") < HASHED, F.col("w").bitwiseAND(F.lit((1 << BITS) - 1)))
    df = df.join(F.broadcast(frequent.select(F.col("id").alias("iw"), F.col("n").alias("fw"))), number == F.col("iw"), "left")
    df = df.join(F.broadcast(frequent.select(F.col("id").alias("ih"), F.col("follows").alias("fh"))), F.col("h") == F.col("ih"), "left")
    first, hot = F.col("h") == FIRST, (F.col("w") < HASHED) & (F.col("w") >= KNOWN)
    others = F.when(first | hot, F.lit(0)).otherwise(F.col("c") - F.col("n"))
    pair = F.when(hot, -1 - F.shiftleft("h", BITS).bitwiseOR(number))
    df = df.select("doc", "h", "n", "nh", "fh", first.alias("first"), pair.alias("pair"), others.alias("others"), F.coalesce("fw", "cw").alias("cw"))
    seen, hot = F.col("others") > 0, F.col("pair").isNotNull()
    known = F.greatest(F.coalesce(F.col("fh") - F.col("nh"), F.lit(1)), F.lit(1))
    ratio = F.when(seen, F.col("others") / known).otherwise(F.col("cw") * F.when(F.col("first"), _share(total)).otherwise(F.lit(ALPHA) * _share(total)))
    value = F.when(hot, F.lit(0.0)).otherwise(F.col("n") * F.log10(ratio))
    context = F.when(hot, F.col("pair")).when(seen & F.col("fh").isNull(), F.col("h"))
    times = F.shiftleft("n", 32) + F.when(seen, F.col("n")).otherwise(F.lit(0))
    df = df.select("doc", context.alias("context"), F.when(hot, F.shiftleft("n", 32) + F.col("nh")).when(seen & F.col("fh").isNull(), F.col("nh")).alias("nh"), times.alias("times"), value.alias("value"))
    return df.groupBy("doc", "context", "nh").agg(F.sum("times").alias("times"), F.sum("value").alias("value"))


def _local(spark: SparkSession, shape: str, *columns) -> DataFrame:
    names = shape.replace(",", "").split()[::2]
    return spark.createDataFrame(pa.table(list(columns), names), shape) if len(columns[0]) else spark.createDataFrame([], shape)


def scores(docs: DataFrame, slices: int = SLICES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_seen (bigrams that other documents have), score."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    name = F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("doc")
    rows = docs.select(name, text.alias("text"))
    counted = materialize(rows.mapInArrow(_unigrams, UNIGRAMS).groupBy("word", "context").agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("ends")).alias("follows")), "unigrams")
    unigrams = counted.where("context is null").select("word", "n", "follows")
    total = unigrams.agg(F.sum("n").alias("n")).first().n or 0

    # frequent words and bigrams: FREQUENT and 2 PAIRED rows at most, as each has its share of all occurrences
    top = unigrams.where(F.col("n") >= max(2, -(-total // FREQUENT))).toArrow().sort_by("word")
    words, counts, follows = top.column("word").to_numpy().astype(np.uint64), top.column("n").to_numpy(), top.column("follows").to_numpy()
    hot = counted.where("context is not null").where(F.col("n") >= max(2, total // (2 * PAIRED))).select("context", "word").toArrow()
    h, w = (_places(words, hot.column(x).to_numpy().astype(np.uint64)) for x in ("context", "word"))
    pairs = np.sort((h + 1 << BITS | w + 1)[(h >= 0) & (w >= 0)])
    shared = spark.sparkContext.broadcast((words, pairs))
    frequent = _local(spark, "id long, n long, follows long", np.arange(len(words)) + 1, counts, follows)

    repeated = unigrams.where("n > 1").select(F.col("word").bitwiseOR(F.lit(HASHED)).alias("w"), F.col("n").alias("cw"))
    done = [materialize(_terms(rows.mapInArrow(_bigrams(shared, part, slices), BIGRAMS), frequent, repeated, total), "terms") for part in range(slices)]
    terms = done[0]
    for x in done[1:]:
        terms = terms.unionByName(x)
    n = F.shiftright("times", 32)
    contexts = unigrams.where("follows > 1").select(F.col("word").bitwiseOR(F.lit(HASHED)).alias("context"), "follows")  # others have each
    rare = terms.where("context > 0").join(contexts.hint("shuffle_hash"), "context")
    rare = rare.withColumn("value", F.col("value") - n * F.log10(F.greatest(F.col("follows") - F.col("nh"), F.lit(1))))
    # frequent bigrams: a row each, with its count, its context's and its word's
    found = terms.where("context < 0").groupBy("context").agg(F.sum(n).alias("c")).toArrow()
    at = -1 - found.column("context").to_numpy()
    of_pairs = _local(spark, "context long, c long, fh long, fw long", found.column("context").to_numpy(), found.column("c").to_numpy(), follows[(at >> BITS) - 1], counts[(at & (1 << BITS) - 1) - 1])
    often = terms.where("context < 0").join(F.broadcast(of_pairs), "context").withColumn("others", F.col("c") - F.shiftright("nh", 32)).withColumn("nh", F.col("nh").bitwiseAND(F.lit(0xFFFFFFFF)))
    seen = F.col("others") > 0
    ratio = F.when(seen, F.col("others") / F.greatest(F.col("fh") - F.col("nh"), F.lit(1))).otherwise(F.col("fw") * F.lit(ALPHA) * _share(total))
    often = often.withColumn("value", n * F.log10(ratio))
    often = often.withColumn("times", F.col("times") + F.when(seen, n).otherwise(F.lit(0)))
    sums = terms.where("context is null").select("doc", "times", "value").unionByName(rare.select("doc", "times", "value")).unionByName(often.select("doc", "times", "value"))
    sums = materialize(sums.groupBy("doc").agg(F.sum("times").alias("times"), F.sum("value").alias("value")), "scores")
    for x in done:
        drop(x)
    drop(counted)
    named = docs.select(doc_id.alias("doc_id"), name)
    many = named.groupBy("doc").agg(F.count("*").alias("many")).where("many > 1")
    out = named.join(sums, "doc", "left").join(small(materialize(many, "repeated")), "doc", "left")
    each = lambda x: F.coalesce((x / F.coalesce("many", F.lit(1))).cast("long"), F.lit(0).cast("long"))
    words = F.shiftright("times", 32)
    return out.select("doc_id", each(words).alias("n_words"), each(F.col("times").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n_seen"), (F.round(F.col("value") / words, 6) + F.lit(0.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS MATERIALIZED (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d WHERE len(w) > 0
), t AS MATERIALIZED (SELECT r, i, CASE WHEN i > 1 THEN w[i - 1] END AS h, w[i] AS x FROM p
), u AS (SELECT x, count(*) AS c FROM t GROUP BY 1
), n AS (SELECT count(*) AS n FROM t
), b AS (SELECT h, x, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY 1, 2
), bd AS (SELECT r, h, x, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY 1, 2, 3
), k AS (SELECT h, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY 1
), kd AS (SELECT r, h, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY 1, 2
), s AS (
  SELECT r, 1 AS m, false AS seen, log10(u.c / n) AS v FROM t JOIN u USING (x), n WHERE h IS NULL
  UNION ALL
  SELECT bd.r, bd.c, b.c > bd.c, CASE WHEN b.c > bd.c THEN log10((b.c - bd.c) / (k.c - kd.c)) ELSE log10(0.4) + log10(u.c / n) END
  FROM bd JOIN b USING (h, x) JOIN k USING (h) JOIN kd ON kd.r = bd.r AND kd.h = bd.h JOIN u USING (x), n
), z AS (SELECT r, sum(m * v) AS v, sum(CASE WHEN seen THEN m ELSE 0 END) AS seen FROM s GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(seen, 0)::BIGINT AS n_seen, round(v / len(w), 6) AS score FROM d LEFT JOIN z USING (r)
"""
