"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed
rule. A policy is a version with a mask over those bits, so documents are accepted or rejected under
any policy, and rules are ablated, from the ledger alone, without the texts.

All expressions are SQL functions on one row, so the ledger needs no shuffle at any size.

Defined results: null or empty text has no words and fails `few_words`; repeated rows are judged
alike, one row each; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

# The word and symbol classes.
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule name -> condition on the measurements under which a document fails; the place is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policy version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "duplicate_lines"), "strict": tuple(RULES)}


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the measurements. Each step's arrays are columns of their own, so none is computed twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_t", text).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("_l", lines)
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long"))
    df = df.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    at = lambda i: F.get(F.col("_w"), i)
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    df = df.withColumn("_h", F.when(F.size("_w") > 3, windows).otherwise(F.array().cast("array<bigint>")))
    # equal windows stand side by side once sorted; texts without any skip the sort
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size("_h") > F.size(F.array_distinct("_h")), placed))
    n = F.size("_s")
    twins = F.zip_with(F.slice("_s", 1, n - 1), F.slice("_s", 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    first = F.array_distinct(F.flatten(twins))
    covered = F.array_distinct(F.flatten(F.transform(first, lambda i: F.array(i, i + 1, i + 2))))
    df = df.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
    return df.drop("_t", "_w", "_l", "_h", "_s")


def judge(measured: DataFrame) -> DataFrame:
    """Adds `failed`: the bits of the rules that the measurements fail.

    The bits come out of a generator, as a filter on them would otherwise be moved below the measurements and
    repeat their expressions.
    """
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values())), F.lit(0))
    return measured.select("*", F.inline(F.array(F.struct(bits.cast("long").alias("failed")))))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failed."""
    return judge(measure(docs.select("doc_id", "text"))).select("doc_id", *MEASURES, "failed")


def rejected(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents it fails, that it alone rejects, and what the policy rejects without it.

    The ledger is first summed by its bits under the mask, at most 2^rules rows however many documents.
    """
    whole = mask(POLICIES[policy])
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    rows = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        hit(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"), hit(F.col("bits") == F.col("bit")).alias("alone"), hit(F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0).alias("rejected_without")
    )


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy accepts, with their columns."""
    names = {"_" * 2 + c: c for c in docs.columns}
    inner = docs.select(F.col("text"), *[F.col(c).alias(k) for k, c in names.items()])
    return judge(measure(inner)).where(~rejected(policy)).select(*[F.col(k).alias(c) for k, c in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~rejected("v1")).alias("kept"), "n_lines", "failed")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM w
), g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM g
), r AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM h WHERE c > 1) GROUP BY 1
), x AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
), y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x
), z AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept, n_lines, failed FROM z
"""
