"""WARC archives written and read by Spark's text source, with record boundaries verified by chain.

Writing: a record per page, one archive per task, through the text writer with the record's closing
blank lines as line separator, so that Spark's committer and any Hadoop file system serve. Of
records with equal payloads of at least 1000 bytes the one with the largest page_id is a response
and the others revisit it.

Reading: the text source splits archives at the magic `WARC/1.0`, wherever it stands, also inside
payloads. Each piece after a magic is a candidate: its Content-Length names the offset of its
successor. Consecutive candidates of a split that lead to one another form a run; pointer jumping
over runs from offset 0 of each file finds the run that each run leads to after 1, 2, 4, ... hops
and keeps the reachable ones with the offset at which they are entered. Candidates before that
offset or in other runs were payload bytes. Records whose payload holds the magic are put together
again from their pieces. Only offsets and header fields are shuffled, never whole payloads.

Defined results: null html is an empty payload; a null page_id is kept and counts as lowest; rows
with equal page_id and payload are all responses if that page_id is the largest; a null url gives
a record without target; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, shared_path, table

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
LEAST_BYTES = 1000
#: Revisit decisions (a page_id, a digest and an id each) are broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 200_000
SALTS = 32


def digests(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) for the pages that repeat the payload of a page with a larger id."""
    short = digests(pages).where(F.col("payload_bytes") >= least_bytes).select("page_id", "digest").groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    groups = short.groupBy("digest").agg(F.count("*").alias("pages"), F.max("page_id").alias("refers_to")).where("pages > 1 and refers_to is not null")
    # A digest may hold a third of all pages, so the join goes by digest and a salt.
    groups = groups.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = short.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(groups, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def _uri(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    decided = materialize(revisits(pages), "warc-revisits")
    if decided.count() <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    d = decided.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    rows = digests(pages).join(d, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(BLANK))
    rows = rows.withColumn("http", http)
    length = F.octet_length("http") + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _uri(F.col("url"))), F.lit("")),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(BLANK),
        F.col("http"),
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", BLANK).text(path)


# --- reading ---------------------------------------------------------------------------------


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between one magic and the next: file, split (its first byte), nth (ascending in a split), value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value")


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def parse(df: DataFrame) -> DataFrame:
    """Header fields of a value that begins after a magic, and the payload's digest if it is whole."""
    df = df.withColumn("head", F.substring_index("value", BLANK, 1)).withColumn("size", F.octet_length("value").cast("long")).withColumn("head_size", F.octet_length("head").cast("long"))
    df = df.withColumn("content", F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\t]*([0-9]+)', 1) as bigint)"))
    df = df.withColumn("type", _field(F.col("head"), "WARC-Type"))
    valid = F.col("type").isNotNull() & F.col("content").isNotNull() & (F.col("size") > F.col("head_size"))
    df = df.withColumn("span", F.when(valid, F.col("head_size") + F.col("content") + F.lit(2 * len(BLANK))))
    df = df.withColumn("whole", F.coalesce(F.col("span") == F.col("size"), F.lit(False)))
    before = F.when(F.coalesce(_field(F.col("head"), "Content-Type"), F.lit("")).startswith("application/http"), F.octet_length(F.substring_index("value", BLANK, 2))).otherwise(F.col("head_size"))
    df = df.withColumn("skip", F.when(F.col("whole"), before.cast("long") + F.lit(len(BLANK))))
    payload = F.expr("substring(cast(value as binary), cast(skip + 1 as int), cast(size - skip - 4 as int))")
    df = df.withColumn("payload_bytes", F.col("size") - F.col("skip") - F.lit(len(BLANK))).withColumn("actual", F.when(F.col("whole"), F.sha1(payload)))
    number = lambda name: F.expr(f"try_cast(regexp_extract(head, '(?im)^{name}:[ \\t]*<urn:x-page:([0-9-]+)>', 1) as bigint)")
    df = df.withColumn("page_id", number("WARC-Record-ID")).withColumn("refers_to", number("WARC-Refers-To"))
    df = df.withColumn("url", _field(F.col("head"), "WARC-Target-URI")).withColumn("named", F.regexp_extract("head", r"(?im)^WARC-Payload-Digest:[ \t]*sha1:([0-9a-f]+)", 1))
    return df.withColumn("full_bytes", F.expr("try_cast(regexp_extract(head, '(?im)^X-Payload-Length:[ \\t]*([0-9]+)', 1) as bigint)"))


FIELDS = ["type", "page_id", "refers_to", "url", "named", "full_bytes", "payload_bytes", "actual"]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per piece, with the offset of its magic, `next` (its successor's offset) and the run it is in."""
    seen = materialize(parse(pieces(spark, path)).select("file", "split", "nth", "size", "span", "whole", *FIELDS), "warc-pieces")
    here = Window.partitionBy("file", "split").orderBy("nth")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("size") + F.lit(len(MAGIC))
    totals = seen.groupBy("file", "split").agg(F.sum(step).alias("bytes"))
    by_split = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "split", F.coalesce(F.sum("bytes").over(by_split), F.lit(0)).alias("base"))
    rows = seen.withColumn("rel", F.coalesce(F.sum(step).over(earlier), F.lit(0)))
    # a whole candidate ends where the next piece's magic begins
    rows = rows.withColumn("leads", F.col("whole") & F.lead("nth").over(here).isNotNull())
    rows = rows.withColumn("run", F.coalesce(F.sum(F.when(F.col("leads"), 0).otherwise(1)).over(earlier), F.lit(0)))
    rows = rows.join(totals, ["file", "split"])
    magic = F.col("base") + F.col("rel") - F.lit(len(MAGIC))
    # a file's first piece ends where its first magic begins; it is no candidate and has offset -len(MAGIC)
    return rows.withColumn("offset", magic).withColumn("next", F.when(F.col("offset") >= 0, F.col("offset") + F.col("span") + F.lit(len(MAGIC)))).drop("base", "rel", "leads")


def reachable(found: DataFrame) -> DataFrame:
    """(file, split, run, entry): runs that the chain from offset 0 enters, and where, by pointer jumping."""
    real = found.where("offset >= 0")
    key = ["file", "split", "run"]
    runs = real.groupBy(*key).agg(F.max_by("next", "offset").alias("exit"))
    at = real.select("file", F.col("offset").alias("exit"), F.col("split").alias("split2"), F.col("run").alias("run2"))
    jump = materialize(runs.where("exit is not null").join(at, ["file", "exit"]).select(*key, "split2", "run2", F.col("exit").alias("entry2")), "warc-jumps")
    reach = real.where("offset = 0").select(*key, F.col("offset").alias("entry"))
    if jump.isEmpty():
        return reach
    reach, known = materialize(reach, "warc-reach"), -1
    while True:
        n = reach.count()
        if n == known:
            return reach
        known = n
        hop = reach.join(jump, key).select("file", F.col("split2").alias("split"), F.col("run2").alias("run"), F.col("entry2").alias("entry"))
        reach = materialize(reach.unionByName(hop).groupBy(*key).agg(F.min("entry").alias("entry")), "warc-reach")
        far = jump.select("file", F.col("split").alias("split2"), F.col("run").alias("run2"), F.col("split2").alias("split3"), F.col("run2").alias("run3"), F.col("entry2").alias("entry3"))
        jump = materialize(jump.join(far, ["file", "split2", "run2"]).select(*key, F.col("split3").alias("split2"), F.col("run3").alias("run2"), F.col("entry3").alias("entry2")), "warc-jumps")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record on the chain: file, offset and the header fields; digest and size are of the bytes read."""
    found = materialize(candidates(spark, path), "warc-candidates")
    on_chain = found.where("offset >= 0 and span is not null").join(reachable(found), ["file", "split", "run"]).where("offset >= entry")
    on_chain = materialize(on_chain.drop("entry"), "warc-chain")
    whole = on_chain.where("whole").select("file", "offset", *FIELDS)
    broken = on_chain.where("not whole").select("file", F.col("offset").alias("first"), F.col("next").alias("stop"))
    if broken.isEmpty():
        return whole
    # Pieces of records whose payload holds the magic: each belongs to the last record begun before it.
    inner = found.where("offset >= 0").select("file", "split", "nth", "offset")
    starts = broken.withColumn("offset", F.col("first"))
    w = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = inner.join(starts, ["file", "offset"], "left").withColumn("first", F.last("first", True).over(w)).withColumn("stop", F.last("stop", True).over(w)).where("offset < stop")
    values = pieces(spark, path).join(owned, ["file", "split", "nth"]).groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("p"))
    joined = values.select("file", F.col("first").alias("offset"), F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    return whole.unionByName(parse(joined).where("whole").select("file", "offset", *FIELDS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    r = F.col("type") == "revisit"
    return read_warc(spark, path).select(
        "page_id",
        F.when(r, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(r, F.col("named")).otherwise(F.col("actual")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
