"""Main text of web pages by structure and by differencing with the page of the nearest URL.

A page becomes text lines, one a block, each with a verdict of its markup: inside an article or main
element (`article`), inside a menu, header, footer, sidebar, notice, advert, form, script, style or
comment section (`chrome`), or neither (`open`). Pages are paired by URL: within a host, in the order
of their paths, a page's partner is the neighbour whose path shares the longer beginning with its
own. The lines of both are aligned by longest common subsequence, for every page. Lines that a page
shares with its partner are the site's, not the page's, and are deleted; the others are its own. Then
markup mends what differencing cannot see: chrome goes, though it differs from page to page, and
article lines stay, though another page has them. So open lines are decided by differencing alone. A
page without a partner has nothing to be compared with: if it has an article, that is its text.

A copy says nothing of the site's lines, so pages of a host with the same lines are one page here, at
the first of their paths, and pages without lines are nobody's partner. Only line hashes are paired.
Ranks over a range partitioning by (host, path) pair the pages, so a host with a third of all pages
is spread as evenly as any.

Defined results: null or empty html has the empty text; pages without a URL share the empty host;
repeated rows have the same text, and an article of theirs stays; markup that is cut off
at the end is read as if closed there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, shuffle_partitions, small, table

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a new one of the second kind closes, as end tags may be left out.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in ("address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")}
# Class, id and role words of what is not main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|banner|popup|modal|overlay|comments?|replies|disqus|respond|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|site-header|header|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|widget|pagination|pager|complementary|contentinfo|toolbar)(?:$|[\s_-])",
    re.I,
)
#: Reader comments are none of the article, whatever elements they are made of.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|disqus|respond)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

ARTICLE, OPEN, CHROME_LINE = 2, 1, 0
#: Pairs of equal lines up to which two pages are aligned by their pairs; beyond it by bits, in time that repeats do not change.
MATCHES = 1_000_000


def lines(page: str | None) -> list[tuple[int, str]]:
    """(verdict, text) of every block with text, in page order."""
    if not page:
        return []
    out, held, stack = [], [], []  # stack: (element, chrome depth, depth of chrome by name, article depth)
    chrome = named = article = 0

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((CHROME_LINE if chrome or named else ARTICLE if article else OPEN, text))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if not name:  # a comment, a declaration or a tag that is cut off
            continue
        name = name.lower()
        if m.group(1):
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush() if (chrome, named, article) != stack[k][1:] else None
                    chrome, named, article = stack[k][1:]
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name == "br" or name == "hr":
            held.append(" ")
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in RAW and not m.group(3).rstrip().endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        shut = CLOSES.get(name)
        while shut and stack and (stack[-1][0] in shut or stack[-1][0] in INLINE and any(s[0] in shut for s in stack[-6:])):
            _, chrome, named, article = stack.pop()
        stack.append((name, chrome, named, article))
        if name in CHROME and not (name == "header" and article):
            chrome += 1
        elif name in MAIN:
            article += 1
            named = 0  # the article is nearer to its lines than a wrapper with such a name
        elif m.group(3) and name not in INLINE and name not in ("html", "body"):
            said = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m.group(3)))
            if said and REPLIES.search(said):
                chrome += 1
            elif said and (any(NAMES.fullmatch(x) for x in said.split() if x.lower() != "header") if article else NAMES.search(said)):
                named += 1
    flush()
    return out


def _by_pairs(a: list[int], places: dict[int, list[int]]) -> Iterator[int]:
    """Places in a of a longest common subsequence: chains of matches with rising places in b, kept by length (Hunt and Szymanski)."""
    ends: list[int] = []  # the smallest last place in b of a chain of each length
    chains: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places[x]):  # falling, so a line of a extends no chain twice
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        yield link[0]
        link = link[1]


def _by_bits(a: list[int], places: dict[int, list[int]], m: int) -> Iterator[int]:
    """The same by a row of m bits a line of a, where a 0 is a longer subsequence (Hyyro); only every k-th row is kept."""
    every, k, all_ones = {}, isqrt(len(a)) + 1, (1 << m) - 1

    def mask(x):
        found = every.get(x)
        if found is None:
            bits = bytearray(m // 8 + 1)
            for j in places[x]:
                bits[j >> 3] |= 1 << (j & 7)
            found = int.from_bytes(bits, "little")
            if len(places[x]) >= 64:  # at most m / 64 of these are kept
                every[x] = found
        return found

    def after(row, x):
        u = row & mask(x)
        return (row + u | row - u) & all_ones

    kept, row = [all_ones], all_ones
    for i, x in enumerate(a):
        row = after(row, x)
        if (i + 1) % k == 0:
            kept.append(row)
    j, rows, first = m, [], len(a)  # rows: from row `first` on, made again from a kept one
    for i in range(len(a) - 1, -1, -1):
        if i < first:
            first = i // k * k
            rows = [kept[i // k]]
            for x in a[first : min(first + k, len(a))]:
                rows.append(after(rows[-1], x))
        zeros = ~rows[i + 1 - first] & (1 << j) - 1
        j = zeros.bit_length()  # the least beginning of b, by lines, with as long a subsequence
        if not j:
            return
        if rows[i - first] >> j - 1 & 1:
            yield i
            j -= 1


def longest_common(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    both = set(a).intersection(b)
    at, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    a = [a[i] for i in at]
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    shared = set(at[:start]) | set(at[len(a) - stop :])
    a, b, at = a[start : len(a) - stop], b[start : len(b) - stop], at[start:]
    places: dict[int, list[int]] = {x: [] for x in a}
    for j, x in enumerate(b):
        if x in places:
            places[x].append(j)
    few = sum(len(places[x]) for x in a) <= MATCHES
    return shared.union(at[i] for i in (_by_pairs(a, places) if few else _by_bits(a, places, len(b))))


def _hash(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def address(url: str | None) -> tuple[str, str]:
    """Host in lower case without port, and path without query, fragment or closing slash."""
    m = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", (url or "").split("#")[0].split("?")[0]
    return m.group(1).rsplit("@", 1)[-1].split(":")[0].lower(), m.group(2).rstrip("/")


SEEN = "page_id long, page_hash long, host string, path string, hashes array<long>"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
    for batch in batches:
        hosts, paths, hashes = [], [], []
        for url, page in zip(batch.column(2), batch.column(3)):
            host, path = address(url.as_py())
            hosts.append(host)
            paths.append(path)
            hashes.append([_hash(t) for _, t in lines(page.as_py())])
        cols = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip((hosts, paths, hashes), kinds[2:]))]
        yield pa.RecordBatch.from_arrays(cols, SEEN.replace(",", "").split()[::2])


def page_hash():
    return F.xxhash64(F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit("")))


def _shared_path(x, y):
    """How many leading characters two paths have in common."""
    return F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(x), F.length(y))), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, other = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        shared = [sorted(longest_common(a, b)) for a, b in zip(own, other)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.list_(pa.int32()))], ["host", "content", "shared"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, page_hash, shared) of every page with a partner: places of the lines that it shares with it."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), page_hash().alias("page_hash"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    seen = materialize(rows.mapInArrow(_seen, SEEN).where(F.size("hashes") > 0).withColumn("content", F.xxhash64("hashes")), "pages-as-lines")
    different = seen.groupBy("host", "content").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    order = ["host", "path", "content"]
    dealt = different.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "pages-by-url")
    # ranks: the rows of earlier ranges (one number a range) and the place in the range
    counts = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    base = spark.createDataFrame(starts or [(0, 0)], "part int, base long")
    ranked = dealt.join(F.broadcast(base), "part").withColumn("rank", F.col("base") + F.col("nth"))
    near = lambda by, name: ranked.select((F.col("rank") + by).alias("rank"), F.struct("host", "path", "hashes").alias(name))
    both = ranked.join(near(1, "up"), "rank", "left").join(near(-1, "down"), "rank", "left")
    length = lambda n: F.when(F.col(f"{n}.host") == F.col("host"), _shared_path(F.col("path"), F.col(f"{n}.path"))).otherwise(F.lit(-1))
    up, down = F.coalesce(length("up"), F.lit(-1)), F.coalesce(length("down"), F.lit(-1))
    partner = F.when((up < 0) & (down < 0), F.lit(None)).when(up >= down, F.col("up.hashes")).otherwise(F.col("down.hashes"))
    pairs = both.select("host", "content", "hashes", partner.alias("other")).where("other is not null")
    aligned = pairs.mapInArrow(_align, "host string, content long, shared array<int>")
    return seen.select("page_id", "page_hash", "host", "content").distinct().join(aligned, ["host", "content"]).select("page_id", "page_hash", "shared")


TEXT = "page_id long, url string, text string, n_chars long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, shared in zip(batch.column(2), batch.column(3).to_pylist()):
            found = lines(page.as_py())
            own = set(range(len(found))).difference(shared or ())
            if shared is None and any(v == ARTICLE for v, _ in found):
                own = set()
            texts.append("\n".join(t for k, (v, t) in enumerate(found) if v == ARTICLE or v == OPEN and k in own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    gone = materialize(shared_lines(pages), "shared-lines")
    places = gone.agg(F.sum(F.size("shared"))).first()[0] or 0
    gone = gone.select(F.col("page_id").alias("p"), F.col("page_hash").alias("h"), "shared")
    gone = small(gone.hint("shuffle_hash"), 10_000) if places <= 1_000_000 else gone.hint("shuffle_hash")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), page_hash().alias("page_hash"))
    rows = rows.join(gone, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("page_hash") == F.col("h")), "left")
    return rows.select("page_id", "url", "html", "shared").mapInArrow(_texts, TEXT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
