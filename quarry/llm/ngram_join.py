"""N-gram Jaccard self-join with prefix trees.

A document's set is its distinct 5-word shingles, as 64-bit hashes. All sets are put in one global
order, rare shingles first: by the class of a count sketch over the whole corpus, then by hash. The
sketch has a cell for every few shingles, up to 2^24 cells; any order gives the same links, a better
one smaller blocks. Two sets that link have sizes within 3 : 4 and share a shingle within their
prefixes (a set of n has a prefix of n - ceil(0.75 n) + 1), so

1. every set is exploded into rows (shingle, set, size) of its prefix. Sets under a shingle are
   paired, and connected if the prefix shingles that they share leave room for a link. Under a
   shingle with more than `GROUP` sets they are chained by size instead, which connects whatever can
   link there. A task first makes stars of such a crowd as it has in one band of sizes, and sends the
   smallest and the largest on, so a shingle that a third of all documents share stays small;
2. the connected sets are a block. In a block the ordered sets stand in a path-compressed prefix
   tree, and every set is joined with the tree from the root: documents below a node share the
   overlap counted so far, and a subtree goes when that overlap with all that may remain on both
   sides cannot reach the overlap a link needs, or when all its documents are already connected;
3. a block with more than `BLOCK_SHINGLES` shingles or `BLOCK_SETS` sets is too much for one task.
   It is dealt into parts; a tree takes the sets of two parts at a time, first each part by itself,
   then every two parts, with what the first round connected.

Sets travel once for each tree they are in; equal sets are one, whatever the number of copies.

Defined results: null, empty and blank texts have no shingles and link with nothing, not even each
other; fewer than five words are one shingle; equal sets link; repeated rows are documents with
equal sets; a null doc_id takes part, but is no component's smallest unless all are null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import drop, materialize, mix, release, shingle_hashes, small, table, word_hashes
from quarry.operators.components import components

WIDTH = 5
#: A link needs intersection / union >= PART / WHOLE.
PART, WHOLE = 3, 4
#: The sketch has 2^16 to 2^24 cells: 32 MB at most in a task, and 8 MB once classed.
SKETCH_BITS = (16, 24)
SLICES = 64
#: Under a shingle with so many sets all pairs are made; the sets of others are chained.
GROUP = 16
#: Shingles that a task gathers before it counts or chains them.
HELD = 300_000
#: Shingles and sets in one tree at most, unless two sets alone have more.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 20_000


def text_set(text: str | pa.Scalar | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    data = (text.as_buffer() if isinstance(text, pa.Scalar) else (text or "").encode("utf-8", "surrogatepass")) or b""
    return np.unique(shingle_hashes(word_hashes(data), WIDTH))


def set_name(h: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets; 0 is the empty set."""
    if not len(h):
        return 0
    with np.errstate(over="ignore"):
        both = mix(np.array([h.sum(dtype=np.uint64), mix(h).sum(dtype=np.uint64)]) + np.uint64(len(h)))
        return int((both[0] ^ (both[1] * np.uint64(3))).astype(np.int64)) or 1


def need(na, nb):
    """The smallest overlap with which sets of these sizes link."""
    return -(-PART * (na + nb) // (PART + WHOLE))


def prefix_length(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


# --- pass 1: sets' sizes and names, and the count sketch --------------------------------------

PROFILE = "doc_id long, text_hash long, n long, node long, task long, slice int, cells binary"


def _profile(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        counts, waiting, held = np.zeros(1 << bits, "<u2"), [], 0
        mask = np.uint64((1 << bits) - 1)

        def count():
            nonlocal held
            if waiting:
                np.minimum(counts, 0x7FFF, out=counts)  # a text adds one to a cell for each shingle of its set
                cells, times = np.unique((np.concatenate(waiting) & mask).astype(np.int64), return_counts=True)
                counts[cells] += np.minimum(times, 0x7FFF).astype("<u2")
            waiting.clear()
            held = 0

        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("task", pa.int64()), ("slice", pa.int32()), ("cells", pa.binary())])
        for batch in batches:
            ns, nodes = [], []
            for text in batch.column(2):
                h = text_set(text)
                ns.append(len(h))
                nodes.append(set_name(h))
                waiting.append(h)
                held += len(h)
                if held > HELD:
                    count()
            k = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        count()
        if counts.any():
            parts = counts.reshape(SLICES, -1)
            for i in range(SLICES):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([task], pa.int64()), pa.array([i], pa.int32()), pa.array([_zip(parts[i])], pa.binary())], schema=schema)
        release()

    return run


_ZSTD = pa.Codec("zstd", compression_level=1)


def _zip(cells: np.ndarray) -> bytes:
    return bytes([cells.itemsize]) + cells.nbytes.to_bytes(8, "little") + _ZSTD.compress(cells.tobytes(), asbytes=True)


def _unzip(data: bytes) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[9:], int.from_bytes(data[1:9], "little")), f"<u{data[0]}")


def sketch_bits(docs: DataFrame) -> int:
    """About a cell for two shingles, at six bytes a word, within the bounds."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    return int(np.clip((size // 12 + 1).bit_length(), *SKETCH_BITS))


def profile(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of doc_id, text_hash, n (set size), node (set name); and the tasks' parts of the sketch, with a slice."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return materialize(rows.mapInArrow(_profile(bits), PROFILE), "sets")


def _add_slices(t: pa.Table) -> pa.Table:
    total = np.zeros(1, np.int64)
    for c in t.column("cells"):
        total = total + _unzip(c.as_py())
    cells = _zip(np.minimum(total, 0xFFFFFFFF).astype("<u4"))
    return pa.table({"task": pa.array([t.column("task")[0].as_py()], pa.int64()), "slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "cells": pa.array([cells], pa.binary())})


def levels(mean: float) -> np.ndarray:
    """Bounds of the classes of cells: close to the mean, which is what other shingles put into a cell, then far above it."""
    near = np.floor(mean + np.linspace(-2, 4, 12) * mean**0.5 + 1)
    usual = mean + 4 * mean**0.5 + 4
    return np.unique(np.concatenate((near, [8 * usual, 64 * usual])))


def _classed(mean: float):
    """Four bits a cell: how many of the levels it exceeds."""
    bounds = levels(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for c in b.column(1):
                k = np.searchsorted(bounds, _unzip(c.as_py())).astype(np.uint8).reshape(-1, 2)
                packed.append((k[:, 0] | k[:, 1] << 4).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["slice", "cells"])

    return run


def rarity_classes(profiled: DataFrame, bits: int) -> np.ndarray:
    """The sketch's cells as classes, two to a byte.

    Parts are added 64 at a time, so no task meets the parts of all tasks; the driver gets the classes, of fixed size.
    """
    parts = profiled.where("slice is not null").select("task", "slice", "cells")
    tasks = (parts.agg(F.max("task").alias("m")).first().m or 0) + 1
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / 64)).groupBy("task", "slice").applyInArrow(_add_slices, "task long, slice int, cells binary")
        tasks = -(-tasks // 64)
        if tasks == 1:
            break
        parts = materialize(parts, "sketch")
    total = profiled.where("slice is null").agg(F.sum("n").alias("n")).first().n or 0
    found = {r.slice: r.cells for r in parts.select("slice", "cells").mapInArrow(_classed(total / (1 << bits)), "slice int, cells binary").collect()}  # SLICES rows
    return np.concatenate([np.frombuffer(found[i], np.uint8) for i in range(SLICES)]) if found else np.zeros(1 << (bits - 1), np.uint8)


def ordered(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set's keys in the global order: class, then hash."""
    cell = h & np.uint64(2 * len(classes) - 1)
    c = (classes[(cell >> np.uint64(1)).astype(np.int64)] >> ((cell & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15
    return np.sort((c.astype(np.uint64) << np.uint64(60)) | (h >> np.uint64(4)))


# --- pass 2: prefixes as rows, and what they connect ------------------------------------------

PREFIXES = "token long, node long, n int, star long"


def band(n: np.ndarray) -> np.ndarray:
    """Sizes of one band can all link with each other."""
    return np.floor(np.log(n) / np.log(WHOLE / PART) + 1e-9).astype(np.int64)


def _prefixes(shared):
    """Rows of shingles in the prefixes of sets; and rows with `star`, a set under the same shingle in the same band of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        nodes, sizes, keys, held = [], [], [], 0

        def flush():
            lengths = [len(k) for k in keys]
            token = (mix(np.concatenate(keys)) >> np.uint64(16)).astype(np.int64)
            node, n = np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
            nodes.clear(), sizes.clear(), keys.clear()
            order = np.argsort(token)
            token, node, n = token[order], node[order], n[order]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            more = np.repeat(np.diff(start) > GROUP, np.diff(start))
            yield from rows(token[~more], node[~more], n[~more], None)
            token, node, n = token[more], node[more], n[more]
            if len(token):
                bands = band(n)
                order = np.lexsort((node, n, bands, token))
                token, node, n, bands = token[order], node[order], n[order], bands[order]
                new = np.concatenate(([True], (token[1:] != token[:-1]) | (bands[1:] != bands[:-1])))
                last = np.concatenate((new[1:], [True]))
                star = node[np.flatnonzero(new)[np.cumsum(new) - 1]]
                ends = new | last
                yield from rows(token[ends], node[ends], n[ends], None)
                # stars are edges already; a token of their own lets them pass
                token, node, n, star = (x[~new] for x in (token, node, n, star))
                apart = (mix(token.astype(np.uint64) ^ mix(node.astype(np.uint64))) >> np.uint64(16)).astype(np.int64)
                yield from rows(-1 - apart, node, n, star)

        def rows(token, node, n, star):
            for i in range(0, len(token), 100_000):
                part = slice(i, i + 100_000)
                others = pa.nulls(len(token[part]), pa.int64()) if star is None else pa.array(star[part])
                yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(node[part]), pa.array(n[part].astype(np.int32)), others], ["token", "node", "n", "star"])

        for batch in batches:
            for text in batch.column(0):
                h = text_set(text)
                node = set_name(h)
                if not len(h) or node in seen:  # copies within a task are sent once
                    continue
                seen.add(node)
                nodes.append(node)
                sizes.append(len(h))
                keys.append(ordered(h, classes)[: prefix_length(len(h))])
                held += len(keys[-1])
                if held > HELD:
                    yield from flush()
                    held = 0
        if nodes:
            yield from flush()
        release()

    return run


def _bound(extra) -> Column:
    """Whether sets that share c shingles in their prefixes, and `extra` more at most, can link; see prefix_length()."""
    rest = lambda n: F.ceil(F.col(n) * PART / WHOLE) - 1
    return F.col("c") + extra + F.greatest(rest("na"), rest("nb")) >= F.ceil((F.col("na") + F.col("nb")) * PART / (PART + WHOLE))


def connections(docs: DataFrame, shared) -> DataFrame:
    """(a, b): pairs of sets that connect, directly or over others, whatever sets can link."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_prefixes(shared), PREFIXES)
    w = Window.partitionBy("token").orderBy("n", "node")
    many = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select("*", many.alias("many"), F.lag("node").over(w).alias("before"), F.lag("n").over(w).alias("n_before"))
    rows = materialize(rows.where((F.col("many") > 1) | F.col("star").isNotNull()), "shared-shingles")
    close = lambda x, y: WHOLE * F.least(x, y) >= PART * F.greatest(x, y)
    stars = rows.where("star is not null").select(F.col("node").alias("a"), F.col("star").alias("b"))
    # under a crowded shingle: sets between two that can link can link with their neighbours by size
    crowded = rows.where((F.col("star").isNull()) & (F.col("many") > GROUP))
    chains = crowded.where((F.col("node") != F.col("before")) & close("n", "n_before")).select(F.col("node").alias("a"), F.col("before").alias("b"))
    # under others: pairs, if the shingles that they share leave room for a link
    few = rows.where((F.col("star").isNull()) & (F.col("many") <= GROUP))
    one, two = (few.select("token", F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = one.join(two, "token").where((F.col("a") < F.col("b")) & close("na", "nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    in_crowds = rows.where((F.col("star").isNotNull()) | (F.col("many") > GROUP)).groupBy("node").agg(F.count("*").alias("extra"))
    in_crowds = small(materialize(in_crowds, "crowds"))
    for x in "ab":
        pairs = pairs.join(in_crowds.select(F.col("node").alias(x), F.col("extra").alias(f"x{x}")), x, "left")
    pairs = pairs.where(_bound(F.least(F.coalesce("xa", F.lit(0)), F.coalesce("xb", F.lit(0))))).select("a", "b")
    return stars.unionByName(chains).unionByName(pairs).distinct()


# --- blocks and prefix trees ------------------------------------------------------------------


class Trie:
    """Ordered sets in a path-compressed prefix tree.

    Sets are sorted, so those below a node stand together. A node is (depth, parent's depth, first
    set, end, subtree's smallest and largest size); its label is a slice of its first set.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.shared = np.array([0] + [self._common(x, y) for x, y in zip(self.sets, self.sets[1:])])

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def children(self, first: int, end: int, depth: int) -> list[tuple[int, int]]:
        """The ranges of sets in [first, end) that go on alike after `depth`."""
        cuts = (np.flatnonzero(self.shared[first + 1 : end] <= depth) + first + 1).tolist()
        return list(zip([first, *cuts], [*cuts, end]))

    def matches(self, probe: np.ndarray, wanted: np.ndarray) -> Iterator[int]:
        """Places of wanted sets that link with the probe; subtrees without a wanted set are not entered."""
        before = np.concatenate(([0], np.cumsum(wanted)))
        stack = [(a, b, 0, 0) for a, b in reversed(self.children(0, len(self.sets), 0))]
        while stack:
            first, end, depth, overlap = stack.pop()
            if before[end] == before[first]:
                continue
            leaf, sizes = self.sets[first], self.sizes[first:end]
            to = int(self.shared[first + 1 : end].min()) if end - first > 1 else len(leaf)
            if to > depth:
                label = leaf[depth:to]
                at = np.searchsorted(probe, label)
                overlap += int((probe[np.minimum(at, len(probe) - 1)] == label).sum())
            passed = int(np.searchsorted(probe, leaf[to - 1], side="right")) if to else 0
            if overlap + min(len(probe) - passed, int(sizes.max()) - to) < need(len(probe), int(sizes.min())):
                continue
            if end - first == 1:
                if overlap >= need(len(probe), len(leaf)):
                    yield first
                continue
            # sets that end here come first, as they sort before their extensions
            ended = first
            while ended < end and len(self.sets[ended]) == to:
                if wanted[ended] and overlap >= need(len(probe), to):
                    yield ended
                ended += 1
            if ended < end:
                stack += [(a, b, to, overlap) for a, b in reversed(self.children(ended, end, to))]


def join_block(sets: dict[int, np.ndarray], labels: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links among the sets: enough of them to connect what all links and equal labels connect."""
    names = list(sets)
    trie = Trie([sets[x] for x in names])
    names = [names[i] for i in trie.order]
    if labels is None:
        component = np.arange(len(names))
    else:
        component = np.unique([labels[x] for x in names], return_inverse=True)[1]
    links = []
    for a in range(len(names)):
        wanted = component != component[a]
        wanted[: a + 1] = False
        if not wanted.any():
            continue
        for b in trie.matches(trie.sets[a], wanted):
            if component[a] != component[b]:
                component[component == component[b]] = component[a]
                links.append((names[a], names[b]))
    return links


def _join(shared):
    """The links in one block: the table of its sets' texts, with labels of what is connected already."""

    def run(members: pa.Table) -> pa.Table:
        sets, labels = {}, {}
        for node, label, text in zip(members.column("node").to_pylist(), members.column("label").to_pylist(), members.column("text")):
            h = text_set(text)
            if set_name(h) == node:
                sets[node], labels[node] = ordered(h, shared.value), label
        links = join_block(sets, labels)
        size = sum(map(len, sets.values()))
        sets.clear()
        if size > 100_000:
            release()
        return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([y for _, y in links], pa.int64())})

    return run


def _with_texts(docs: DataFrame, profiled: DataFrame, members: DataFrame) -> DataFrame:
    """members(block, node, label) with a text that has the node's set."""
    texts = profiled.where("slice is null and n > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    members = materialize(members.join(texts, "node"), "members")
    wanted = small(members.select("text_hash").distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return members.join(found, "text_hash").select("block", "node", "label", "text")


def _trees(docs: DataFrame, profiled: DataFrame, members: DataFrame, shared) -> DataFrame:
    """(src, dst): the links in every block of members(block, node, label)."""
    return materialize(_with_texts(docs, profiled, members).groupBy("block").applyInArrow(_join(shared), "src long, dst long"), "links")


def links(docs: DataFrame, profiled: DataFrame, bits: int) -> DataFrame:
    """(src, dst): links between set names that connect whatever all links connect."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity_classes(profiled, bits))
    edges = materialize(connections(docs, shared), "connections")
    blocks = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    drop(edges)
    sizes = profiled.where("slice is null and n > 0").select(F.col("node").alias("id"), "n").distinct()
    placed = materialize(blocks.join(sizes, "id").select(F.col("label").alias("block"), F.col("id").alias("node"), "n"), "blocks")
    load = placed.groupBy("block").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    parts = F.ceil(2 * F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("sets") / BLOCK_SETS))
    heavy = materialize(load.where((F.col("shingles") > BLOCK_SHINGLES) | (F.col("sets") > BLOCK_SETS)).select("block", parts.alias("parts")), "heavy")
    alone = F.col("node").alias("label")
    light = placed.join(heavy, "block", "left_anti").select("block", "node", alone)
    found = _trees(docs, profiled, light, shared)
    if heavy.isEmpty():
        return found
    dealt = materialize(placed.join(heavy, "block").select("block", "node", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")), "parts")
    first = _trees(docs, profiled, dealt.select(F.xxhash64("block", "part").alias("block"), "node", alone), shared)
    told = dealt.join(components(first).withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    pairs = told.select("block", "node", "label", "part", other).where("part <> other")
    pairs = pairs.select(F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "node", "label")
    return found.unionByName(first).unionByName(_trees(docs, profiled, pairs, shared))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, node (the set's name), component_id."""
    bits = sketch_bits(docs)
    profiled = profile(docs, bits)
    labels = components(links(docs, profiled, bits))
    rows = profiled.where("slice is null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node")
    rows = rows.join(small(labels.withColumnRenamed("id", "node")), "node", "left").withColumn("class", F.coalesce("label", "node"))
    least = materialize(rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "components")
    rows = rows.join(least, "class", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one (that with the smallest doc_id) of every component."""
    found = materialize(near_duplicates(docs), "near-duplicates")
    group = F.when(F.col("n_shingles") > 0, F.struct(F.col("component_id").alias("c"), F.lit(0).cast("long").alias("t"))).otherwise(F.struct(F.col("doc_id").alias("c"), F.col("text_hash").alias("t")))
    rows = found.where("n_shingles > 0").groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))).alias("k"), F.count("*").alias("many"))
    one = materialize(rows.select("k.doc_id", "k.text_hash"), "kept")
    out = found.where("n_shingles > 0").select("doc_id", "text_hash").join(one, found["doc_id"].eqNullSafe(one["doc_id"]) & (found["text_hash"] == one["text_hash"]), "left_anti")
    gone = small(materialize(out.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "gone"))
    # rows equal in doc_id and text: one of them stays
    again = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    again = small(materialize(again, "repeated"))
    on = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_h")
    on = on & docs["doc_id"].eqNullSafe(F.col("_d"))
    left = docs.join(gone, on, "left_anti")
    twice = left.join(again, on, "left_semi")
    single = left.join(again, on, "left_anti")
    if again.isEmpty():
        return left
    return single.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS sh FROM d WHERE len(w) > 0
  )
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), cc(id, label) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT z.id, z.c FROM (SELECT l.y AS id, min(cc.label) AS c FROM cc JOIN l ON l.x = cc.id GROUP BY 1) z JOIN recurring.cc o ON o.id = z.id AND z.c < o.label
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, label AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN cc ON cc.id = d.doc_id
"""
