"""Neighbourhoods that meet, in blocks: a list travels once to a block of vertices, not once to each of its arcs.

Vertices are dealt by hash into p blocks, of as many as a task can hold. In met() a task has the lists of two blocks and meets
them along the arcs in both directions, so every list is sent p times however many arcs it has; in mapped() arcs go from i to j
alone, and a list is sent 2 p times.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of lists that a task of mapped() holds of each of its two blocks, about.
ARCS = 32_000_000
#: Members that a task of met() holds of each, at 4 bytes where ids lie close together.
HELD = 80_000_000
#: Members that a task of ends() holds of each, which it sorts.
PATHS = 40_000_000
#: Members or paths that a task looks up at a time.
WORK = 1_000_000
#: Members of lists above which more blocks are made for the sake of parallel work.
LEAST = 100_000
#: Rows, or members of their lists, that a kernel returns at a time.
OUT = 200_000

LIST = "src long, dst long, both array<bigint>, up boolean"
COUNT = "src long, dst long, n long, up boolean"


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once: np.unique() goes through a hash table, a hundred times slower on millions."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]


def _sides(lists: DataFrame, arcs: int) -> DataFrame:
    """(key, side, id, nbrs, rank): each list for the tasks of its block as the first and as the second."""
    spark = lists.sparkSession
    p = max(-(-arcs // ARCS), min(math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)), 1 + arcs // LEAST))
    own = F.pmod(F.xxhash64("id"), F.lit(p))
    every = F.explode(F.expr(f"sequence(0L, {p - 1}L)"))
    rows = lists.withColumn("own", own).withColumn("other", every)
    keys = F.explode(F.array(F.struct((F.col("own") * p + F.col("other")).alias("key"), F.lit(0).alias("side")), F.struct((F.col("other") * p + F.col("own")).alias("key"), F.lit(1).alias("side"))))
    rows = rows.withColumn("k", keys).select("k.key", "k.side", "id", "nbrs", "rank")
    return rows.repartition(p * p, "key").sortWithinPartitions("key")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one key after another."""
    key, parts = None, []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if keys[a] != key:
                if parts:
                    yield pa.Table.from_batches(parts)
                key, parts = keys[a], []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _lists(table: pa.Table, side: int) -> tuple[np.ndarray, ...]:
    t = table.filter(pc.equal(table.column("side"), side))
    values = [c.flatten() for c in t.column("nbrs").chunks]
    length = pc.list_value_length(t.column("nbrs")).to_numpy().astype(np.int64)
    flat = np.concatenate([v.to_numpy() for v in values]) if values else np.zeros(0, np.int64)
    return t.column("id").to_numpy(), length, np.concatenate([[0], np.cumsum(length)]), flat, t.column("rank").to_numpy()


def _coded(ids: np.ndarray, *flats: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None, int]:
    """Ids and lists as small numbers, less the smallest, or their places among all where ids lie far apart."""
    full = [x for x in (ids, *flats) if len(x)]
    low, high = min(int(x.min()) for x in full), max(int(x.max()) for x in full)
    if high - low <= 4 * sum(len(x) for x in full) + 1_000_000:
        return ids - low, [f - low for f in flats], None, high - low + 1
    names = distinct(np.concatenate(full))
    return np.searchsorted(names, ids), [np.searchsorted(names, f) for f in flats], names, len(names)


def meetings(table: pa.Table, directed: bool) -> Iterator[tuple]:
    """(u, vs, hits, owner): a vertex, those whose lists it meets, and of each list the members it shares, with the place of the list in vs.

    Directed lists meet along each of their arcs. Otherwise u is the end of the edge with more neighbours, and the shorter list is looked through.
    """
    u_id, u_len, u_start, u_raw, u_rank = _lists(table, 0)
    v_id, v_len, v_start, v_raw, v_rank = _lists(table, 1)
    if not len(u_raw) or not len(v_id):
        return
    v_code, (u_val, v_val), _, span = _coded(v_id, u_raw, v_raw)
    at = np.full(span, -1, np.int64)
    at[v_code] = np.arange(len(v_code))
    mark = np.zeros(span, bool)
    for r in range(len(u_id)):
        near = u_val[u_start[r] : u_start[r + 1]]
        t = at[near]
        t = t[t >= 0]
        if not directed:
            t = t[(v_len[t] < u_len[r]) | ((v_len[t] == u_len[r]) & (v_id[t] < u_id[r]))]
        if not len(t):
            continue
        mark[near] = True
        size = v_len[t]
        ends = np.cumsum(size)
        places = np.repeat(v_start[t] - ends + size, size) + np.arange(ends[-1])
        hit = mark[v_val[places]]
        mark[near] = False
        yield r, t, v_raw[places[hit]], np.repeat(np.arange(len(t)), size)[hit], (u_id, u_rank, v_id, v_rank, u_raw, u_start, v_raw, v_start)


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each member of lists one after another, where its list begins, and how long that is."""
    return np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)


def _squeezed(nbrs: pa.ListArray) -> pa.Array:
    """Lists as bytes: their gaps, the lowest byte of all first, so that the high ones are runs of zeros where lists are sorted."""
    size, flat = pc.list_value_length(nbrs).to_numpy().astype(np.int64), nbrs.flatten().to_numpy()
    wide = flat.itemsize
    start, length = _places(size)
    step = np.diff(flat, prepend=flat.dtype.type(0))
    first = (np.cumsum(size) - size)[size > 0]
    step[first] = flat[first]
    raw, planes = np.empty(wide * len(flat), np.uint8), step.view(np.uint8).reshape(-1, wide)
    at = (wide - 1) * start + np.arange(len(flat))
    for k in range(wide):
        raw[at + k * length] = planes[:, k]
    ends = np.concatenate([[0], np.cumsum(wide * size)])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _members(raws: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, members) of lists made by _squeezed()."""
    wide = np.dtype(kind).itemsize
    ends = np.frombuffer(raws.buffers()[1], np.int32)[raws.offset : raws.offset + len(raws) + 1].astype(np.int64)
    size = np.diff(ends) // wide
    if not size.sum():
        return size, np.zeros(0, kind)
    raw = np.frombuffer(raws.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    start, length = _places(size)
    at = (wide - 1) * start + np.arange(len(start))
    step = np.empty((len(start), wide), np.uint8)
    for k in range(wide):
        step[:, k] = raw[at + k * length]
    flat = np.cumsum(step.view(kind).ravel(), dtype=kind)
    return size, flat - np.concatenate([np.zeros(1, kind), flat])[start]


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts, first = np.cumsum(pc.list_value_length(batch.column("nbrs")).to_numpy().astype(np.int64)), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(cuts, (cuts[first - 1] if first else 0) + HELD, "right")))
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([part.column("id"), _squeezed(part.column("nbrs")), part.column("rank")], ["id", "nbrs", "rank"])
            first = last


def _paired(lists: DataFrame, arcs: int, held: int | None = None) -> DataFrame:
    """(side, id, nbrs, rank): each list once for every block its own is paired with, as bytes; side 0 is a block with itself, 1 and 2 are the two of a pair."""
    wanted = math.ceil((math.sqrt(1 + 16 * lists.sparkSession.sparkContext.defaultParallelism) - 1) / 2)  # two tasks a core
    p = max(-(-arcs // (held or HELD)), min(wanted, 1 + arcs // LEAST))
    rows = lists.select("id", "nbrs", "rank").mapInArrow(_squeeze, f"id {dict(lists.dtypes)['id']}, nbrs binary, rank long")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(p))).withColumn("other", F.explode(F.expr(f"sequence(0L, {p - 1}L)")))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.expr("greatest(own, other) * (greatest(own, other) + 1) div 2 + least(own, other)").cast("int").alias("task"), side.cast("int").alias("side"), "id", "nbrs", "rank")
    return rows.repartitionById(p * (p + 1) // 2, "task").drop("task")


class _Block:
    """The lists of one block: ids, lengths, starts, members and ranks."""

    def __init__(self, parts: list[tuple]):
        ids, size, flat, rank = zip(*parts)
        self.id, self.size, self.rank = np.concatenate(ids), np.concatenate(size).astype(np.int64), np.concatenate(rank)
        self.flat = np.concatenate(flat)
        self.start = np.concatenate([[0], np.cumsum(self.size)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> dict[int, _Block]:
    parts: dict[int, list] = {}
    for batch in batches:
        sides = batch.column("side").to_numpy()
        for side in np.unique(sides).tolist():
            t = batch.filter(pa.array(sides == side))
            ids = t.column("id").to_numpy()
            parts.setdefault(side, []).append((ids, *_members(t.column("nbrs"), ids.dtype), t.column("rank").to_numpy()))
    return {side: _Block(parts.pop(side)) for side in sorted(parts)}


def _coded_blocks(batches: Iterator[pa.RecordBatch], low: int, names: bool) -> tuple[dict[int, _Block], int, Callable]:
    """The blocks with small numbers as ids, how many there may be, and what gives the ids back: numbers were less `low`, or are coded here if `names`."""
    blocks = _blocks(batches)
    if not names:
        return blocks, 1 + max((int(x.max()) for k in blocks.values() for x in (k.id, k.flat) if len(x)), default=-1), lambda x: x.astype(np.int64) + low
    known = distinct(np.concatenate([np.zeros(0, np.int64), *(x for k in blocks.values() for x in (k.id, k.flat))]))
    for k in blocks.values():
        k.id, k.flat = np.searchsorted(known, k.id), np.searchsorted(known, k.flat)
    return blocks, len(known), lambda x: known[x]


def _shared(a: _Block, b: _Block, span: int, directed: bool) -> Iterator[tuple]:
    """(r, t, n, hits): places of arcs from a to b, how many members their two lists share, and those one after another.

    64 lists of a are marked at a time, a bit each, and the members of lists of b are looked up in the marks, about WORK at a time.
    """
    at = np.full(span, -1, np.int32)
    at[b.id] = np.arange(len(b.id), dtype=np.int32)
    mark = np.zeros(span, np.uint64)
    for first in range(0, len(a.id), 64):
        last = min(first + 64, len(a.id))
        near = a.flat[a.start[first] : a.start[last]]
        r, t = np.repeat(np.arange(first, last), a.size[first:last]), at[near]
        keep = t >= 0
        r, t = r[keep], t[keep]
        if not directed:
            keep = (b.size[t] < a.size[r]) | ((b.size[t] == a.size[r]) & (b.id[t] < a.id[r]))
            r, t = r[keep], t[keep]
        if not len(t):
            continue
        for x in range(first, last):
            mark[a.flat[a.start[x] : a.start[x + 1]]] |= np.uint64(1 << (x - first))
        ends = np.cumsum(b.size[t])
        cut = 0
        while cut < len(t):
            done = ends[cut - 1] if cut else 0
            stop = max(cut + 1, int(np.searchsorted(ends, done + WORK, "right")))
            rs, ts, size = r[cut:stop], t[cut:stop], b.size[t[cut:stop]]
            places = np.repeat(b.start[ts] - (ends[cut:stop] - size - done), size) + np.arange(ends[stop - 1] - done)
            members = b.flat[places]
            owner = np.repeat(np.arange(len(ts)), size)
            hit = (mark[members] >> (rs - first).astype(np.uint64)[owner]) & np.uint64(1) != 0
            yield rs, ts, np.bincount(owner[hit], minlength=len(ts)), members[hit]
            cut = stop
        mark[near] = 0


def _kernel(directed: bool, counted: bool, low: int, names: bool) -> Callable:
    """met() in a task; ids are numbers less `low`, or any if `names`, which then are coded here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, span, plain = _coded_blocks(batches, low, names)
        for x, y in ((0, 0), (1, 2), (2, 1)):
            if x not in blocks or y not in blocks:
                continue
            a, b = blocks[x], blocks[y]
            for r, t, n, hits in _shared(a, b, span, directed):
                src, dst, up = a.id[r], b.id[t], a.rank[r] < b.rank[t]
                if directed:
                    some = n > 0
                    src, dst, n, up = src[some], dst[some], n[some], up[some]
                else:
                    up = up == (src < dst)
                    src, dst = np.minimum(src, dst), np.maximum(src, dst)
                n = n.astype(np.int64)
                shared = pa.array(n) if counted else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(plain(hits)))
                yield pa.RecordBatch.from_arrays([pa.array(plain(src)), pa.array(plain(dst)), shared, pa.array(up)], ["src", "dst", "n" if counted else "both", "up"])

    return run


def _ranked(lists: DataFrame) -> DataFrame:
    return lists if "rank" in lists.columns else lists.withColumn("rank", F.lit(0).cast("long"))


def _total(lists: DataFrame) -> int:
    return lists.agg(F.coalesce(F.sum(F.size("nbrs")), F.lit(0)).alias("n")).first().n


def met(lists: DataFrame, directed: bool, counted: bool = False) -> DataFrame:
    """Of lists(id, nbrs[, rank]), what the two lists of an arc share: `both`, or `n` of them if counted.

    Directed: the arcs from id to nbrs, acyclic, without those that share nothing. Otherwise lists are whole neighbourhoods, and every edge
    src < dst is there; `up` tells whether src has the lower rank. `both` is sorted as the lists are.
    """
    rows, arcs, low, wide = numbers(lists)
    return _paired(rows, arcs).mapInArrow(_kernel(directed, counted, low, wide), COUNT if counted else LIST)


def numbers(lists: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, int, int, bool]:
    """(lists, members, low, wide): with ids of 4 bytes, less `low`, unless they lie far apart (wide), those in more(nbrs) too."""
    of = lists.select(F.size("nbrs").alias("n"), F.least("id", F.array_min("nbrs")).alias("low"), F.greatest("id", F.array_max("nbrs")).alias("high"))
    if more is not None:
        of = of.unionByName(more.select(F.lit(0).alias("n"), F.array_min("nbrs").alias("low"), F.array_max("nbrs").alias("high")))
    one = of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.min("low"), F.lit(0)).alias("low"), F.coalesce(F.max("high"), F.lit(0)).alias("high")).first()
    wide = one.high - one.low > min(4 * one.n + 1_000_000, (1 << 31) - 2)
    rows, low = _ranked(lists), one.low
    if not wide:
        rows = rows.select((F.col("id") - low).cast("int").alias("id"), F.transform("nbrs", lambda x: (x - low).cast("int")).alias("nbrs"), "rank")
    return rows, one.n, low, wide


def _ends(a: _Block, b: _Block, span: int, same: bool) -> Iterator[tuple]:
    """(x, y, n, linked): places in a and b of two vertices, the n neighbours they share, and whether they are neighbours; each pair with n > 0 once.

    Paths from a vertex over its neighbours are sorted by their ends, about WORK paths at a time; a vertex with far more counts them by end.
    """
    order = np.argsort(b.flat, kind="stable")
    end = np.repeat(np.arange(len(b.id), dtype=np.int32), b.size)[order]
    del order
    count = np.bincount(b.flat, minlength=span).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    at = np.full(span, -1, np.int32)
    at[b.id] = np.arange(len(b.id), dtype=np.int32)
    reach = np.cumsum(np.add.reduceat(count[a.flat], a.start[:-1], dtype=np.int64))
    wide, cut = len(b.id), 0

    def paths(near):
        size = count[near].astype(np.int64)
        last = np.cumsum(size)
        return size, end[np.repeat(start[near] - last + size, size) + np.arange(last[-1])]

    while cut < len(a.id):
        done = reach[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(reach, done + WORK, "right")))
        near = a.flat[a.start[cut] : a.start[stop]]
        row = np.repeat(np.arange(stop - cut, dtype=np.int64), a.size[cut:stop])
        if reach[stop - 1] - done <= 2 * WORK:
            size, ends = paths(near)
            keys = np.repeat(row, size) * wide + ends
            keys.sort()
            place = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
            n = np.diff(np.append(place, len(keys)))
            keys = keys[place]
        else:  # one vertex
            whole = np.zeros(wide, np.int64)
            steps = np.cumsum(count[near], dtype=np.int64)
            k = 0
            while k < len(near):
                more = max(k + 1, int(np.searchsorted(steps, (steps[k - 1] if k else 0) + WORK, "right")))
                whole += np.bincount(paths(near[k:more])[1], minlength=wide)
                k = more
            keys = np.flatnonzero(whole)
            n = whole[keys]
        by = at[near]
        edges = np.sort(row[by >= 0] * wide + by[by >= 0])
        linked = np.zeros(len(keys), bool)
        if len(edges):
            linked = edges[np.minimum(np.searchsorted(edges, keys), len(edges) - 1)] == keys
        x, y = np.divmod(keys, wide)
        x += cut
        if same:
            once = a.id[x] < b.id[y]
            x, y, n, linked = x[once], y[once], n[once], linked[once]
        yield x, y, n, linked
        cut = stop


def _ended(low: int, names: bool, least: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, span, plain = _coded_blocks(batches, low, names)
        sums: dict[tuple[bool, int], int] = {}
        for i, j in ((0, 0), (1, 2)):
            if i not in blocks or j not in blocks:
                continue
            a, b = blocks[i], blocks[j]
            for x, y, n, linked in _ends(a, b, span, i == j):
                if least is None:
                    for flag in (False, True):
                        sizes = np.bincount(n[linked == flag])
                        for k in np.flatnonzero(sizes).tolist():
                            sums[flag, k] = sums.get((flag, k), 0) + int(sizes[k])
                    continue
                keep = (n >= least) & ~linked
                u, v = a.id[x[keep]], b.id[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(plain(np.minimum(u, v))), pa.array(plain(np.maximum(u, v))), pa.array(n[keep].astype(np.int64))], ["u", "v", "n"])
        if least is None:
            rows = [(*k, s) for k, s in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))], ["linked", "n", "pairs"])

    return run


def ends(lists: DataFrame, least: int | None = None) -> DataFrame:
    """Of neighbourhoods lists(id, nbrs), how many pairs of vertices share how many neighbours, n > 0: (linked, n, pairs).

    Given `least`, the pairs u < v themselves that are no edge and share at least so many: (u, v, n). No path between two vertices leaves its task.
    """
    rows, arcs, low, wide = numbers(lists.where(F.size("nbrs") > 0))
    schema = "linked boolean, n long, pairs long" if least is None else "u long, v long, n long"
    out = _paired(rows, arcs, PATHS).mapInArrow(_ended(low, wide, least), schema)
    return out.groupBy("linked", "n").agg(F.sum("pairs").alias("pairs")) if least is None else out


def mapped(lists: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(u, v, a, b, both) of every edge u < v with the sorted neighbourhoods of its ends and what they share: a row of schema each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for table in _groups(batches):
            rows, held = [], 0
            for r, t, hits, owner, (u_id, _, v_id, _, u_raw, u_start, v_raw, v_start) in meetings(table, False):
                a, cuts = u_raw[u_start[r] : u_start[r + 1]], np.searchsorted(owner, np.arange(len(t) + 1))
                u = int(u_id[r])
                for k, x in enumerate(t.tolist()):
                    v, b, both = int(v_id[x]), v_raw[v_start[x] : v_start[x + 1]], hits[cuts[k] : cuts[k + 1]]
                    rows.append(kernel(u, v, a, b, both) if u < v else kernel(v, u, b, a, both))
                    held += len(a) + len(b)
                if held > OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return _sides(_ranked(lists), _total(lists)).mapInArrow(run, schema)
