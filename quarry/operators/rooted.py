"""Neighbourhoods from groups, lists along an order, and what lies around a vertex, all sent as packed arrays.

A packed row holds what goes to one partition: ids of 4 bytes, less the smallest, where they lie close together, as their gaps, the
lowest bytes of all first. So no row is made, sorted or spilled for an edge or a triangle, and the high bytes, mostly zero, take next
to no room once compressed; a task sorts the numbers of its partition, which are of a bounded number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.operators.blocks import OUT, distinct

#: Pairs, arcs and members, or wedges, that a partition gets, about.
PAIRS = 4_000_000
ARCS = 1_000_000
WEDGES = 50_000_000
#: Pairs that are made at a time, and arcs and members that a task gathers before it sends them.
MADE = 2_000_000
#: Vertices whose places in an order are sent to all workers, 4 or 8 bytes each; beyond it they are joined.
PLACES = 16_000_000


def _slots(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _wide(low: int, high: int, n: int) -> bool:
    return high - low > min(4 * n + 1_000_000, (1 << 31) - 2)


def _dealt(x: np.ndarray, n: int) -> np.ndarray:
    """The partition of each id."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def _runs(size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run of `size`, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _flat(chunks: list, kind=np.int64) -> np.ndarray:
    return np.concatenate(chunks) if chunks else np.zeros(0, kind)


def _gaps(x: np.ndarray) -> pa.Array:
    """One value: the differences of the numbers, byte by byte; they may wrap around."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return pa.array([step.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()], pa.binary())


def _members(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The numbers of each row made by _gaps()."""
    size = np.dtype(kind).itemsize
    planes = (np.frombuffer(x, np.uint8).reshape(size, -1) for x in column.to_pylist())
    return [np.cumsum(np.ascontiguousarray(p.T).view(kind).ravel(), dtype=kind) for p in planes]


def _all(batches: Iterator[pa.RecordBatch], names: list[str], kind: type) -> list[np.ndarray]:
    """The numbers in such columns, of all rows."""
    held: list[list] = [[] for _ in names]
    for batch in batches:
        for column, name in zip(held, names):
            column += _members(batch.column(name), kind)
    return [_flat(c) for c in held]


# --- neighbourhoods ----------------------------------------------------------------------------


def _lists_of(keys: np.ndarray, plain: Callable) -> Iterator[pa.RecordBatch]:
    """(id, nbrs) of sorted distinct keys id << 32 | neighbour."""
    ids = keys >> 32
    cuts = np.flatnonzero(np.concatenate([np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1], np.ones(min(len(ids), 1), bool)]))
    first = 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + OUT, "right")) - 1)
        a, b = cuts[first], cuts[last]
        nbrs = pa.ListArray.from_arrays(pa.array((cuts[first : last + 1] - a).astype(np.int32)), pa.array(plain(keys[a:b] & 0xFFFFFFFF)))
        yield pa.RecordBatch.from_arrays([pa.array(plain(ids[cuts[first:last]])), nbrs], ["id", "nbrs"])
        first = last


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, nbrs): of rows(g, i), the sorted other items that share a group with an item; items that share none are left out."""
    rows = rows.where("g is not null and i is not null")
    zero = F.lit(0)
    each = rows.groupBy("g").agg(F.count("*").alias("n"))
    one = each.agg(F.coalesce(F.sum("n"), zero).cast("long").alias("n"), F.coalesce(F.sum(F.expr("n * (n - 1)")), zero).cast("long").alias("pairs")).first()
    ids = rows.agg(F.coalesce(F.min("i"), zero).cast("long").alias("low"), F.coalesce(F.max("i"), zero).cast("long").alias("high")).first()
    wide, low = _wide(ids.low, ids.high, one.pairs), ids.low
    n_groups, n_ids = max(1, min(2 * _slots(rows), 1 + one.n // 10_000), one.n // MADE), max(1, min(2 * _slots(rows), 1 + one.pairs // 100_000), one.pairs // PAIRS)
    kind = np.int64 if wide else np.int32

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("g").to_numpy(), b.column("i").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        g, i = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((i, g))
        g, i = g[order], i[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
        g, i = g[new], (i[new] if wide else i[new] - low).astype(kind)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(start, len(g)))
        start, size = np.repeat(start, size), np.repeat(size, size)
        ends = np.cumsum(size)
        cut = 0
        while cut < len(g):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + MADE, "right")))
            a, b = np.repeat(np.arange(cut, stop), size[cut:stop]), _runs(size[cut:stop], start[cut:stop])
            keep = a != b
            src, dst = i[a[keep]], i[b[keep]]
            if wide:
                order = np.lexsort((dst, src))
                src, dst = src[order], dst[order]
            else:
                keys = distinct(src.astype(np.int64) << 32 | dst)
                src, dst = (keys >> 32).astype(kind), (keys & 0xFFFFFFFF).astype(kind)
            part = _dealt(src, n_ids)
            order = np.argsort(part.astype(np.uint16) if n_ids < 1 << 16 else part, kind="stable")
            src, dst, bounds = src[order], dst[order], np.searchsorted(part[order], np.arange(n_ids + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                x, y = bounds[k], bounds[k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), _gaps(src[x:y]), _gaps(dst[x:y])], ["part", "src", "dst"])
            cut = stop

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wide:
            src, dst = _all(batches, ["src", "dst"], kind)
            names = distinct(np.concatenate([src, dst]))
            keys = distinct(np.searchsorted(names, src) << 32 | np.searchsorted(names, dst))
            yield from _lists_of(keys, lambda x: names[x])
            return
        keys, more = np.zeros(0, np.int64), []
        for batch in batches:
            more += [src.astype(np.int64) << 32 | dst for src, dst in zip(_members(batch.column("src"), kind), _members(batch.column("dst"), kind))]
            if sum(map(len, more)) > max(PAIRS, len(keys)):  # pairs of many groups are one
                keys, more = distinct(np.concatenate([keys, *more])), []
        yield from _lists_of(distinct(np.concatenate([keys, *more])), lambda x: x + low)

    sent = rows.repartition(n_groups, "g").mapInArrow(pairs, "part int, src binary, dst binary")
    return sent.repartitionById(n_ids, "part").mapInArrow(lists, "id long, nbrs array<bigint>")


# --- lists along an order ------------------------------------------------------------------------


def upward(lists: DataFrame, places: DataFrame | None) -> DataFrame | None:
    """(id, nbrs): of whole neighbourhoods, those later by places(id, place) and then by id; None where they are too many to send to all workers.

    Without places they are later by id.
    """
    if places is None:
        return lists.select("id", F.filter("nbrs", lambda x: x > F.col("id")).alias("nbrs")).where(F.size("nbrs") > 0)
    one = places.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if one.n > PLACES:
        return None
    found = places.select("id", "place").toArrow()
    ids, place = found.column("id").to_numpy(), found.column("place").to_numpy()
    if len(place) and 0 <= place.min() and place.max() < 1 << 31:
        place = place.astype(np.int32)
    if one.n and not one.high - one.low > 4 * one.n + 1_000:
        table = np.zeros(one.high - one.low + 1, place.dtype)
        table[ids - one.low] = place
        names = None
    else:
        order = np.argsort(ids)
        names, table = ids[order], place[order]
    shared = lists.sparkSession.sparkContext.broadcast((names, table, one.low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, low = shared.value
        at = (lambda x: table[x - low]) if names is None else (lambda x: table[np.searchsorted(names, x)])
        for batch in batches:
            if not batch.num_rows:
                continue
            nbrs = batch.column("nbrs")
            size, flat = pc.list_value_length(nbrs).to_numpy().astype(np.int64), nbrs.flatten().to_numpy()
            id_ = batch.column("id").to_numpy()
            own, own_id, other = np.repeat(at(id_), size), np.repeat(id_, size), at(flat)
            keep = (other > own) | ((other == own) & (flat > own_id))
            left = np.add.reduceat(np.append(keep, False), np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64) * (size > 0)
            some = left > 0
            cuts = np.concatenate([[0], np.cumsum(left[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(id_[some]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[keep]))], ["id", "nbrs"])

    return lists.select("id", "nbrs").mapInArrow(run, "id long, nbrs array<bigint>")


# --- triangles in tasks ----------------------------------------------------------------------------


def vertex_counts(out: DataFrame) -> DataFrame:
    """(id, n): triangles at a vertex, 0 left out, from the lists of an acyclic order; a task sums what it finds for each vertex."""
    rows, arcs, low, wide = blocks.numbers(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, span, plain = blocks._coded_blocks(batches, low, wide)
        total = np.zeros(span, np.int64)
        for x, y in ((0, 0), (1, 2), (2, 1)):
            if x in held and y in held:
                a, b = held[x], held[y]
                for r, t, n, hits in blocks._shared(a, b, span, True):
                    np.add.at(total, a.id[r], n)
                    np.add.at(total, b.id[t], n)
                    np.add.at(total, hits, 1)
        ids = np.flatnonzero(total)
        for k in range(0, len(ids), OUT):
            yield pa.RecordBatch.from_arrays([pa.array(plain(ids[k : k + OUT])), pa.array(total[ids[k : k + OUT]])], ["id", "n"])

    return blocks._paired(rows, arcs).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- what lies around a vertex ---------------------------------------------------------------------

#: Kinds of packed entries: later neighbours of a root with still later ones that both have; earlier neighbours with later ones; all later ones of a root; rows given.
UP, DOWN, OWN, GIVEN = range(4)


class Around:
    """The roots of a partition, each with its later neighbours P in the order of their ids, then earlier ones X that share one of them.

    `names` are the vertices, from start[r] on those of root r, later[r] of them in P. Of each kind of entries, `entries` has where
    those of a root begin, and of every entry its vertex' place among the root's, where its members begin, and their places, all in P.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], low: int, wide: bool):
        held: dict[int, list] = {}
        of = np.int64 if wide else np.int32
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for kind in np.unique(kinds).tolist():
                t = batch.filter(pa.array(kinds == kind))
                held.setdefault(kind, []).append([_flat(_members(t.column(c), np.int32 if c == "size" else of)) for c in ("root", "other", "size", "flat")])
        none = [np.zeros(0, np.int64)] * 4
        sets = {kind: [_flat([c[k] for c in held[kind]]) for k in range(4)] if kind in held else none for kind in (UP, DOWN, OWN, GIVEN)}
        held.clear()
        if wide:
            known = distinct(np.concatenate([x for s in sets.values() for x in (s[0], s[1], s[3])]))
            sets = {kind: [np.searchsorted(known, root), np.searchsorted(known, other), size, np.searchsorted(known, flat)] for kind, (root, other, size, flat) in sets.items()}
            plain = lambda x: known[x]
        else:
            plain = lambda x: x.astype(np.int64) + low
        roots = distinct(np.concatenate([s[0] for s in sets.values()]))
        for kind, (root, other, size, flat) in sets.items():
            order = np.argsort(root, kind="stable")
            start = np.cumsum(size, dtype=np.int64) - size
            flat = flat[_runs(size[order].astype(np.int64), start[order])]
            sets[kind] = [np.searchsorted(roots, root[order]), other[order].astype(np.int64), size[order].astype(np.int64), flat.astype(np.int64)]
        key = lambda r, x: r.astype(np.int64) << 32 | x
        spread = lambda s: key(np.repeat(s[0], s[2]), s[3])
        up, down, own, given = (sets[k] for k in (UP, DOWN, OWN, GIVEN))
        later = distinct(np.concatenate([spread(own), key(up[0], up[1]), spread(up), spread(down)]) if not len(own[0]) else spread(own))
        earlier = distinct(key(down[0], down[1]))
        ends = np.arange(len(roots) + 1, dtype=np.int64) << 32
        p, x = np.searchsorted(later, ends), np.searchsorted(earlier, ends)
        self.later, self.start = np.diff(p), p + x
        self.roots = plain(roots)
        mixed = np.empty(len(later) + len(earlier), np.int64)
        mixed[np.arange(len(later)) + x[later >> 32]] = later & 0xFFFFFFFF
        mixed[np.arange(len(earlier)) + p[(earlier >> 32) + 1]] = earlier & 0xFFFFFFFF
        self.names = plain(mixed)
        self.entries = {}
        for kind, s, among in ((UP, up, (later, p, 0)), (DOWN, down, (earlier, x, self.later))):
            table, begin, after = among
            at = np.searchsorted(table, key(s[0], s[1])) - begin[s[0]] + (after[s[0]] if kind == DOWN else 0)
            owner = np.repeat(s[0], s[2])
            places = np.searchsorted(later, key(owner, s[3])) - p[owner]
            self.entries[kind] = np.searchsorted(s[0], np.arange(len(roots) + 1)), at, np.concatenate([[0], np.cumsum(s[2])]), places
        self.given = np.searchsorted(given[0], np.arange(len(roots) + 1)), np.concatenate([[0], np.cumsum(given[2])]), plain(given[3]) if len(given[3]) else given[3]

    def __iter__(self) -> Iterator[tuple[int, list[int], int, list[int], list[list[int]]]]:
        """(root, names, later, nbr, given): of each root its vertices, how many are later, the masks of each one's neighbours, where only
        the earlier ones' among themselves are left out, and the rows given."""
        for r, root in enumerate(self.roots.tolist()):
            names = self.names[self.start[r] : self.start[r + 1]].tolist()
            nbr = [0] * len(names)
            for begin, at, cuts, places in self.entries.values():
                a, b = int(begin[r]), int(begin[r + 1])
                if a == b:
                    continue
                edge = cuts[a : b + 1].tolist()
                members = places[edge[0] : edge[-1]].tolist()
                for k, v in enumerate(at[a:b].tolist()):
                    mask, bit = 0, 1 << v
                    for w in members[edge[k] - edge[0] : edge[k + 1] - edge[0]]:
                        mask |= 1 << w
                        nbr[w] |= bit
                    nbr[v] |= mask
            begin, cuts, flat = self.given
            rows = [flat[cuts[k] : cuts[k + 1]].tolist() for k in range(int(begin[r]), int(begin[r + 1]))]
            yield root, names, int(self.later[r]), nbr, rows

    def shared(self) -> np.ndarray:
        """How many neighbours the ends of an edge share, of each edge from a root to a later neighbour; 0 may be left out."""
        total = np.zeros(len(self.names), np.int64)
        for kind, (begin, at, cuts, places) in self.entries.items():
            first = np.repeat(self.start[:-1], np.diff(begin))
            size = np.diff(cuts)
            if kind == UP:
                np.add.at(total, first + at, size)
            np.add.at(total, np.repeat(first, size) + places, 1)
        return total


def _packed(kind: int, root: np.ndarray, other: np.ndarray, size: np.ndarray, flat: np.ndarray, n: int, of) -> Iterator[pa.RecordBatch]:
    """Entries by the partition of their root, and sorted by root."""
    part = _dealt(root, n)
    order = np.lexsort((root, part))
    start = np.cumsum(size, dtype=np.int64) - size
    size = size[order].astype(np.int64)
    flat = flat[_runs(size, start[order])].astype(of)
    bounds, cuts = np.searchsorted(part[order], np.arange(n + 1)), np.concatenate([[0], np.cumsum(size)])
    root, other, size = root[order].astype(of), other[order].astype(of), size.astype(np.int32)
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[k], bounds[k + 1]
        columns = [pa.array([k], pa.int32()), pa.array([kind], pa.int32()), _gaps(root[a:b]), _gaps(other[a:b]), _gaps(size[a:b]), _gaps(flat[cuts[a] : cuts[b]])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "kind", "root", "other", "size", "flat"])


def around(out: DataFrame, kernel: Callable, schema: str, earlier: bool = False, own: bool = False, given: DataFrame | None = None) -> DataFrame:
    """kernel(Around) of each partition of roots, from the lists out(id, nbrs) of an acyclic order. Every triangle is found once, where two lists meet,
    and goes to its first vertex, and to its second too if `earlier`; `own` gives all later neighbours, also those in no triangle.

    given(row) are arrays of ids that go to their smallest member.
    """
    rows, arcs, low, wide = blocks.numbers(out, None if given is None else given.select(F.col("row").alias("nbrs")))
    wedges = out.agg(F.coalesce(F.sum(F.expr("cast(size(nbrs) as long) * (size(nbrs) - 1) div 2")), F.lit(0)).alias("w")).first().w
    n = max(1, min(2 * _slots(out), 1 + arcs // 20_000), arcs // ARCS, wedges // WEDGES)
    of = np.int64 if wide else np.int32
    shape = "part int, kind int, root binary, other binary, size binary, flat binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, span, plain = blocks._coded_blocks(batches, low, wide)
        plain = plain if wide else (lambda x: x)
        waiting, size = [], 0

        def flush():
            src, dst, n_, hits = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            src, dst, hits = plain(src), plain(dst), plain(hits)
            yield from _packed(UP, src, dst, n_, hits, n, of)
            if earlier:
                yield from _packed(DOWN, dst, src, n_, hits, n, of)

        if own and 0 in held:
            a, first = held[0], 0
            while first < len(a.id):
                last = max(first + 1, int(np.searchsorted(a.start, a.start[first] + MADE, "right")) - 1)
                yield from _packed(OWN, plain(a.id[first:last]), plain(a.id[first:last]), a.size[first:last], plain(a.flat[a.start[first] : a.start[last]]), n, of)
                first = last
        for x, y in ((0, 0), (1, 2), (2, 1)):
            if x not in held or y not in held:
                continue
            a, b = held[x], held[y]
            for r, t, found, hits in blocks._shared(a, b, span, True):
                some = found > 0
                if some.any():
                    waiting.append((a.id[r[some]], b.id[t[some]], found[some], hits))
                    size += len(waiting[-1][0]) + len(hits)
                if size > MADE:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            size = pc.list_value_length(rows).to_numpy().astype(np.int64)
            flat = rows.flatten().to_numpy()
            flat = flat if wide else flat - low
            if len(size):
                root = np.minimum.reduceat(flat, np.cumsum(size) - size)
                yield from _packed(GIVEN, root, root, size, flat, n, of)

    sent = blocks._paired(rows, arcs).mapInArrow(send, shape)
    if given is not None:
        sent = sent.unionByName(given.select("row").where(F.size("row") > 0).mapInArrow(bring, shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(Around(batches, low, wide))

    return sent.repartitionById(n, "part").mapInArrow(run, schema)
