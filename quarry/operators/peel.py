"""Loops over a whole graph by one task that holds a few numbers a vertex; members of lists lie in a file of the task.

Peeling reads a list once, when its vertex is removed; ranks and components read all lists in their order in each round.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.operators.blocks import WORK, numbers

#: Vertices up to which a task may take a graph, at about 50 bytes each.
VERTICES = 15_000_000


class Lists:
    """Neighbourhoods by place: ids, sizes, ranks and starts in memory, members in a file."""

    def __init__(self, batches: Iterator[pa.RecordBatch], low: int, wide: bool):
        ids, size, rank = [], [], []
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.NamedTemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
            for batch in batches:
                nbrs = batch.column("nbrs")
                ids.append(batch.column("id").to_numpy())
                rank.append(batch.column("rank").to_numpy())
                size.append(pc.list_value_length(nbrs).to_numpy())
                file.write(nbrs.flatten().to_numpy().tobytes())
            file.flush()
            self.id = np.concatenate([np.zeros(0, np.int64), *ids]) if wide else np.concatenate([np.zeros(0, np.int32), *ids])
            self.size, self.rank = np.concatenate([np.zeros(0, np.int64), *size]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *rank])
            self.start = np.concatenate([[0], np.cumsum(self.size)])
            kind = np.int64 if wide else np.int32
            # the file has no name after this block, and goes with the map
            self.flat = np.memmap(file.name, kind, "r") if self.start[-1] else np.zeros(0, kind)
        if wide:
            self.sorted = np.argsort(self.id)
            self.names = self.id[self.sorted]
        else:
            self.at = np.full(1 + max(int(self.id.max(initial=-1)), int(max((self.flat[k : k + WORK].max() for k in range(0, len(self.flat), WORK)), default=-1))), -1, np.int32)
            self.at[self.id] = np.arange(len(self.id), dtype=np.int32)
        self.low, self.wide = low, wide

    def plain(self) -> np.ndarray:
        return self.id if self.wide else self.id.astype(np.int64) + self.low

    def near(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the members of these lists, about WORK at a time."""
        ends = np.cumsum(self.size[rows])
        cut = 0
        while cut < len(rows):
            done = ends[cut - 1] if cut else 0
            stop = max(cut + 1, int(np.searchsorted(ends, done + WORK, "right")))
            size = self.size[rows[cut:stop]]
            members = self.flat[np.repeat(self.start[rows[cut:stop]] - (ends[cut:stop] - size - done), size) + np.arange(ends[stop - 1] - done)]
            if self.wide:
                found = np.minimum(np.searchsorted(self.names, members), max(len(self.names) - 1, 0))
                yield self.sorted[found[self.names[found] == members]]
            else:
                places = self.at[members]
                yield places[places >= 0]
            cut = stop


    def scan(self, values: np.ndarray, empty) -> Iterator[tuple]:
        """(found, starts, rows): of some lists that hold something, the values of their members one after another, where each list starts, and its place. Ids without a list have the value `empty`."""
        if not self.wide:
            by = np.full(len(self.at), empty, values.dtype)
            by[self.id] = values
        first = 0
        while first < len(self.id):
            last = max(first + 1, int(np.searchsorted(self.start, self.start[first] + WORK, "right")) - 1)
            full = np.flatnonzero(self.size[first:last])
            if len(full):
                members = self.flat[self.start[first] : self.start[last]]
                if self.wide:
                    place = np.minimum(np.searchsorted(self.names, members), len(self.names) - 1)
                    found = np.where(self.names[place] == members, values[self.sorted[place]], empty)
                else:
                    found = by[members]
                yield found, (self.start[first:last] - self.start[first])[full], first + full
            first = last


def _cores(lists: Lists) -> Iterator[tuple]:
    left, core = lists.size.copy(), np.zeros(len(lists.id), np.int64)
    there, rest, k = np.ones(len(lists.id), bool), np.arange(len(lists.id)), 0
    while len(rest):
        k = max(k, int(left[rest].min()))
        front = rest[left[rest] <= k]
        while len(front):
            core[front], there[front] = k, False
            touched = []
            for near in lists.near(front):
                near = near[there[near]]
                np.subtract.at(left, near, 1)
                touched.append(np.unique(near))
            touched = np.unique(np.concatenate(touched))
            front = touched[left[touched] <= k]
        rest = rest[there[rest]]
    yield lists.plain(), core


def _batches(limit: Callable, eps: float):
    def run(lists: Lists) -> Iterator[tuple]:
        left, there = lists.size.copy(), np.ones(len(lists.id), bool)
        rest, ids = np.lexsort((lists.id, lists.rank)), lists.plain()
        round_ = 0
        while len(rest):
            d = left[rest]
            batch = rest[d <= max(int(limit(d, eps)), int(d.min()))]
            yield ids[batch], np.full(len(batch), round_), left[batch]
            there[batch] = False
            for near in lists.near(batch):
                np.subtract.at(left, near[there[near]], 1)
            rest = rest[there[rest]]
            round_ += 1

    return run


def _ranks(iterations: int, damping: float, tolerance: float | None):
    def run(lists: Lists) -> Iterator[tuple]:
        n = len(lists.id)
        out, rank = np.zeros(n), np.full(n, 1.0 / max(n, 1))
        for near in (x for k in range(0, n, WORK) for x in lists.near(np.arange(k, min(k + WORK, n)))):
            np.add.at(out, near, 1)
        for _ in range(iterations):
            got = np.zeros(n)
            for found, starts, rows in lists.scan(np.divide(rank, out, out=np.zeros(n), where=out > 0), 0.0):
                got[rows] = np.add.reduceat(found, starts)
            new = (1 - damping) / n + damping * got if n else got
            moved, rank = np.abs(new - rank).sum(), new
            if tolerance is not None and moved < tolerance:
                break
        yield lists.plain(), rank

    return run


def _labels(lists: Lists) -> Iterator[tuple]:
    """Trees of places in the order of ids: each takes the smallest root around it, till none does."""
    by_id = np.argsort(lists.id)
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    root, moved = np.arange(len(by_id)), True
    while moved:
        before = root.copy()
        for found, starts, rows in lists.scan(before[place], len(by_id)):
            low = np.minimum.reduceat(found, starts)
            np.minimum.at(root, before[place[rows]], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        moved = not np.array_equal(before, root)
    ids = lists.plain()
    yield ids, ids[by_id[root[place]]]


def _run(lists: DataFrame, kernel: Callable, schema: str, most: int) -> DataFrame | None:
    """The kernel's rows over lists(id, nbrs[, rank]), or nothing where there are more members than `most`, or more vertices than a task may hold."""
    rows, arcs, low, wide = numbers(lists)
    if arcs > most or lists.count() > VERTICES:
        return None
    names, types = [c.split()[0] for c in schema.split(", ")], [pa.float64() if c.endswith("double") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in kernel(Lists(batches, low, wide)):
            for k in range(0, len(columns[0]), WORK):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + WORK], t) for c, t in zip(columns, types)], names)

    return rows.repartition(1).mapInArrow(run, schema)


def cores(lists: DataFrame, most: int) -> DataFrame | None:
    """(id, core)"""
    return _run(lists, _cores, "id long, core long", most)


def batches(lists: DataFrame, limit: Callable, eps: float, most: int) -> DataFrame | None:
    """(id, round, d): each round removes the vertices with at most limit(neighbours left, eps) of them, and those with the fewest; these numbers come in the order of ranks."""
    return _run(lists, _batches(limit, eps), "id long, round long, d long", most)


def ranks(lists: DataFrame, iterations: int, damping: float, tolerance: float | None, most: int) -> DataFrame | None:
    """(id, rank) of traverse.pagerank(), from the in-neighbours of every vertex."""
    return _run(lists, _ranks(iterations, damping, tolerance), "id long, rank double", most)


def labels(lists: DataFrame, most: int) -> DataFrame | None:
    """(id, component): the smallest id of the component."""
    return _run(lists, _labels, "id long, component long", most)
