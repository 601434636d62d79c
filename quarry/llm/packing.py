"""Best-fit packing of documents into sequences of bounded length by a grouping genetic algorithm.

Items (whole documents, or the 4096-token pieces of longer ones) are dealt evenly into blocks of
bounded size. Each block is one packing problem, solved by several islands: a row per (block,
island) holds the island's best packing. An epoch evolves every island by itself; between epochs
each island gets the best packing of its neighbour in a ring (elite migration). A chromosome is a
list of bins. Crossover injects the well-filled bins of one parent into the other, removes the
bins that now hold an item twice, and puts the items displaced by that back by best fit. An island
stops at the lower bound. The under-filled bins that blocks leave are emptied and their items
packed again together, until one block is left or nothing improves.

Defined results: null or empty text is a document of the end id alone; repeated rows are packed as
separate documents; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, release, table
from quarry.llm.tokens import crc32, encoder, public_path

CAPACITY = 4096
BLOCK_ITEMS = 20_000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Bins of at least this share of the capacity stay as they are between levels.
WELL_FILLED = 0.995

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


# --- one block -------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: items over capacity - k and over half share no bin; the rest fill gaps."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    number, volume = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    over_half = int(number[-1] - number[half])
    for k in np.unique(np.concatenate(([0], lengths[lengths <= half]))):
        k = int(k)
        top = int(number[-1] - number[capacity - k]) if k else 0
        middle_n, middle_v = over_half - top, int(volume[capacity - k] - volume[half])
        small_v = int(volume[half]) - (int(volume[k - 1]) if k else 0)
        best = max(best, top + middle_n + max(0, -(-(small_v - (middle_n * capacity - middle_v)) // capacity)))
    return best


def best_fit(bins: list[list[int]], fills: list[int], items, lengths, capacity: int) -> None:
    """Put each item, in the order given, into the fullest bin that has room, or a new one."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, fill in enumerate(fills):
        room = capacity - fill
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    for i in items:
        size = lengths[i]
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
            bins[b].append(i)
            fills[b] += size
        else:
            b, room = len(bins), capacity
            bins.append([i])
            fills.append(size)
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left


def fitness(fills: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of how full they are."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills) / max(1, len(fills))


def crossover(one: list[list[int]], two: list[list[int]], lengths, capacity: int, share: float, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of `two` into `one`, drop the bins they clash with, best-fit what was displaced."""
    fills = [sum(lengths[i] for i in b) for b in two]
    order = sorted(range(len(two)), key=lambda b: -fills[b])
    taken = order[: max(1, int(len(order) * share * rng.random()))]
    injected = {i for b in taken for i in two[b]}
    kept, displaced = [], []
    for b in one:
        clash = [i for i in b if i in injected]
        if not clash:
            kept.append(list(b))
        elif len(clash) < len(b):
            displaced += [i for i in b if i not in injected]
    child = kept + [list(two[b]) for b in taken]
    displaced.sort(key=lambda i: -lengths[i])
    best_fit(child, [sum(lengths[i] for i in b) for b in child], displaced, lengths, capacity)
    return child


def mutate(bins: list[list[int]], lengths, capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty the least filled bins and a few others, and best-fit their items again."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: fills[b])
    out = set(order[: max(1, len(order) // 50)]) | {rng.randrange(len(bins)) for _ in range(2)}
    kept = [list(b) for k, b in enumerate(bins) if k not in out]
    loose = sorted((i for k in out for i in bins[k]), key=lambda i: -lengths[i])
    best_fit(kept, [sum(lengths[i] for i in b) for b in kept], loose, lengths, capacity)
    return kept


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], bound: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing that one island finds from its seeds within its generations."""
    rng = random.Random(seed)
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [[list(b) for b in s] for s in seeds]
    while len(people) < population:
        noise = 0.0 if not people else 0.05 * len(people)
        order = falling if not noise else sorted(falling, key=lambda i: -lengths[i] * (1 + noise * rng.uniform(-1, 1)))
        bins: list[list[int]] = []
        best_fit(bins, [], order, lengths, capacity)
        people.append(bins)
        if len(bins) <= bound:
            return bins
    value = lambda p: fitness([sum(lengths[i] for i in b) for b in p], capacity)
    people.sort(key=value, reverse=True)
    for _ in range(generations):
        one, two = rng.sample(people[: max(2, population // 2 + 1)], 2)
        child = mutate(crossover(one, two, lengths, capacity, 0.5, rng), lengths, capacity, rng)
        people = sorted([*people, child], key=value, reverse=True)[:population]
        if len(people[0]) <= bound:
            break
    return people[0]


def _assignment(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assigned: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1 if len(assigned) else 0)]
    for i, b in enumerate(assigned.tolist()):
        bins[b].append(i)
    return [b for b in bins if b]


# --- blocks and islands as rows --------------------------------------------------------------

STATE = "block long, island int, items array<long>, lengths array<int>, bins array<int>, n_bins int, bound int"


def _first(capacity: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item"], ascending=[False, True])
        lengths = group["length"].to_numpy(np.int64)
        bins: list[list[int]] = []
        best_fit(bins, [], range(len(lengths)), lengths.tolist(), capacity)
        row = [int(key[0]), 0, group["item"].to_numpy(), lengths.astype(np.int32), _assignment(bins, len(lengths)), len(bins), lower_bound(lengths, capacity)]
        return pd.DataFrame([row], columns=["block", "island", "items", "lengths", "bins", "n_bins", "bound"])

    return run


def _epoch(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                seeds = [_bins(np.asarray(x)) for x in (r.bins, r.elite) if x is not None]
                bins = evolve(np.asarray(r.lengths).tolist(), capacity, seeds, r.bound, 1000 * epoch + r.island)
                rows.append([r.block, r.island, r.items, r.lengths, _assignment(bins, len(r.lengths)), len(bins), r.bound])
            yield pd.DataFrame(rows, columns=["block", "island", "items", "lengths", "bins", "n_bins", "bound"])

    return run


def pack_level(items: DataFrame, n_blocks: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items(item, length) to (item, length, block, bin): every block packed by its islands."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    state = materialize(dealt.groupBy("block").applyInPandas(_first(capacity), STATE), "pack-state")
    solved = state.where("n_bins <= bound")
    open_blocks = state.where("n_bins > bound")
    tasks = max(1, min(n_blocks * islands, 100_000))  # named, as tiny rows with long work would be put together in one task
    for epoch in range(epochs):
        if open_blocks.isEmpty():
            break
        if epoch == 0:
            rows = open_blocks.drop("island").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.lit(None).cast("array<int>"))
        else:
            migrants = open_blocks.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("elite"))
            rows = open_blocks.join(migrants, ["block", "island"])
        rows = rows.select("block", "island", "items", "lengths", "bins", "n_bins", "bound", "elite").repartition(tasks, "block", "island")
        open_blocks = materialize(rows.mapInPandas(_epoch(capacity, epoch), STATE), "pack-state")
    best = open_blocks.groupBy("block").agg(F.min_by(F.struct("items", "lengths", "bins"), F.struct("n_bins", "island")).alias("s")).select("block", "s.*")
    done = solved.select("block", "items", "lengths", "bins").unionByName(best)
    rows = done.select("block", F.explode(F.arrays_zip("items", "lengths", "bins")).alias("x"))
    return rows.select(F.col("x.items").alias("item"), F.col("x.lengths").alias("length"), "block", F.col("x.bins").alias("bin"))


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, well_filled: float = WELL_FILLED) -> DataFrame:
    """items(item long, length int, 1 to capacity) to (item, sequence_id): a sequence's lengths add up to the capacity at most."""
    left, parts, level = items.select("item", F.col("length").cast("int").alias("length")), [], 0
    n = left.count()
    while n:
        n_blocks = -(-n // block_items)
        packed = materialize(pack_level(left, n_blocks, capacity), "packed")
        named = packed.withColumn("sequence_id", F.lit(level << 58) + F.col("block") * F.lit(1 << 24) + F.col("bin"))
        if n_blocks == 1:
            parts.append(named.select("item", "sequence_id"))
            break
        fills = named.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        under = fills.where(F.col("fill") < F.lit(well_filled * capacity)).select("sequence_id")
        loose = materialize(named.join(under, "sequence_id", "left_semi").select("item", "length"), "pack-left")
        m = loose.count()
        if m > 0.7 * n:  # another round would deal nearly the same items again
            parts.append(named.select("item", "sequence_id"))
            break
        parts.append(named.join(under, "sequence_id", "left_anti").select("item", "sequence_id"))
        left, n, level = loose, m, level + 1
    if not parts:
        return left.select("item", F.lit(0).cast("long").alias("sequence_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- documents to pieces ---------------------------------------------------------------------


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((item, doc_id, k, at // 4, len(part) // 4, crc32(part)))
                    item += 1
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item", "doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: item (a number for the row), doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut(docs, tokenizer, end_id, capacity), "pieces")
    rows = pieces.join(pack(pieces, capacity), "item")
    w = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
