"""Graph colouring in rounds, (id, color) with colours from 1, and its checks.

Every scheme keeps its state in tables: colours so far, and what is left. Choices come from portable
hashes of (vertex, round), so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import choice, h, h2
from quarry.operators.components import components
from quarry.operators.graph import Graph, numbered, rounds
from quarry.storage import drop, materialize


def _smallest_free(used: Column) -> Column:
    return F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size(used).cast("long") + 1), used))


#: Vertices and arcs left in by_priority() that one task may finish; a task holds them all.
TAIL = 2_000_000
#: Equal slices of the falling order, of which the parts of _in_parts() are made.
BINS = 256


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(frames).sort_values(["p1", "p2"], ascending=False)
    color: dict[int, int] = {}
    for v, near, used in zip(rows["id"].tolist(), rows["near"], rows["used"]):
        taken = {*used, *(color[w] for w in near)}
        c = 1
        while c in taken:
            c += 1
        color[v] = c
    yield pd.DataFrame({"id": list(color), "color": list(color.values())}).astype("int64")


def _rest(todo: DataFrame, waits: DataFrame, known: DataFrame, priority: DataFrame) -> DataFrame:
    """The colours of todo(id) in falling priority, by one task: known colours around are a set, and what else a vertex waits for is in todo."""
    near = waits.join(known.select(F.col("id").alias("dst"), "color"), "dst", "left").groupBy(F.col("src").alias("id"))
    near = near.agg(F.collect_list(F.when(F.col("color").isNull(), F.col("dst"))).alias("near"), F.collect_set("color").alias("used"))
    none = F.array().cast("array<bigint>")
    rest = todo.join(priority, "id").join(near, "id", "left").select("id", F.col("p1").cast("long").alias("p1"), F.col("p2").cast("long").alias("p2"), F.coalesce("near", none).alias("near"), F.coalesce("used", none).alias("used"))
    return materialize(rest.repartition(1).mapInPandas(_finish, "id long, color long"), "colors-rest")


def _cuts(sizes: dict[int, int], arcs: dict[tuple[int, int], int], most: int) -> list[int]:
    """The first bin of each part: as many bins in order as hold at most so many vertices and arcs among themselves, or one."""
    starts, held = [0], 0
    for b in range(BINS):
        more = sizes.get(b, 0) + sum(arcs.get((b, x), 0) for x in range(starts[-1], b + 1))
        if held + more > most and b > starts[-1]:
            starts.append(b)
            held, more = 0, sizes.get(b, 0) + arcs.get((b, b), 0)
        held += more
    return starts


def _in_parts(todo: DataFrame, waits: DataFrame, known: DataFrame, priority: DataFrame, tail: int) -> DataFrame:
    """Parts of the falling order, one after another: one task colours a part, to which earlier parts are sets of colours.

    A part holds at most `tail` vertices and arcs among themselves, so there are about as many as the root of arcs over tail. A bin of more goes in rounds.
    """
    ranked = materialize(numbered(todo.join(priority.select("id", "p1", "p2"), "id"), [F.col("p1").desc(), F.col("p2").desc()], "place"), "color-places")
    n = ranked.count()
    binned = ranked.select("id", F.floor(F.col("place") * BINS / n).cast("int").alias("bin"))
    ends = waits.join(binned.select(F.col("id").alias("src"), F.col("bin").alias("a")), "src").join(binned.select(F.col("id").alias("dst"), F.col("bin").alias("b")), "dst", "left")
    ends = materialize(ends.repartitionByRange("a", "src").sortWithinPartitions("a"), "color-parts")
    arcs = {(r.a, r.b): r.n for r in ends.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).collect()}  # at most BINS^2 rows
    sizes = {r.bin: r.n for r in binned.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    starts = _cuts(sizes, arcs, tail)
    for first, end in zip(starts, [*starts[1:], BINS]):
        mine, own = binned.where(F.col("bin").between(first, end - 1)).select("id"), ends.where(F.col("a").between(first, end - 1)).select("src", "dst")
        if end - first == 1 and sizes.get(first, 0) + arcs.get((first, first), 0) > tail:
            known = _in_rounds(materialize(mine, "color-todo"), materialize(own, "color-waits"), known, priority, None, tail)
        else:
            known = known.unionByName(_rest(mine, own, known, priority))
    return known


def _in_rounds(todo: DataFrame, waits: DataFrame, known: DataFrame, priority: DataFrame, max_rounds: int | None, tail: int) -> DataFrame:
    for _ in rounds(max_rounds):
        if todo.isEmpty():
            break
        if _ % 8 == 0 and todo.count() + waits.count() <= tail:
            return known.unionByName(_rest(todo, waits, known, priority))
        state = waits.join(known.select(F.col("id").alias("dst"), "color"), "dst", "left").groupBy(F.col("src").alias("id"))
        state = state.agg(F.count("*").alias("n"), F.count("color").alias("have"), F.collect_set("color").alias("used"))
        ready = todo.join(state, "id", "left").where(F.coalesce("n", F.lit(0)) == F.coalesce("have", F.lit(0)))
        new = materialize(ready.select("id", _smallest_free(F.coalesce("used", F.array().cast("array<bigint>"))).alias("color")), "colors-new")
        known = known.unionByName(new)
        before, todo = todo, materialize(todo.join(new, "id", "left_anti"), "color-todo")
        drop(before)
        if _ % 8 == 7:
            known = materialize(known, "colors")
            left = materialize(waits.join(todo.withColumnRenamed("id", "src"), "src", "left_semi"), "color-waits")
            waits = left
    return known


def by_priority(g: Graph, priority: DataFrame, colored: DataFrame | None = None, max_rounds: int | None = None, tail: int = TAIL) -> DataFrame:
    """First-fit colours in rounds: a vertex takes the smallest colour its neighbours lack once all neighbours of higher priority have theirs.

    priority(id, p1, p2): compared as a pair, all different. The result equals greedy colouring in falling priority. `colored` fixes some vertices beforehand.
    Up to `tail` vertices and arcs, by their count, are coloured by one task in that order; more in parts of the order, each by one task. With tail=0, or a limit of rounds, a vertex is coloured in the round after its last such neighbour: as many rounds as vertices on the longest falling path.
    """
    p = priority.select("id", F.struct("p1", "p2").alias("p"))
    e = g.edges.join(p.withColumnRenamed("id", "src").withColumnRenamed("p", "ps"), "src").join(p.withColumnRenamed("id", "dst").withColumnRenamed("p", "pd"), "dst")
    known = colored.select("id", "color") if colored is not None else priority.select("id", F.lit(0).cast("long").alias("color")).limit(0)
    known = materialize(known, "colors")
    todo = materialize(priority.select("id").join(known, "id", "left_anti"), "color-todo")
    fixed = known.select(F.col("id").alias("dst"), F.lit(True).alias("fixed"))
    # an arc from each vertex to a neighbour it waits for
    waits = e.join(fixed, "dst", "left").where((F.col("pd") > F.col("ps")) | F.col("fixed")).select("src", "dst")
    waits = materialize(waits.join(todo.withColumnRenamed("id", "src"), "src", "left_semi"), "color-waits")
    if tail and max_rounds is None and todo.count() + waits.count() > tail:
        return _in_parts(todo, waits, known, priority, tail)
    return _in_rounds(todo, waits, known, priority, max_rounds, tail)


def greedy(g: Graph, descending: bool = False) -> DataFrame:
    """First fit by id."""
    sign = 1 if descending else -1
    return by_priority(g, g.vertices.select("id", (sign * F.col("id")).alias("p1"), F.lit(0).alias("p2")))


def jones_plassmann(g: Graph, heuristic: str = "random", seed: int = 0, order: DataFrame | None = None) -> DataFrame:
    """Priorities by hash, by (degree, hash), or by a given order (id, rank)."""
    if order is not None:
        return by_priority(g, order.select("id", F.col("rank").alias("p1"), F.col("id").alias("p2")))
    key = h(F.col("id"), seed) * (1 << 31) + F.col("id") % (1 << 31)
    if heuristic == "largest_degree":
        return by_priority(g, g.degrees().select("id", F.col("degree").alias("p1"), key.alias("p2")))
    return by_priority(g, g.vertices.select("id", key.alias("p1"), F.lit(0).alias("p2")))


def _dynamic(kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        nbrs = {int(r.id): r.nbrs for f in frames for r in f.itertuples()}  # the arrays as they came: lists of ints take five times as much
        color: dict[int, int] = {}
        seen = dict.fromkeys(nbrs, 0)  # colours around as a mask (saturation) or the number of coloured neighbours (incidence)
        count = int.bit_count if kind == "saturation" else int
        heap = [(0, -len(n), v) for v, n in nbrs.items()]
        heapq.heapify(heap)
        while heap:
            s, _, v = heapq.heappop(heap)
            if v in color or -s != count(seen[v]):
                continue
            near = nbrs[v].tolist()
            used = {color[w] for w in near if w in color}
            c = 1
            while c in used:
                c += 1
            color[v] = c
            for w in near:
                if w not in color:
                    old = seen[w]
                    seen[w] = old | 1 << c if kind == "saturation" else old + 1
                    if seen[w] != old:
                        heapq.heappush(heap, (-count(seen[w]), -len(nbrs[w]), w))
            if len(heap) > 2 * (len(nbrs) - len(color)) + 1000:  # most of it out of date
                heap = [(-count(seen[w]), -len(nbrs[w]), w) for w in nbrs if w not in color]
                heapq.heapify(heap)
        yield pd.DataFrame({"id": list(color), "color": list(color.values())}).astype("int64")

    return run


def dynamic(g: Graph, kind: str = "saturation") -> DataFrame:
    """Most colours around next (saturation) or most coloured neighbours next (incidence), ties by degree, then id.

    The next choice depends on all before, so a connected component is one task's work; components run in parallel.
    """
    kernel = _dynamic(kind)
    label = components(g.half)
    rows = g.adjacency().join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return next(kernel(iter([frame])))

    return rows.groupBy("label").applyInPandas(run, "id long, color long")


def _resolve(tried: DataFrame, edges: DataFrame, known: DataFrame, both_fail: bool = False) -> DataFrame:
    """Of tried(id, color) those that differ from coloured neighbours, and from neighbours that tried the same and have the higher id (or from any, if both fail)."""
    around = edges.join(known.select(F.col("id").alias("dst"), "color"), "dst").select(F.col("src").alias("id"), "color")
    free = tried.join(around, ["id", "color"], "left_anti")
    same = edges.join(free.select(F.col("id").alias("src"), "color"), "src").join(free.select(F.col("id").alias("dst"), F.col("color").alias("other")), "dst").where(F.col("color") == F.col("other"))
    lost = same.where(F.lit(both_fail) | (F.col("dst") > F.col("src"))).select(F.col("src").alias("id")).distinct()
    return free.join(lost, "id", "left_anti").select("id", "color")


def johansson(g: Graph, seed: int = 0, max_rounds: int | None = None) -> DataFrame:
    """Every vertex left tries a hashed colour of 1..max degree + 1 each round and keeps it unless a neighbour has or tries it."""
    edges = materialize(g.edges, "color-edges")
    top = g.degrees().agg(F.max("degree").alias("d")).first().d or 0
    todo = materialize(g.vertices, "color-todo")
    known = materialize(todo.select("id", F.lit(0).cast("long").alias("color")).limit(0), "colors")
    for round_ in rounds(max_rounds):
        if todo.isEmpty():
            break
        tried = todo.select("id", (choice(h2(F.col("id"), F.lit(round_), seed), top + 1) + 1).alias("color"))
        new = materialize(_resolve(tried, edges, known), "colors-new")
        known = known.unionByName(new) if round_ % 8 < 7 else materialize(known.unionByName(new), "colors")
        before, todo = todo, materialize(todo.join(new, "id", "left_anti"), "color-todo")
        drop(before)
        # arcs of vertices with a colour are asked no more
        before, edges = edges, materialize(edges.join(todo.withColumnRenamed("id", "src"), "src", "left_semi"), "color-edges")
        drop(before)
    return known


def _palettes(ids: DataFrame, edges: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """(id, palette): colours of 1..top + 1 that no coloured neighbour has."""
    around = edges.join(known.select(F.col("id").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("color").alias("used"))
    whole = F.sequence(F.lit(1).cast("long"), F.lit(top + 1).cast("long"))
    return ids.join(around, "id", "left").select("id", F.array_except(whole, F.coalesce("used", F.array().cast("array<bigint>"))).alias("palette"))


def barenboim(g: Graph, seed: int = 0, rounds: int = 4, c: float = 2.0, colored: DataFrame | None = None) -> DataFrame:
    """One-shot rounds (a hashed colour of the palette, the higher id keeps it), then the vertices left are split by remaining degree c ln n, and the sparse and the dense part finished in turn by first fit under hashed priorities."""
    import math

    edges = materialize(g.edges, "color-edges")
    ids = materialize(g.vertices, "color-ids")
    top, n = g.degrees().agg(F.max("degree").alias("d")).first().d or 0, ids.count()
    known = colored if colored is not None else materialize(ids.select("id", F.lit(0).cast("long").alias("color")).limit(0), "colors")
    todo = materialize(ids.join(known, "id", "left_anti"), "color-todo")
    for round_ in range(rounds):
        if todo.isEmpty():
            return known
        p = _palettes(todo, edges, known, top)
        tried = p.select("id", F.get("palette", choice(h2(F.col("id"), F.lit(round_), seed), F.size("palette")).cast("int")).alias("color"))
        known = materialize(known.unionByName(_resolve(tried, edges, known)), "colors")
        todo = materialize(ids.join(known, "id", "left_anti"), "color-todo")
    left = edges.join(todo.withColumnRenamed("id", "src"), "src", "left_semi").join(todo.withColumnRenamed("id", "dst"), "dst", "left_semi")
    d = todo.join(left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    high = F.col("d") > c * math.log(max(n, 2))
    key = h(F.col("id"), seed + 99) * (1 << 31) + F.col("id") % (1 << 31)
    return by_priority(g, ids.join(d, "id", "left").select("id", F.when(high, F.lit(2)).when(F.col("d").isNotNull(), F.lit(1)).otherwise(F.lit(3)).alias("p1"), key.alias("p2")), known)


def elkin(g: Graph, seed: int = 0, rounds: int = 4) -> DataFrame:
    """Every vertex draws a set of its palette's colours, each with a falling chance, and keeps its smallest that no neighbour of lower id drew; the rest goes to barenboim()."""
    edges = materialize(g.edges, "color-edges")
    ids = materialize(g.vertices, "color-ids")
    top = g.degrees().agg(F.max("degree").alias("d")).first().d or 0
    known = materialize(ids.select("id", F.lit(0).cast("long").alias("color")).limit(0), "colors")
    todo = ids
    for round_ in range(rounds):
        if todo.isEmpty():
            return known
        share = min(1.0, 2.0**round_ / (top + 1) * 2)
        p = _palettes(todo, edges, known, top)
        drawn = p.select("id", F.filter("palette", lambda x: (choice(h2(F.col("id"), x, seed + round_), 10000) < int(share * 10000))).alias("drawn"))
        drawn = materialize(drawn, "color-drawn")
        lower = edges.where("dst < src").join(drawn.select(F.col("id").alias("dst"), "drawn"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("drawn"))).alias("taken"))
        own = drawn.join(lower, "id", "left").select("id", F.array_min(F.array_except("drawn", F.coalesce("taken", F.array().cast("array<bigint>")))).alias("color")).where("color is not null")
        known = materialize(known.unionByName(own), "colors")
        todo = materialize(ids.join(known, "id", "left_anti"), "color-todo")
    return barenboim(g, seed + 50, colored=known)


def dense_sparse(g: Graph, seed: int = 0, eps: float = 0.4, steps: int | None = None) -> DataFrame:
    """Edges whose ends share most neighbours are friends; vertices with mostly friends are dense, and form components with a leader.

    A first hashed colouring of all, then ceil(ln max degree) steps in which a dense component's vertices take different colours of its leader's palette, by rank, and the rest by barenboim().
    """
    import math

    edges = materialize(g.edges, "color-edges")
    ids = materialize(g.vertices, "color-ids")
    degrees = materialize(g.degrees(), "color-degrees")
    top = degrees.agg(F.max("degree").alias("d")).first().d or 0
    from quarry.operators.similarity import common

    met = common(g).select("u", "v", "common")
    friends = g.half.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(met, ["u", "v"]).where(F.col("common") >= (1 - eps) * top)
    friends = materialize(friends.select(F.col("u").alias("src"), F.col("v").alias("dst")), "friends")
    count = friends.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("f"))
    dense = materialize(count.where(F.col("f") >= (1 - eps) * top).select("id"), "dense")
    inside = friends.join(dense.withColumnRenamed("id", "src"), "src", "left_semi").join(dense.withColumnRenamed("id", "dst"), "dst", "left_semi")
    label = components(inside)
    tried = ids.select("id", (choice(h(F.col("id"), seed), top + 1) + 1).alias("color"))
    empty = ids.select("id", F.lit(0).cast("long").alias("color")).limit(0)
    known = materialize(_resolve(tried, edges, empty, both_fail=True), "colors")
    for step in range(steps if steps is not None else max(1, math.ceil(math.log(max(top, 2))))):
        todo = label.join(known, "id", "left_anti")
        if todo.isEmpty():
            break
        p = _palettes(todo.select("id"), edges, known, top)
        leader = p.join(todo, "id").groupBy("label").agg(F.min_by("palette", "id").alias("palette"))
        from pyspark.sql.window import Window

        placed = todo.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(h2(F.col("id"), F.lit(step), seed), "id")))
        tried = placed.join(leader, "label").where(F.col("k") <= F.size("palette")).select("id", F.get("palette", (F.col("k") - 1).cast("int")).alias("color"))
        known = materialize(known.unionByName(_resolve(tried, edges, known)), "colors")
    return barenboim(g, seed + 70, colored=known)


# --- checks ----------------------------------------------------------------------------------


def summary(g: Graph, colors: DataFrame) -> DataFrame:
    """n, uncoloured vertices, edges of one colour, colours, the largest, and whether each is at most its vertex's degree + 1, and all at most the maximum degree + 1."""
    d = g.degrees().join(colors, "id", "left")
    e = g.half.join(colors.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst")
    bad = e.where(F.col("a") == F.col("b")).agg(F.count("*").cast("long").alias("conflicts"))
    out = d.agg(
        F.count("*").cast("long").alias("n"),
        F.count(F.when(F.coalesce("color", F.lit(0)) < 1, 1)).cast("long").alias("uncolored"),
        F.count_distinct("color").cast("long").alias("colors"),
        F.max("color").cast("long").alias("largest"),
        (F.count(F.when(F.col("color") > F.col("degree") + 1, 1)) == 0).alias("within_degree"),
        (F.max("color") <= F.max("degree") + 1).alias("within_max_degree"),
    )
    return out.join(bad, how="cross")  # one row each


def valid(g: Graph, colors: DataFrame) -> DataFrame:
    """The parts of summary() that any proper colouring with at most max degree + 1 colours has."""
    return summary(g, colors).select("n", "uncolored", "conflicts", "within_max_degree")
