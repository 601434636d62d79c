"""Small graphs with known answers."""

EDGES = {
    "path3": "0-1 1-2",
    "tree6": "0-1 1-2 0-3 0-4 0-5",
    "one_triangle": "0-1 0-2 1-2",
    "three_triangles": "0-1 0-2 1-2 1-3 2-3 5-6 5-7 6-7 6-8 7-9 8-9",
    "random10": "0-1 0-2 0-6 1-4 1-5 1-6 1-9 2-3 2-9 3-4 4-6 4-7 4-8 5-6 5-8 7-8 7-9 8-9",
    "ten_vertices": "1-2 1-9 2-3 2-9 3-4 3-8 3-9 4-5 4-6 4-7 4-8 5-6 6-7 6-8 7-8",
    "nine_vertices": "0-1 1-2 1-3 1-4 1-6 2-4 2-5 2-8 3-4 3-7 3-8 4-5 4-6 4-7 4-8 5-7 6-8 7-8",
    "wheel6": "1-2 2-3 3-4 4-5 5-6 1-6 0-1 0-2 0-3 0-4 0-5 0-6",
    "kc4a": "0-1 0-2 0-3 0-4 1-2 1-3 1-4 1-5 1-6 2-3 2-4 2-5 2-6 3-4 3-7 4-8 5-6 6-7 7-8",
    "kc4b": "0-1 0-2 0-3 1-2 1-3 2-3 2-8 3-12 4-5 4-6 4-7 4-9 5-6 5-7 6-7 6-12 7-13 8-9 8-10 8-11 9-10 9-11 10-11 11-14 12-13 12-14 12-15 13-14 13-15 14-15",
    "deg7": "0-1 1-2 2-3 2-5 3-4 3-5 4-5",
}
# name: vertices, edges, triangles, 4-cliques, 5-cliques, maximal cliques, degeneracy, components
COUNTS = {
    "one_triangle": (3, 3, 1, 0, 0, 1, 2, 1), "three_triangles": (10, 11, 3, 0, 0, 7, 2, 3), "random10": (10, 18, 5, 0, 0, 11, 3, 1), "ten_vertices": (10, 15, 8, 1, 0, 6, 3, 2), "nine_vertices": (9, 18, 11, 1, 0, 9, 3, 1),
    "path3": (3, 2, 0, 0, 0, 2, 1, 1), "tree6": (6, 5, 0, 0, 0, 5, 1, 1), "wheel6": (7, 12, 6, 0, 0, 6, 3, 1), "kc4a": (9, 19, 14, 6, 1, 6, 4, 1), "kc4b": (16, 30, 16, 4, 0, 10, 3, 1), "deg7": (6, 7, 2, 0, 0, 4, 2, 1),
}
TRIANGLES = {"three_triangles": "1 2 2 1 0 1 1 1 0 0", "random10": "1 3 0 0 2 1 3 2 2 1", "ten_vertices": "0 1 2 2 5 1 4 3 4 2", "nine_vertices": "0 3 3 4 10 2 2 4 5", "wheel6": "6 2 2 2 2 2 2", "kc4a": "6 9 9 6 6 3 3 0 0", "deg7": "0 0 1 2 1 2"}
CLIQUES = {
    "three_triangles": "0,1,2 1,2,3 4 5,6,7 6,8 7,9 8,9", "random10": "0,1,6 0,2 1,4,6 1,5,6 1,9 2,3 2,9 3,4 4,7,8 5,8 7,8,9", "ten_vertices": "0 1,2,9 2,3,9 3,4,8 4,5,6 4,6,7,8", "nine_vertices": "0,1 1,2,4 1,3,4 1,4,6 2,4,5 2,4,8 3,4,7,8 4,5,7 4,6,8",
    "wheel6": "0,1,2 0,1,6 0,2,3 0,3,4 0,4,5 0,5,6", "kc4a": "0,1,2,3,4 1,2,5,6 3,7 4,8 6,7 7,8", "kc4b": "0,1,2,3 2,8 3,12 4,5,6,7 4,9 6,12 7,13 8,9,10,11 11,14 12,13,14,15", "deg7": "0,1 1,2 2,3,5 3,4,5",
}
# smallest-last order, core numbers, approximate order and its width, greedy colours by ascending and descending id
ORDERS = {
    "three_triangles": ("4 0 1 2 3 5 6 7 8 9", "2 2 2 2 0 2 2 2 2 2", "4 0 3 5 8 9 1 2 6 7", 2, "1 2 3 1 1 1 2 3 1 2", "1 3 2 1 1 3 1 2 2 1"),
    "random10": ("3 2 0 5 6 1 4 7 8 9", "2 3 2 2 3 3 3 3 3 3", "3 0 2 5 7 6 8 9 1 4", 3, "1 2 2 1 3 1 4 1 2 3", "3 2 2 1 4 3 1 3 2 1"),
    "ten_vertices": ("0 1 2 9 3 5 4 6 7 8", "0 2 2 2 3 2 3 3 3 2", "0 1 5 2 7 9 3 6 4 8", 3, "1 1 2 1 2 1 3 1 4 3", "1 2 3 2 4 1 3 2 1 1"),
    "nine_vertices": ("0 5 2 1 6 3 4 7 8", "1 3 3 3 3 3 3 3 3", "0 5 6 2 3 7 1 8 4", 4, "1 2 1 1 3 2 1 4 2", "2 1 2 4 3 1 2 2 1"),
    "kc4a": ("8 7 5 6 0 1 2 3 4", "4 4 4 4 4 3 3 2 2", "8 5 7 0 6 1 2 3 4", 4, "1 2 3 4 5 1 4 1 2", "5 4 3 1 2 2 1 2 1"),
    "deg7": ("0 1 2 3 4 5", "1 1 2 2 2 2", "0 1 4 2 3 5", 2, "1 2 1 2 1 3", "2 1 2 3 2 1"),
}


def graph(spark, name):
    from quarry.operators.graph import Graph

    pairs = [tuple(map(int, e.split("-"))) for e in EDGES[name].split()]
    ids = spark.range(max(v for e in pairs for v in e) + 1).select("id")
    return Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), ids)
