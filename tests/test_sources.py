import pytest

from quarry import harness
from quarry.functions import codec
from quarry.functions.sets import difference, equal, intersect, make, set_range, to_string, union
from quarry.operators.graph import Graph
from quarry.sources import graphs


def test_edge_list_files(spark, tmp_path):
    path = tmp_path / "g.el"
    path.write_text("0 1\n  1\t2 \n\n# note\n2 0\n4 4\n1 0\n")
    g = graphs.graph_from_file(spark, str(path))
    assert sorted(map(tuple, g.half.collect())) == [(0, 1), (0, 2), (1, 2)]
    assert sorted(r.id for r in g.vertices.collect()) == [0, 1, 2, 3, 4]
    graphs.write_edge_list(g.edges, str(tmp_path / "out"))
    back = graphs.edge_list(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, g.edges.collect()))
    weighted = tmp_path / "w.el"
    weighted.write_text("0 1 5\n1 0 3\n1 2 7\n")
    graphs.convert(spark, str(weighted), str(tmp_path / "w.parquet"), weighted=True)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "w.parquet")).collect())) == [(0, 1, 3), (1, 0, 3), (1, 2, 7), (2, 1, 7)]
    graphs.convert(spark, str(path), str(tmp_path / "g.parquet"))
    assert spark.read.parquet(str(tmp_path / "g.parquet")).count() == 6


def test_generators_do_not_depend_on_partitions(spark):
    for make_graph in (lambda: graphs.uniform(spark, 6, 8), lambda: graphs.rmat(spark, 6, 8)):
        first = sorted(map(tuple, make_graph().collect()))
        assert first == sorted(map(tuple, make_graph().repartition(7).collect()))
        assert all(0 <= a < b < 64 for a, b in first) and len(first) > 20


def test_sets(spark):
    df = spark.createDataFrame([([3, 1, 2, 5, 4], [7, 3, 4, 5, 6, 3]), ([], [1])], "a array<bigint>, b array<bigint>").select(make(F_col("a")).alias("a"), make(F_col("b")).alias("b"))
    rows = df.select(to_string(union(df.a, df.b)).alias("u"), to_string(intersect(df.a, df.b)).alias("i"), to_string(difference(df.a, df.b)).alias("d"), equal(df.a, df.b).alias("e"), to_string(set_range(F_size(df.a))).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("1,2,3,4,5,6,7", "3,4,5", "1,2", False, "0,1,2,3,4"), ("1", "", "", False, "")]


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def F_size(c):
    from pyspark.sql import functions as F

    return F.size(c)


@pytest.mark.parametrize(("value", "length"), [(2, 1), (4, 1), (10, 1), (100000, 3), (300, 2), (42, 1), (2**42, 7), (0, 1), (2**56 - 1, 8)])
def test_varint(value, length):
    data = codec.to_varint(value)
    assert len(data) == length and codec.from_varint(data) == (value, length)


def test_codecs():
    with pytest.raises(ValueError):
        codec.to_varint(2**56)
    for vertex, nbrs in ((0, [10, 500, 3000]), (3, [0, 1, 2]), (5, []), (7, [7 + 2**40])):
        assert codec.decode_neighbours(vertex, codec.encode_neighbours(vertex, nbrs)) == nbrs
    values = [5, 0, 1023, 512]
    assert codec.unpack_bits(codec.pack_bits(values, 10), 10, 4) == values
    with pytest.raises(ValueError):
        codec.pack_bits([1024], 10)
    assert codec.tree_size([], 4) == 0 and codec.tree_size(list(range(16)), 4) == 1 and codec.tree_size([3], 2) > 1


def test_sizes_agree_with_the_codec(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 10), (0, 500), (0, 3000), (3, 1), (3, 2)], "src long, dst long"))
    from pyspark.sql import functions as F

    sizes = {r.id: r.varint_bytes for r in codec.sizes(g.adjacency(), F.lit(3001).cast("long")).collect()}
    assert sizes == {r.id: len(codec.encode_neighbours(r.id, r.nbrs)) for r in g.adjacency().collect()}


def test_harness(spark, tmp_path):
    grid = harness.parameter_grid({"k": "3:7:2", "order": ["degree", "id"]})
    assert grid == [{"k": k, "order": o} for k in (3, 5, 7) for o in ("degree", "id")]
    runs = harness.run("count", lambda: spark.range(10).count(), trials=3, verify=lambda n: n == 10, labels={"k": 1})
    assert [r["trial"] for r in runs] == [0, 1, 2] and all(r["verified"] for r in runs)
    harness.write(runs, str(tmp_path / "runs.jsonl"))
    summary = harness.summary(spark, str(tmp_path / "runs.jsonl"), ["name", "k"]).collect()
    assert summary[0]["trials"] == 3 and summary[0]["mean_seconds"] >= 0
    log = tmp_path / "log.txt"
    log.write_text("@@# threads 1\n@@@ 0.5 PASS a\nnoise\n@@@ 0.7 PASS b\n@@# threads 2\n@@@ 0.1 FAIL c\n")
    got = [(r.parameters, r.line) for r in harness.collect_log(spark, str(log)).orderBy("number").collect()]
    assert got == [("threads 1", "0.5 PASS a"), ("threads 1", "0.7 PASS b"), ("threads 2", "0.1 FAIL c")]
    pipe = harness.Pipeline().stage("numbers", lambda _: spark.range(5)).stage("double", lambda df: df.selectExpr("2 * id AS id"))
    assert sorted(r.id for r in pipe.run().collect()) == [0, 2, 4, 6, 8] and list(pipe.seconds) == ["numbers", "double"]
