"""Readers, writers and streams on small files."""

from graphloom.sources import files
from graphloom.streaming.batches import run_available


def test_graph6(spark):
    known = spark.createDataFrame([(1, "D?{"), (2, "C~"), (3, ""), (4, None), (5, "D"), (6, "@")], "graph_id long, graph6 string")
    found = sorted(map(tuple, files.graph6_edges(known).collect()))
    star = [(1, k, 4) for k in range(4)]
    assert found == sorted(star + [(2, a, b) for a in range(4) for b in range(a + 1, 4)])
    assert {r["graph_id"]: r["graph6"] for r in files.graph6_text(files.graph6_edges(known)).collect()} == {1: "D?{", 2: "C~"}


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "graph_id long, a double").coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next((tmp_path / "x").glob("part*"))
    (tmp_path / "y").mkdir()
    part.rename(tmp_path / "y" / "loops_7.parquet")
    spark.createDataFrame([(2, 9)], "graph_id long, loop int").write.parquet(str(tmp_path / "z"))
    rows = {r["graph_id"]: (r["a"], r["loop"]) for r in files.read_tables(spark, [str(tmp_path / "y"), str(tmp_path / "z")]).collect()}
    assert rows == {1: (2.0, 7), 2: (None, 9)}
    (tmp_path / "g.csv").write_text('graph_id,COEFFICIENTS,DEN_EDGES,NUM_EDGES\n1,1/2,"[(1, 0), (1, 2)]","[(0, 2)]"\n2,0,,nan\n')
    labels, edges = files.read_graphs(spark, str(tmp_path / "g.csv"))
    assert labels.count() == 2
    assert sorted(map(tuple, edges.collect())) == [(1, "DEN", 0, 1), (1, "DEN", 1, 2), (1, "NUM", 0, 2)]


def test_ranges(spark):
    good = spark.createDataFrame([(0, 5), (5, 9)], "range_start long, range_end long")
    assert files.untiled(good, 0, 9).count() == 0
    assert files.untiled(good, 0, 10).count() == 1 and files.untiled(good.where("range_start > 0"), 0, 9).count() == 1
    assert [r[0] for r in files.not_done(good, good.limit(0), ["range_start"]).orderBy("range_start").collect()] == [0, 5]


def test_stream_goes_on(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1), (None, 2)], "k long, x int").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):  # the second time there is nothing new
        run_available(spark, source, schema, lambda b: b, target, "k")
    assert [r["x"] for r in spark.read.parquet(f"{target}/rows").collect()] == [1]
    spark.createDataFrame([(7, 7)], "k long, x int").coalesce(1).write.mode("append").parquet(source)
    run_available(spark, source, schema, lambda b: b, target, "k")
    assert sorted(r["x"] for r in spark.read.parquet(f"{target}/rows").collect()) == [1, 7]
    assert [r["x"] for r in spark.read.parquet(f"{target}/errors").collect()] == [2]
    assert sorted((r["n_rows"], r["n_good"]) for r in spark.read.parquet(f"{target}/manifest").collect()) == [(1, 1), (2, 1)]
